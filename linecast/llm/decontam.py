"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Method. A benchmark window is the set of its words with their places. Words are ordered by rarity in
the whole corpus; since a hit needs every word of a window, the necessary prefix is one token, the
rarest. Documents are joined with the windows on that token alone. The place of the token in the
window gives the only possible start in the document (positional bound), which must leave room for
the whole window (length bound); what passes is verified word by word. Hits of a document are the
union of the verified windows.

Scale. The documents are never shuffled: their words stream past a broadcast table of the benchmark's
prefix tokens, whose size is measured first. A benchmark over ``BROADCAST_BYTES`` takes the other
way, a shuffled join of (document, place, token) rows, followed by the same verification. Only
verified hits are grouped, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linecast.llm.scratch import table, written

#: Everything between words: all ASCII bytes that are neither digits nor letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table is broadcast only if its measured bytes are at most this.
BROADCAST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS, -1), "")


def bounded(df: DataFrame, size: Column) -> DataFrame:
    """``df`` marked for broadcast if the sum of ``size`` over its rows is within the bound."""
    total = df.agg(F.sum(size).alias("b")).first()["b"] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def windows(items: DataFrame, id_col: str, text_col: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``(window, words, len)`` and their owners ``(window, item)``."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    w = w.withColumn("len", F.least(F.size("words"), F.lit(size)))
    w = w.select("item", "len", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("at"))
    w = w.select("item", "len", F.slice("words", F.col("at"), F.col("len")).alias("words")).withColumn("window", F.array_join("words", " "))
    own = written(w.select("window", "item").distinct(), "window-items")
    return own.select("window").distinct().withColumn("words", F.split("window", " ")).withColumn("len", F.size("words")), own


def prefix_tokens(wins: DataFrame, texts: DataFrame) -> DataFrame:
    """``(token, place, window, words, len)``: each window's rarest word in ``texts(words)``."""
    parts = wins.select("window", F.posexplode("words").alias("place", "token"))
    vocab = written(parts.select("token").distinct(), "vocabulary")
    seen = texts.select(F.explode_outer("words").alias("token")).join(bounded(vocab, F.length("token") + 16), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarity = written(seen, "rarity")
    ranked = parts.join(rarity, "token", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "place")).alias("p"))
    # a window with a word that no document holds can't occur
    return wins.join(ranked, "window").where("p.n > 0").select("p.token", "p.place", "window", "words", "len")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, min_share: tuple[int, int] = (1, 20)) -> DataFrame:
    """Rows ``(id, __key, n_words, n_hit, n_items, items_sha256, contaminated)``, one per row of ``docs``.

    A document word inside any occurrence of a window of ``window`` consecutive item words is hit; an
    item of fewer words, but not none, is one window. ``contaminated``: some word is hit, and hits are
    at least ``min_share`` of the words. ``__key`` is the text's hash.

    * null and empty texts, texts without words: no words, no hits, clean; such items have no window;
    * rows of equal id and text get equal results, each its own row; equal ids of different texts are
      kept apart by the text's hash; a null id is an id;
    * repeated items and windows count once; an item without id covers words but is not named;
    * other columns are ignored, whatever their names.
    """
    wins, own = windows(items, item_id, item_text, window)
    base = docs.select(F.col(id_col), F.xxhash64(F.col(text_col)).alias("__key"), words_of(F.col(text_col)).alias("words"))
    prefix = written(prefix_tokens(wins, base.select("words")), "prefixes").select("token", "place", "window", F.col("words").alias("wanted"), "len")

    n = F.size("words")
    small = prefix.agg(F.sum(F.length("window") * 2 + 64).alias("b")).first()["b"] or 0
    if small <= BROADCAST_BYTES:
        at = base.select(id_col, "__key", "words", F.posexplode_outer("words").alias("at", "token"))
        fits = (F.col("at") >= F.col("place")) & (F.col("at") - F.col("place") + F.col("len") <= n)
        same = F.slice("words", F.col("at") - F.col("place") + 1, F.col("len")) == F.col("wanted")
        hits = at.join(F.broadcast(prefix), "token").where(fits & same).select(id_col, "__key", (F.col("at") - F.col("place")).alias("start"), "len", "window")
    else:
        # each place with the words around it, so that a candidate is verified where it meets its window
        at = base.select(id_col, "__key", F.posexplode_outer("words").alias("at", "token"), F.col("words"))
        around = at.select(id_col, "__key", "at", "token", F.least("at", F.lit(window - 1)).alias("lead"), F.slice("words", F.greatest(F.col("at") - window + 2, F.lit(1)), F.least("at", F.lit(window - 1)) + window).alias("near"))
        lead = F.col("lead") - F.col("place")
        fits = (lead >= 0) & (lead + F.col("len") <= F.size("near"))
        hits = around.join(prefix, "token").where(fits & (F.slice("near", lead + 1, F.col("len")) == F.col("wanted"))).select(id_col, "__key", (F.col("at") - F.col("place")).alias("start"), "len", "window")
    hits = written(hits, "hits")

    covered = hits.groupBy(id_col, "__key").agg(F.collect_set(F.struct("start", "len")).alias("s"))
    places = F.flatten(F.transform("s", lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1)))
    covered = covered.select(F.col(id_col).alias("__id"), F.col("__key").alias("__k"), F.size(F.array_distinct(places)).cast("long").alias("n_hit"))
    named = hits.select(id_col, "__key", "window").distinct().join(own.where("item IS NOT NULL"), "window").select(id_col, "__key", "item").distinct()
    named = named.groupBy(F.col(id_col).alias("__id"), F.col("__key").alias("__k")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    key = F.col("__id").eqNullSafe(F.col("__nid")) & (F.col("__k") == F.col("__nk"))
    found = covered.join(named.select(F.col("__id").alias("__nid"), F.col("__k").alias("__nk"), "items"), key, "left").select("__id", "__k", "n_hit", "items")
    out = base.select(id_col, "__key", n.cast("long").alias("n_words")).join(found, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")), "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        id_col, "__key", "n_words", hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ",").cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (min_share[1] * hit >= min_share[0] * F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, all columns and rows but those that ``decontaminate`` calls contaminated."""
    bad = written(decontaminate(docs, items, id_col, text_col, **options).where("contaminated").select(F.col(id_col).alias("__id"), F.col("__key").alias("__k")).distinct(), "contaminated")
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__id"]) & (F.xxhash64(docs[text_col]) == bad["__k"]), "left_anti")


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole documents and benchmark tables."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("__key")


ORACLE_OP10 = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, len, w[s:s + len - 1] AS v FROM (SELECT item_id, w, least(len(w), 13) AS len, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len FROM win),
grams AS (SELECT doc_id, s, lens.len AS len, w[s:s + lens.len - 1] AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d), lens WHERE s + lens.len - 1 <= len(w)),
hits AS (SELECT g.doc_id, g.s, g.len, win.item_id FROM grams g JOIN win ON g.v = win.v AND g.len = win.len),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + len)) AS p FROM (SELECT DISTINCT doc_id, s, len FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(m.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cover c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""
