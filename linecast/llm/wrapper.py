"""Main text of web pages by wrapper induction over the pages of a host.

Method. A page's DOM becomes a tree of slots: block elements, siblings of one label (tag and classes)
being one repeated slot. The trees of a host's pages are aligned by simple tree matching: two nodes
match if their labels do, and the children of matched nodes by the sequence alignment with the most
matched nodes below. What does not match is inserted. A slot counts its pages and keeps the smallest
few fingerprints of its text, so after all pages are aligned it is known whether it is constant, which
makes it template, or varies, which makes it content. Siblings of one slot are told apart by their blocks of text:
a block that most different pages of the host have in the same slot is template too, wherever it stands
among its siblings and however many they are. Menus, headers, footers, sidebars, notices,
adverts, forms, scripts and reader comments are known by element, role and class; a page's article or
main element, where there is one, bounds the content.

Scale. Wrappers are partial aggregates: each task aligns the pages it reads, by host, and hands on one
small tree per host, so a host with a third of all pages is never gathered. Trees are merged in two
steps and hold a bounded number of slots. Pages of equal text count once for blocks, and blocks are
counted by host and fingerprint, in full. Pages get their host's wrapper by a join whose small side is
broadcast only if its measured size allows it.
"""

from __future__ import annotations

import functools
import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linecast.llm.decontam import bounded
from linecast.llm.scratch import table, written

#: A tag with its attributes; quoted values may hold ">". Anything else that starts like a tag is text.
TAG = re.compile(r"""<(?:!--|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]{0,9999}+"|'[^']{0,9999}+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|[!?][^>]*+>)""")
ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: An opening tag closes an open element of these, up to the nearest of the bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NOISE_TAGS = set("head script style noscript template nav footer aside form button select option textarea iframe svg canvas object dialog menu search audio video map noframes xmp".split())
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar"}
NOISE_NAMES = re.compile(r"(?:ad|ads|adbox|advert\w*|adsense|adsbygoogle|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|site-header|page-header|masthead|site-footer|page-footer|footer|cookies?|cookie-\w+|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|subscription|share|sharing|social|social-\w+|related|related-\w+|recommend\w*|comments?|comment-\w+|comments-\w+|comment_\w+|disqus\w*|replies|reply|respond|widget|toolbar|pagination|pager|skip-link|hidden|sr-only|visually-hidden|login|signup|search)", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
MAIN_NAMES = re.compile(r"(?:content|main|main-content|article|article-body|post|post-content|entry|entry-content|story|story-body)", re.I)
DEEPEST = 100  # elements nested deeper belong to the slot of their ancestor there; their text stays
SKETCH = 4  # fingerprints kept of a slot
SLOTS = 256  # children that a wrapper's slot may have; labels beyond become plain tags, then one slot


class Page:
    """Slots of a page and its blocks of text, in page order."""

    def __init__(self, source: str):
        self.label, self.parent, self.noise, self.main = ["#"], [-1], [False], [0]
        self.blocks: list[tuple[int, str, int]] = []  # slot, text, characters inside links
        self._text: list[str] = []
        self._links = 0
        self._read(source)

    def _flush(self, node: int) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((node, text, min(self._links, len(text))))
            self._text, self._links = [], 0

    def _read(self, s: str) -> None:
        # stack of (tag, slot, noise, is a link); inline elements keep the slot of their block
        stack = [("#", 0, False, False)]
        at, end = 0, len(s)
        lower = None
        while True:
            m = TAG.search(s, at)
            self._add(s[at : m.start() if m else end], stack[-1])
            if not m:
                break
            at = m.end()
            if m[0] == "<!--":
                at = s.find("-->", at)
                if at < 0:
                    break
                at += 3
                continue
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self._close(stack, tag)
                continue
            attrs = m[3] or m[6] or ""
            self._open(stack, tag, attrs)
            if tag in RAW and not attrs.endswith("/"):
                lower = s.lower() if lower is None else lower
                to = lower.find(f"</{tag}", at) if len(lower) == end else s.find(f"</{tag}", at)
                to = end if to < 0 else to
                if tag not in NOISE_TAGS and tag != "title":
                    self._add(s[at:to], stack[-1])
                at = to
        self._flush(stack[-1][1])

    def _add(self, raw: str, top) -> None:
        if raw and not top[2]:
            text = html.unescape(raw) if "&" in raw else raw
            self._text.append(text)
            if top[3]:
                self._links += len(text.strip())

    def _pop(self, stack, size: int) -> None:
        while len(stack) > size:
            tag, slot, _, _ = stack.pop()
            if tag in BLOCK:
                self._flush(slot)

    def _close(self, stack, tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                return self._pop(stack, k)
            if stack[k][0] in BLOCK and tag not in BLOCK:
                return None  # an inline end tag does not reach out of its block
        if tag == "p":
            self._flush(stack[-1][1])
        return None

    def _open(self, stack, tag: str, attrs: str) -> None:
        if tag in ("br", "wbr"):
            if tag == "br" and not stack[-1][2]:
                self._text.append(" ")
            return
        if tag in CLOSES:
            shut, bounds = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in bounds:
                    break
                if stack[k][0] in shut:
                    self._pop(stack, k)
                    if stack[-1][0] not in shut:
                        break
        elif tag in BLOCK:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    self._pop(stack, k)
                    break
                if stack[k][0] in BLOCK:
                    break
        _, slot, noise, link = stack[-1]
        names, role, hidden, body = self._names(attrs) if attrs.strip(" /") else ((), "", False, False)
        bad = hidden or tag in NOISE_TAGS or role in NOISE_ROLES or any(NOISE_NAMES.fullmatch(x) for x in names)
        if tag == "header" and not self.main[slot]:
            bad = True
        if tag in BLOCK:
            self._flush(slot)
            if len(stack) <= DEEPEST:
                plain = " ".join(sorted(x for x in names if not any(c.isdigit() for c in x)))
                self.label.append(f"{tag} {plain}".strip()[:80])
                self.parent.append(slot)
                self.noise.append(noise or bad)
                kind = 3 if tag == "article" or body else 2 if tag == "main" or role == "main" else 1 if any(MAIN_NAMES.fullmatch(x) for x in names) else 0
                self.main.append(max(self.main[slot], 0 if noise or bad else kind))
                slot = len(self.label) - 1
        if tag not in VOID and not (attrs.endswith("/") and tag not in BLOCK):
            stack.append((tag, slot, noise or bad, link or tag == "a"))

    @staticmethod
    def _names(attrs: str):
        names, role, hidden, body = [], "", False, False
        for k, a, b, c in ATTR.findall(attrs):
            k, v = k.lower(), a or b or c
            if k in ("class", "id"):
                names += v.split()
            elif k == "role":
                role = v.strip().lower()
            elif k == "hidden" or (k == "aria-hidden" and v.lower() == "true") or (k == "style" and HIDDEN.search(v)):
                hidden = True
            elif k == "itemprop":
                body = body or v.lower() == "articlebody"
        return names, role, hidden, body


# A wrapper node is a list: label, pages, pages with text, fingerprints, characters, characters in
# links, rank as main element, children.
LABEL, PAGES, TEXTS, PRINTS, CHARS, LINKS, MAIN, KIDS = range(8)


def tree(page: Page) -> tuple[list, list[list]]:
    """The page's wrapper and, for each of its slots, the wrapper node that stands for it."""
    kids: list[dict[str, list]] = []
    nodes: list[list] = []
    of: dict[int, int] = {}
    for slot, (label, parent) in enumerate(zip(page.label, page.parent, strict=True)):
        where = None if parent < 0 else kids[of[id(nodes[parent])]]
        if where is not None and label not in where and len(where) >= SLOTS:
            label = label.split(" ")[0] if label.split(" ")[0] in where or len(where) < 2 * SLOTS else "*"
        node = where.get(label) if where is not None else None
        if node is None:
            node = [label, 1, 0, [], 0, 0, 0, []]
            of[id(node)] = len(kids)
            kids.append({})
            if where is not None:
                where[label] = node
                nodes[parent][KIDS].append(node)
        node[MAIN] = max(node[MAIN], page.main[slot])
        nodes.append(node)
    texts: dict[int, tuple[list, list]] = {}
    for slot, text, links in page.blocks:
        node = nodes[slot]
        texts.setdefault(id(node), (node, []))[1].append(text)
        node[CHARS] += len(text)
        node[LINKS] += links
    for node, parts in texts.values():
        node[TEXTS] = 1
        node[PRINTS] = [xxhash.xxh64_intdigest("\n".join(parts)) >> 12]
    return nodes[0], nodes


def matched(a: list, b: list) -> int:
    """Simple tree matching: the most pairs of nodes of one label that keep order and ancestry."""
    if a[LABEL] != b[LABEL]:
        return 0
    return 1 + _table(a[KIDS], b[KIDS])[-1][-1]


def _table(x: list[list], y: list[list]) -> list[list[int]]:
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            best = max(t[i][j + 1], t[i + 1][j])
            if p[LABEL] == q[LABEL]:
                best = max(best, t[i][j] + matched(p, q))
            t[i + 1][j + 1] = best
    return t


def align(x: list[list], y: list[list]) -> list[tuple[list | None, list | None]]:
    """Both child lists as one sequence of matched pairs and of nodes that stand alone."""
    if [p[LABEL] for p in x] == [q[LABEL] for q in y]:
        return list(zip(x, y, strict=True))
    t, out = _table(x, y), []
    i, j = len(x), len(y)
    while i or j:
        if i and j and x[i - 1][LABEL] == y[j - 1][LABEL] and t[i][j] == t[i - 1][j - 1] + matched(x[i - 1], y[j - 1]):
            i, j = i - 1, j - 1
            out.append((x[i], y[j]))
        elif i and t[i][j] == t[i - 1][j]:
            i -= 1
            out.append((x[i], None))
        else:
            j -= 1
            out.append((None, y[j]))
    return out[::-1]


def merge(a: list, b: list) -> list:
    """Wrapper ``a`` with wrapper ``b`` (equal labels) aligned into it."""
    for k in (PAGES, TEXTS, CHARS, LINKS):
        a[k] += b[k]
    a[PRINTS] = sorted({*a[PRINTS], *b[PRINTS]})[:SKETCH]
    a[MAIN] = max(a[MAIN], b[MAIN])
    pairs = align(a[KIDS], b[KIDS])
    a[KIDS] = [merge(p, q) if p and q else p or q for p, q in pairs]
    if len(a[KIDS]) > 4 * SLOTS:  # labels that no two pages share; like ones are folded together
        by: dict[str, list] = {}
        for node in a[KIDS]:
            tag = node[LABEL].split(" ")[0]
            node[LABEL] = tag
            by[tag] = merge(by[tag], node) if tag in by else node
        a[KIDS] = list(by.values())
    return a


def wrapper(node: list, pages: int) -> list:
    """The compact wrapper ``[label, is template, children]``.

    A slot is template if its text is the same on all of at least three pages, four fifths of the
    host's, while other text of the main element varies; or, outside any main element, if most of its
    text is links."""
    varies = _varies(node)

    def run(n):
        const = n[TEXTS] >= 3 and 5 * n[TEXTS] >= 4 * pages and len(n[PRINTS]) == 1
        dense = not n[MAIN] and n[CHARS] > 0 and 10 * n[LINKS] > 6 * n[CHARS]
        return [n[LABEL], bool((const and varies) or dense), [run(k) for k in n[KIDS]]]

    return run(node)


def _varies(node: list, main: int | None = None) -> bool:
    main = _rank(node) if main is None else main
    return (node[MAIN] >= main and len(node[PRINTS]) > 1) or any(_varies(k, main) for k in node[KIDS])


def _rank(node: list) -> int:
    return max([node[MAIN], *(_rank(k) for k in node[KIDS])])


def block_keys(page: Page) -> list[int]:
    """Fingerprint of the path of labels and the text of each block, as signed 64 bits."""
    paths: list[int] = []
    for label, parent in zip(page.label, page.parent, strict=True):
        paths.append(xxhash.xxh64_intdigest(label, seed=paths[parent] if parent >= 0 else 0))
    return [(xxhash.xxh64_intdigest(text, seed=paths[slot]) ^ 1 << 63) - (1 << 63) for slot, text, _ in page.blocks]


def apply(page: Page, rule: list | None) -> str:
    """The page's blocks that lie in its main element, where it has one, and are no noise or template."""
    root, nodes = tree(page)
    template: set[int] = set()
    if rule is not None:
        todo = [(root, rule)]
        while todo:
            node, r = todo.pop()
            if r[1]:
                template.add(id(node))
            kids = [[k[0], k] for k in r[2]]
            names, own = [k[0] for k in kids], [k[LABEL] for k in node[KIDS]]
            if names == own:
                todo += [(n, k[1]) for n, k in zip(node[KIDS], kids, strict=True)]
            else:
                todo += _pair(node[KIDS], r[2])
    best = max((page.main[slot] for slot, _, _ in page.blocks if not page.noise[slot]), default=0)
    same = set(rule[3]) if rule is not None else set()
    keys = block_keys(page) if same else [0] * len(page.blocks)
    return "\n".join(
        text
        for (slot, text, _), key in zip(page.blocks, keys, strict=True)
        if not page.noise[slot] and page.main[slot] >= best and id(nodes[slot]) not in template and (not same or key not in same)
    )


def _pair(x: list[list], y: list[list]) -> list[tuple[list, list]]:
    """Children of a page's node and of its wrapper's node, aligned by simple tree matching."""
    def full(r):
        return [r[0], 0, 0, [], 0, 0, 0, [full(k) for k in r[2]], r]

    return [(p, q[8]) for p, q in align(x, [full(r) for r in y]) if p and q]


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


_PARTS = "host string, tree string, print long, keys array<long>"


def _induce(limit: int):
    """Trees of the hosts of a task's pages and, per page, the fingerprints of its text and of its blocks."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def made(hosts, trees, prints, keys):
            return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(trees, pa.string()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["host", "tree", "print", "keys"])

        def rows():
            none = [None] * len(held)
            out = made([*held], [json.dumps(v, separators=(",", ":")) for v in held.values()], none, none)
            held.clear()
            return out

        for batch in batches:
            hosts, prints, keys = [], [], []
            for host, text in zip(batch.column("host").to_pylist(), batch.column("__html"), strict=True):
                page = Page(text.as_py() or "")
                root, nodes = tree(page)
                own = block_keys(page)
                hosts.append(host)
                prints.append((xxhash.xxh64_intdigest(repr(own)) ^ 1 << 63) - (1 << 63))
                keys.append(list(dict.fromkeys(own)))
                size += len(nodes) if host not in held else 1
                held[host] = merge(held[host], root) if host in held else root
                if size > limit:
                    yield rows()
                    size = 0
            yield made(hosts, [None] * len(hosts), prints, keys)
        if held:
            yield rows()

    return run


def _same(part: DataFrame) -> DataFrame:
    """``(host, same)``: the blocks on at least three, and four fifths, of the host's different pages."""
    pages = part.where("tree IS NULL").groupBy("host", "print").agg(F.first("keys").alias("keys"))
    total = pages.groupBy("host").agg(F.count("*").alias("pages"))
    blocks = pages.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where("n >= 3")
    return blocks.join(total, "host").where("5 * n >= 4 * pages").groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("same"))


def _merge_trees(pdf: pd.DataFrame) -> pd.DataFrame:
    trees = sorted(pdf["tree"])
    out = functools.reduce(merge, map(json.loads, trees))
    return pd.DataFrame({"host": pdf["host"].iloc[:1], "tree": [json.dumps(out, separators=(",", ":"))]})


def _rules(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, same in zip(batch.column("tree").to_pylist(), batch.column("same").to_pylist(), strict=True):
            node = json.loads(text)
            out.append(json.dumps([*wrapper(node, node[PAGES]), (same or []) if _varies(node) else []], separators=(",", ":")))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.string())], names=["host", "rule"])


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html", limit: int = 500_000) -> DataFrame:
    """``(host, rule)``: the wrapper of every host, from all its pages. ``limit``: slots a task holds."""
    src = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("__html")).where(F.col("__html").isNotNull())
    part = written(src.mapInArrow(_induce(limit), _PARTS), "trees")
    some = part.where("tree IS NOT NULL").select("host", "tree").withColumn("deal", F.pmod(F.xxhash64("tree"), F.lit(16))).groupBy("host", "deal").applyInPandas(_merge_trees, "host string, tree string")
    whole = some.groupBy("host").applyInPandas(_merge_trees, "host string, tree string")
    return written(whole.join(_same(part), "host", "left").mapInArrow(_rules, "host string, rule string"), "wrappers")


def _extract(batches) -> Iterator[pa.RecordBatch]:
    parsed: dict[str, list] = {}
    for batch in batches:
        out = []
        for text, rule in zip(batch.column("__html"), batch.column("rule").to_pylist(), strict=True):
            if rule is not None and rule not in parsed:
                if len(parsed) > 1000:
                    parsed.clear()
                parsed[rule] = json.loads(rule)
            out.append(apply(Page(text.as_py() or ""), parsed.get(rule)))
        names = [c for c in batch.schema.names if c not in ("__html", "rule")]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(out, pa.string())], names=[*names, "text"])


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Columns ``keep`` and ``text``, the main text, of every row of ``pages``.

    Blocks are joined by one line feed, white space inside a block is one space, character references
    are decoded. Hosts with one page have no constant slots; their pages are read by element, role and
    class alone.

    * null and empty html: empty text; plain text without tags is one block;
    * null or malformed url: all such pages form one host (the empty name);
    * repeated rows and ids: each row is extracted on its own; pages that are all alike keep their text,
      since constant text is template only next to text that varies;
    * unclosed and misnested elements, comments and scripts end where a browser would end them or at
      the page's end; elements nested over 100 deep belong to their ancestor there;
    * other columns are ignored, whatever their names.
    """
    rules = induce(pages, url_col, html_col).select(F.col("host").alias("__host"), "rule")
    src = pages.select(*[F.col(c) for c in keep], F.col(html_col).alias("__html"), host_of(F.col(url_col)).alias("__of"))
    rules = bounded(rules, F.length("rule") + F.length("__host") + 16)
    met = src.join(rules, F.col("__of") == F.col("__host"), "left").select(*keep, "__html", "rule")
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return met.mapInArrow(_extract, f"{fields}, text string")


def op1_wrapper_extraction(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole pages table."""
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
