"""Op 1: wrapper induction on hand-made sites."""

from linecast.llm import wrapper as W

SCHEMA = "page_id long, url string, html string, text string, host string"


def run(spark, rows):
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], SCHEMA)
    return {r.page_id: r.text for r in W.extract(df).collect()}


def page(k, body, side="", foot=""):
    return f"""<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head>
    <body><nav><ul><li><a href="/x">Menu {k}</a></li></ul></nav><div class="ad">buy {k}</div><!-- <p>no</p> -->
    {body}<aside>side {k}</aside>{side}<form>mail <input></form><footer>&copy; {k}</footer></body></html>"""


def test_article_blocks_in_order(spark):
    body = "<article><h1>Head &amp; more</h1><p><b>One\n two <i>three</i>.<br><p>A &lt;b&gt; &#233;<script>x()</script>!</p><ul><li>i<li>ii</ul><div class='comments'><p>reader</p></div><footer>foot</footer></article>"
    got = run(spark, [(1, "http://a.example/1", page(1, body))])
    assert got[1] == "Head & more\nOne two three.\nA <b> é!\ni\nii"


def test_without_article_constant_slots_are_template(spark):
    def body(k):
        return f"<div class='top'>Our great site</div><div class='story-{k}'><h2>Title {k}</h2><p>Text {k} here.</p></div><div class='legal'>All rights reserved</div><div class='more'><a href='/'>Read {k}</a></div>"

    got = run(spark, [(k, "https://User@Site.example:80/p?q", page(k, body(k))) for k in range(5)])
    for k in range(5):
        assert got[k] == f"Title {k}\nText {k} here."


def test_pages_that_are_all_alike_keep_their_text(spark):
    body = "<article><h1>Same</h1><p>text</p></article>"
    got = run(spark, [(k, "http://copy.example/", page(0, body)) for k in range(6)])
    assert set(got.values()) == {"Same\ntext"}


def test_constant_slot_in_varying_article_is_template(spark):
    got = run(spark, [(k, "http://c.example/", page(k, f"<article><h1>Head {k}</h1><p>text {k}</p><blockquote>Sign our letter</blockquote></article>")) for k in range(5)])
    assert got[3] == "Head 3\ntext 3"


def test_edges(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    wide = "".join(f"<div class='c{chr(97 + k % 26)}{chr(97 + k // 26)}'><p>x{k}</p></div>" for k in range(600))
    rows = [
        (1, None, None), (2, "", ""), (3, "not a url", "just text &amp; more"), (4, "http://e.example", "<p>open <b>bold"), (5, "http://e.example", "a <b c < d > e"),
        (6, "http://e.example", deep), (7, "http://w.example", wide), (8, "http://e.example", "<!-- never closed <p>x</p>"), (9, "http://e.example", "<p title='a>b'>q</p><script>x"),
        (9, "http://e.example", "<p title='a>b'>q</p><script>x"), (10, "http://l.example", "<article>" + "<p>long words</p>" * 20_000 + "</article>"),
    ]
    got = run(spark, rows)
    assert got[1] == got[2] == "" and got[3] == "just text & more" and got[4] == "open bold"
    assert got[6] == "deep" and got[7].count("\n") == 599 and got[8] == "" and got[9] == "q"
    assert got[10].count("long words") == 20_000
    assert run(spark, []) == {}


def test_matching_is_the_greatest_common_tree():
    def n(label, *kids):
        return [label, 1, 0, [], 0, 0, 0, list(kids)]

    a = n("body", n("nav"), n("div", n("h1"), n("p")), n("footer"))
    b = n("body", n("div", n("h1"), n("p"), n("table")), n("aside"), n("footer"))
    assert W.matched(a, b) == 5
    merged = W.merge(a, b)
    assert [k[W.LABEL] for k in merged[W.KIDS]] == ["nav", "div", "aside", "footer"]
    assert [k[W.PAGES] for k in merged[W.KIDS]] == [1, 2, 1, 2]


def test_constant_siblings_without_names_are_template(spark):
    def body(k):
        return f"<div><p>Our great site</p></div><div><h2>Title {k}</h2><p>Text {k} here.</p></div><div><p>All rights reserved</p></div>"

    got = run(spark, [(k, "https://plain.example/", page(k, body(k))) for k in range(5)])
    assert got == {k: f"Title {k}\nText {k} here." for k in range(5)}


def test_constant_paragraph_among_varying_ones_is_template(spark):
    def body(k):
        ps = [f"<p>text {k} {j}</p>" for j in range(2 + k)]
        ps.insert(k % 3, "<p>Support our work</p>")
        return f"<article><h1>Head {k}</h1>{''.join(ps)}</article>"

    got = run(spark, [(k, "http://p.example/", page(k, body(k))) for k in range(6)])
    assert got == {k: "\n".join([f"Head {k}", *(f"text {k} {j}" for j in range(2 + k))]) for k in range(6)}


def test_copies_of_a_page_count_once(spark):
    rows = [(k, "http://n.example/", page(0, "<article><h1>Same</h1><p>text</p></article>")) for k in range(8)]
    got = run(spark, [*rows, (8, "http://n.example/", page(0, "<article><h1>Other</h1><p>words</p></article>"))])
    assert got[0] == "Same\ntext" and got[8] == "Other\nwords"
