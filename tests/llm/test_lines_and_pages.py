from __future__ import annotations

import random
import re
import time
from html.parser import HTMLParser

from parchmint.llm import html_main, neighbours
from parchmint.llm.html_main import common_subsequence, main_lines, main_text, page_lines
from parchmint.llm.line_dedup import drop_spread_lines
from parchmint.llm.neighbours import with_successor
from parchmint.llm.simhash import edited_likeness
from tests.llm.conftest import documents


def brute(rows, least):
    sites, first = {}, {}
    for i, t, s in rows:
        for p, line in enumerate(t.split("\n")):
            if re.search("[^\x20\x09-\x0d]", line):
                sites.setdefault(line, set()).add(s)
                first[line] = min(first.get(line, (i, p)), (i, p))
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if len(sites.get(x, ())) < least or first[x] == (i, p)) for i, t, _ in rows}


def test_lines_equal_brute_force(spark):
    rng = random.Random(1)
    texts = ["\n".join(rng.choice([*(f"common {k}" for k in range(6)), f"own {i} {j}", "", "  "]) for j in range(rng.randrange(1, 9))) for i in range(120)]
    sources = [f"s{rng.choice([0, 0, 0, *range(12)])}" for _ in texts]
    for least in (3, 5, 11):
        got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in drop_spread_lines(documents(spark, texts, sources), min_sites=least).collect()}
        want = brute(list(zip(range(len(texts)), texts, sources, strict=True)), least)
        assert got == {i: (want[i], len(t.split("\n")), len(t.split("\n")) - (len(want[i].split("\n")) if want[i] or got[i][1] > got[i][2] else 0)) for i, t in enumerate(texts)}


def test_awkward_lines(awkward, empty):
    rows = drop_spread_lines(awkward, min_sites=2).collect()
    assert len(rows) == awkward.count() and {r.id for r in rows} == {"x"}
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[0][0].text is None and by[0][0].n_lines == 0 and by[None][0].text == "text of no id"
    assert [r.n_removed for r in by[5]] == [0, 0] and by[6][0].text == "" and by[6][0].n_removed == 1
    assert drop_spread_lines(empty).count() == 0


def test_common_subsequence_is_longest(monkeypatch):
    monkeypatch.setattr(html_main, "TABLE_BITS", 30)
    rng = random.Random(2)
    for n in [9] * 200 + [300] * 3:
        a, b = ([rng.choice("abcd" if n < 10 else "ab") for _ in range(rng.randrange(n // 2, n))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        for find in (common_subsequence, html_main._by_bits):
            found = sorted(find(a, b))
            assert len(found) == table[-1][-1]
            rest = iter(b)
            assert all(a[i] in rest for i in found)


def test_long_and_broken_pages_take_linear_time():
    begun = time.process_time()
    for part in ("<a ", "<a href='x", '<a b="', "<i>", "</b>", "<i></b>", "<p>x", "<b><article><i></b>", "<!--", "</", "<script ", "<a  =  ", "<div class=ad>", "= '"):
        page_lines(part * (1_000_000 // len(part)))
    page_lines("<b><article>" + "<i>" * 200_000 + "</b>" * 200_000)
    assert len(common_subsequence(["x", "y"] * 4000, ["x"] * 9000)) == 4000
    assert time.process_time() - begun < 60


def test_repeated_rows_and_clashing_columns(spark):
    page = "<body><div>Menu</div><p>Story {0}</p></body>"
    schema = "page_id long, url string, html string, id string, text int, host string, path string, tie string, n_chars int"
    rows = [(i, f"http://h/{i}", page.format(i), "x", 1, "no", "no", "t", 0) for i in (1, 2, 2, 2, 3)] + [(4, "", "<p>none", "x", 1, None, None, None, 0), (5, "http://h/9", "<p>" + "long word " * 200_000, "x", 1, "", "", "", 0)]
    got = sorted((r.id, r.text) for r in main_text(spark.createDataFrame(rows, schema)).collect())
    assert got[:6] == [(1, "Story 1"), (2, "Story 2"), (2, "Story 2"), (2, "Story 2"), (3, "Story 3"), (4, "none")] and len(got[6][1]) == 1_999_999


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href=/>Site</a></header><nav><ul><li>Home</ul></nav><div class="ad">Buy</div><div id="cookie-notice">We use cookies</div>
{open}<h1>Head&nbsp;line {n}</h1><p><b>Bold</b>ly &amp; &#8364;{n}<br>next   line<p>Second <i>one</i></p><form><input>Search</form><div class="comments"><p>First!</p></div>{close}
<aside>Side</aside><!-- no --><footer>&copy; all</footer></body></html>"""


def test_main_text_of_an_article(spark):
    html = PAGE.format(open="<article>", close="</article>", n=1)
    rows = spark.createDataFrame([(1, "http://a.b/x/1", html), (2, "http://a.b/x/2", PAGE.format(open="<article>", close="</article>", n=2)), (3, None, None), (None, "http://a.b/x", "")], "page_id long, url string, html string")
    got = {r.id: (r.text, r.n_chars) for r in main_text(rows).collect()}
    want = "Head line 1 Boldly & €1 next line Second one"
    assert got == {1: (want, len(want)), 2: (want.replace("1", "2"), len(want)), 3: ("", 0), None: ("", 0)}


def test_shared_lines_go_where_no_article_is_marked(spark):
    page = "<body><div>Menu one</div><div>Menu two</div><p>Story {0} alone</p><p>More of {0}</p><div>All rights</div></body>"
    urls = [("http://h/a/1", 1), ("http://h/a/2", 2), ("http://h/a/3", 3), ("http://other/a/1", 4)]
    rows = spark.createDataFrame([(i, u, page.format(i)) for u, i in urls] + [(5, "http://copy/1", page.format(9)), (6, "http://copy/2", page.format(9))], "page_id long, url string, html string")
    got = {r.id: r.text for r in main_text(rows).collect()}
    assert got[1] == "Story 1 alone More of 1" and got[2] == "Story 2 alone More of 2"
    assert got[5] == got[6] == "Menu one Menu two Story 9 alone More of 9 All rights"


class Articles(HTMLParser):
    """A plain reading of the given pages, which mark one article each."""

    def __init__(self):
        super().__init__()
        self.depth, self.skip, self.lines = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skip += tag in ("script", "style")
        if tag in ("article", "p", "h1", "br", "li", "div"):
            self.lines.append("")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.skip -= tag in ("script", "style")
        if tag in ("article", "p", "h1", "li", "div"):
            self.lines.append("")

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.lines[-1] += data


def test_given_pages_equal_a_plain_reading(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.id: r.text for r in main_text(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    for r in pages:
        reader = Articles()
        reader.feed(r.html or "")
        assert got[r.page_id] == " ".join(x for x in (" ".join(line.split()) for line in reader.lines) if x)


def test_malformed_pages_keep_their_blocks():
    text = [x for x, _, furniture in page_lines("<p><b>one<br><p>two<li>three</ul>four<td>five &lt;x&gt; <script>no</script") if not furniture]
    assert text == ["one", "two", "three", "four", "five <x>"]
    assert page_lines("<" * 2000) and page_lines("") == []


def test_pages_do_not_depend_on_partitions(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = sorted((r.id, r.text, r.n_shared) for r in main_text(pages).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert sorted((r.id, r.text, r.n_shared) for r in main_text(pages).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert main_text(pages.limit(0)).count() == 0


def test_successors_with_and_without_wrap(spark):
    def pair(rows, following):
        return [{"id": r["id"], "next": f["id"] if f else None} for r, f in zip(rows, following, strict=True)]

    df = spark.createDataFrame([(i * 3 % 101, "t" * (i % 5)) for i in range(101)], "id long, text string")
    for wrap, last in ((False, None), (True, 0)):
        got = {r.id: r.next for r in with_successor(df, ["id"], "text", pair, "id long, next long", wrap).collect()}
        assert got == {i: i + 1 if i < 100 else last for i in range(101)}


def test_unmarked_pages_look_on_both_sides_and_past_copies(spark):
    page = "<body><div>Menu one</div><div>Menu two</div><p>Story {0} alone</p><p>More of {0}</p><div>All rights</div></body>"
    large = "<body>" + "".join(f"<div>A long entry of the menu {k}</div>" for k in range(20)) + "<p>Text {0}</p></body>"
    rows = [("http://h/a/1", page.format(1)), ("http://h/a/2", page.format(2)), *((f"http://c/{k:03}", page.format(1 if k < 60 else 2)) for k in range(61)), *((f"http://m/{k}", large.format(k)) for k in range(5))]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = {}
    for partitions in ("1", "4", "40"):  # cuts inside the group of copies change nothing
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            got[partitions] = {r.url: r.text for r in main_text(df).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got["1"] == got["4"] == got["40"] and len(got["1"]) == len(rows)
    for url, html in rows:
        number = re.search(r"(?:Story|Text) (\d+)", html)[1]
        assert got["1"][url] == (f"Text {number}" if "//m/" in url else f"Story {number} alone More of {number}"), url


def test_short_lines_of_all_articles_nearby_go(spark):
    page = "<body><article><h1>Head {0}</h1><p>Share this story</p><p>Story {0} alone {1}</p>{2}</article></body>"
    quote = "<p>A quoted passage</p>"
    rows = [(k, f"http://h/{k}", page.format(k, k * k, quote if k in (2, 3) else "")) for k in range(6)]
    rows += [(10 + k, f"http://few/{k}", page.format(k, k, "")) for k in range(4)]
    rows += [(20 + k, f"http://copies/{k}", f"<article><p>One long text that all versions have</p><p>Share this</p><p>v{k}</p></article>") for k in range(7)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumnRenamed("id", "page_id").collect()}
    for k in range(6):
        assert got[k] == f"Head {k} Story {k} alone {k * k}" + (" A quoted passage" if k in (2, 3) else "")
    assert got[10] == "Head 0 Share this story Story 0 alone 0"
    assert got[23] == "One long text that all versions have Share this v3"


def test_names_of_wrappers_and_titles_lose_no_article():
    def text(html):
        return " ".join(main_lines(page_lines(html), [], [])[0])

    assert text('<div class="layout has-sidebar"><article><p>Body</p></article><div class="sidebar">Side</div></div>') == "Body"
    assert text('<div class="sidebar-layout"><article><p>Body</p></article></div><div class="layout-sidebar">Side</div>') == "Body"
    assert text('<article><p>Body</p></article><div class="related-posts"><article>Teaser</article></div>') == "Body"
    assert text('<aside><article>Teaser</article></aside><p>Body</p>') == "Body"
    assert text('<article><h1 class="entry-header">T</h1><div class="post-header">By A</div><p>Body</p></article>') == "T By A Body"
    assert text('<main><h1>T</h1><p>The whole body</p><article class="card">teaser</article></main>') == "T The whole body teaser"
    assert text('<main>Filed here<article><p>The whole body of it</p></article></main>') == "The whole body of it"


def test_ranges_decide_no_result_and_are_bounded(spark, sf, monkeypatch):
    """Ten times as many ranges give the same rows, and their number does not grow beyond its bound."""
    docs, pages = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/pages.parquet")

    def results():
        return sorted(map(repr, edited_likeness(docs).collect())), sorted(map(repr, main_text(pages).collect()))

    few = results()
    monkeypatch.setattr(neighbours, "RANGE_ROWS", 5)
    assert neighbours._ranges(spark, 200) == 40 and results() == few
    assert neighbours._ranges(spark, 10**12) == neighbours.MOST_RANGES
    monkeypatch.setattr(neighbours, "MOST_RANGES", 3)
    assert neighbours._ranges(spark, 10**12) == 3 and results() == few
