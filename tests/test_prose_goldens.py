"""Paragraphs, hyphens, headings, chunks, names and HTML blocks."""

from corpusloom.functions.text import slug
from corpusloom.operators import prose
from corpusloom.sources.html import html_blocks

LINE = "doc_id long, n long, text string"


def joined(spark, texts, evidence=()):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], LINE)
    seen = prose.compounds(spark.createDataFrame([(1, i, t) for i, t in enumerate([*texts, *evidence])], LINE))
    return prose.join_lines(prose.bridge(lines, seen, ["doc_id"], ["n"]), ["doc_id"], "n").first().text


def test_hyphens(spark):
    assert joined(spark, ["infor-", "mation"]) == "information"
    assert joined(spark, ["well-", "known"], ["a well-known fact"]) == "well-known"
    assert joined(spark, ["anti-", "American"]) == "anti-American"
    assert joined(spark, ["plain", "words"]) == "plain words"
    assert joined(spark, ["year 19-", "20"]) == "year 19- 20"


def paragraph_starts(spark, lines, align="left"):
    rows = [(1, i, float(x0), float(x1), 10.0, align) for i, (x0, x1) in enumerate(lines)]
    df = spark.createDataFrame(rows, "b long, i long, x0 double, x1 double, size double, align string")
    got = prose.paragraphs(df, ["b"], ["i"]).orderBy("i").collect()
    return [r.para for r in got]


def test_indent_starts_a_paragraph(spark):
    assert paragraph_starts(spark, [(0, 100), (0, 100), (12, 100), (0, 100)]) == [0, 0, 1, 1]


def test_hanging_indent_does_not(spark):
    assert paragraph_starts(spark, [(0, 100), (12, 100), (12, 100), (0, 100)]) == [0, 0, 1, 1]
    assert paragraph_starts(spark, [(0, 100), (12, 100), (12, 100), (12, 100), (12, 100)]) == [0, 0, 0, 0, 1]


def test_short_line_ends_a_justified_paragraph(spark):
    assert paragraph_starts(spark, [(0, 100), (0, 60), (0, 100)], "justify") == [0, 0, 1]
    assert paragraph_starts(spark, [(0, 100), (0, 60), (0, 100)], "center") == [0, 0, 0]


ITEM = "doc_id long, item long, tag string, text string, sheets long"


def chunks(spark, items, sheets=1):
    df = spark.createDataFrame([(1, i, tag, "x" * n, sheets) for i, (tag, n) in enumerate(items)], ITEM)
    return [r.chunk for r in prose.chunk(df).orderBy("item").collect()]


def test_chunk_overruns_by_one_item(spark):
    assert chunks(spark, [("p", 39_999), ("p", 2), ("p", 10)]) == [1, 1, 2]
    assert chunks(spark, [("p", 40_000), ("p", 1), ("p", 1)]) == [1, 1, 2]


def test_headings_open_chunks_unless_there_are_too_many(spark):
    assert chunks(spark, [("h1", 5), ("p", 5), ("h1", 5)], sheets=2) == [1, 1, 2]
    assert chunks(spark, [("h1", 5), ("p", 5), ("h1", 5)], sheets=1) == [1, 1, 1]


def test_toc_links(spark):
    items = [(1, 0, "h1", "One", 9), (1, 1, "p", "x", 9), (1, 2, "h1", "Two", 9), (2, 0, "p", "x", 9)]
    titles = spark.createDataFrame([(1, "A"), (2, "B")], "doc_id long, title string")
    got = prose.toc(prose.chunk(spark.createDataFrame(items, ITEM)), titles).orderBy("doc_id", "entry").collect()
    assert [(r.href, r.label) for r in got] == [("c001.xhtml", "One"), ("c002.xhtml", "Two"), ("c001.xhtml", "B")]


def test_stitch_needs_the_next_sheet_and_an_open_sentence(spark):
    rows = [(1, 0, 1, "p", "it did not"), (1, 1, 2, "p", "stop here."), (1, 2, 2, "p", "next one"), (1, 3, 4, "p", "far away"), (1, 4, 5, "p", "Capital")]
    items = spark.createDataFrame(rows, "doc_id long, seq long, page long, tag string, text string")
    got = [(r.page, r.text) for r in prose.stitch(items, prose.compounds(items)).orderBy("item").collect()]
    assert got == [(2, "it did not stop here."), (2, "next one"), (4, "far away"), (5, "Capital")]


def test_unique_names_skip_a_spelled_out_suffix(spark):
    labels = ["Name", "Name 2", "Name", "Name", "!!"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(labels)], "doc_id long, n long, label string")
    got = [r.name for r in prose.unique_names(df, "doc_id", "n", "label", slug("label")).orderBy("n").collect()]
    assert got == ["name", "name_2", "name_3", "name_4", "field"]


def test_furniture_thresholds(spark):
    def kept(sheets):
        rows = [(1, s, i, 2, t) for s, lines in enumerate(sheets) for i, t in enumerate(lines)]
        df = spark.createDataFrame(rows, "source long, doc_id long, line_no long, n_lines long, line string")
        return prose.drop_furniture(df, prose.edge_lines(df), "source", "doc_id", "line").count()

    assert kept([["Page 1 of 9", "a"]]) == 2
    assert kept([["Page 1 of 9", "a"], ["Page 2 of 9", "b"]]) == 2
    assert kept([["Page 1", "a"], ["Page 2", "b"], ["other", "c"]]) == 6
    assert kept([["Page 1", "a"], ["Page 2", "b"], ["Page 3", "c"], ["other", "d"]]) == 5


HTML = """<html><head><title>t</title></head><body><header><h1>Ada   Lovelace</h1></header><nav>skip</nav><script>x()</script>
<p>one<br>two &amp; three<p>implicit close<ol start=3><li>c<li value=7>g<ul><li>deep</ul><li>h</ol>
<blockquote><p>quoted</blockquote><pre>
 a
  b
</pre><hr><table><tr><td>x<td>y</tr></table></body></html>"""


def test_html_blocks(spark):
    dot, bullet = chr(0xB7), chr(0x2013)
    got = html_blocks(spark.createDataFrame([(1, HTML)], "page_id long, html string")).orderBy("seq").collect()
    assert [tuple(r)[2:] for r in got] == [
        ("h1", "Ada Lovelace", 0, False, None), ("p", "one\ntwo & three", 0, False, None), ("p", "implicit close", 0, False, None),
        ("li", "c", 1, False, "3."), ("li", "g", 1, False, "7."), ("li", "deep", 2, False, bullet), ("li", "h", 1, False, "8."),
        ("p", "quoted", 1, True, None), ("pre", " a\n  b", 0, False, None), ("rule", "", 0, False, None), ("p", f"x {dot} y", 0, False, None)]
