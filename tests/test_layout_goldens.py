"""Hand-made pages carrying the failures the grouping rules exist to prevent."""

from pyspark.sql import functions as F

from corpusloom.operators import layout
from corpusloom.plans.pipelines import page_lines

RUN = "doc_id long, page_no long, row_no long, run_no long, text string, x double, w double, baseline double, size double, angle double"


def blocks(spark, runs):
    """Text of each block of a one-page document, lines joined by a space."""
    rows = [(1, 1, 0, i, t, float(x), float(w), float(b), float(s), float(a)) for i, (t, x, w, b, s, a) in enumerate(runs)]
    lines = page_lines(spark.createDataFrame(rows, RUN)).collect()
    out = {}
    for r in sorted(lines, key=lambda r: (r.block, r.baseline, r.x0)):
        out.setdefault(r.block, []).append(r.text)
    return [" ".join(t.strip() for t in ts) for ts in out.values()]


def together(found, *phrases):
    return any(all(p in b for p in phrases) for b in found)


def test_two_columns_stay_apart(spark):
    runs = [(f"left {i}", 50, 200, 100 + 14 * i, 11, 0) for i in range(5)] + [(f"right {i}", 320, 200, 100 + 14 * i, 11, 0) for i in range(5)]
    found = blocks(spark, runs)
    assert not any("left" in b and "right" in b for b in found)


def test_label_and_value_stay_apart(spark):
    found = blocks(spark, [("Languages", 50, 60, 100, 11, 0), ("JavaScript, Dart", 160, 90, 100, 11, 0),
                           ("Backend", 50, 50, 114, 11, 0), ("Node", 160, 30, 114, 11, 0)])
    assert not together(found, "Languages", "JavaScript")


def test_tracked_heading_reads_as_words(spark):
    letters = [(c, 50 + 9 * i, 6, 100, 11, 0) for i, c in enumerate("WORK HISTORY") if c != " "]
    assert blocks(spark, letters) == ["WORK HISTORY"]


def test_heading_is_not_its_body(spark):
    found = blocks(spark, [("A Large Heading", 50, 200, 100, 24, 0), ("body text follows", 50, 200, 122, 11, 0), ("and goes on here", 50, 195, 136, 11, 0)])
    assert not together(found, "Large", "body") and together(found, "body", "goes on")


def test_bullets_are_separate_blocks(spark):
    marks = ["- one", chr(0x2022) + " two", "3. three", "(4) four", "* five"]
    assert len(blocks(spark, [(m, 50, 80, 100 + 14 * i, 11, 0) for i, m in enumerate(marks)])) == 5


def test_wrapped_paragraph_is_one_block(spark):
    found = blocks(spark, [("Product engineer who ships", 50, 220, 100, 11, 0), ("across the whole stack", 50, 200, 114, 11, 0)])
    assert together(found, "ships", "across")


def test_turned_run_joins_nothing(spark):
    found = blocks(spark, [("upright one", 50, 80, 100, 11, 0), ("sideways", 50, 80, 107, 11, -90), ("upright two", 50, 80, 114, 11, 0)])
    assert "sideways" in found and together(found, "one", "two")


def test_row_compares_with_its_anchor(spark):
    """Baselines drift 3, 6, 9: the last is too far from the first run, though near its neighbour."""
    rows = [(1, 1, 0, i, "w", 10.0 * i, 5.0, 100.0 + 3 * i, 20.0, 0.0) for i in range(4)]
    got = layout.group_rows(spark.createDataFrame(rows, RUN)).orderBy("run_no").select("row").collect()
    assert [r.row for r in got] == [0, 0, 0, 1]


def test_lower_median(spark):
    df = spark.createDataFrame([(1, v) for v in (4, 1, 3, 2)], "k int, v int")
    assert df.groupBy("k").agg(layout.lower_median("v").alias("m")).first().m == 2


def test_reading_order_falls_back_when_a_block_is_unmatched(spark):
    b = spark.createDataFrame([(1, 1, 0, 5.0, 10.0), (1, 1, 1, 5.0, 20.0), (1, 2, 0, 5.0, 10.0), (1, 2, 1, 9.0, 20.0)],
                              "doc_id long, page_no long, block long, x0 double, baseline double")
    c = spark.createDataFrame([(1, 1, 5.0, 10.0, 7), (1, 1, 5.0, 20.0, 3), (1, 2, 5.0, 10.0, 7)],
                              "doc_id long, page_no long, x double, baseline double, idx long")
    got = {(r.page_no, r.block): r.sort_key for r in layout.reading_order(b, c).collect()}
    assert got == {(1, 0): 7, (1, 1): 3, (2, 0): 0, (2, 1): 1}


def test_alignment_classes(spark):
    def line(k, i, x0, x1):
        return (k, i, float(x0), float(x1), 10.0 * i, 10.0)

    rows = ([line("justify", i, 0, 100 if i < 3 else 40) for i in range(4)] + [line("center", i, 30 * i, 200 - 30 * i) for i in range(3)]
            + [line("right", i, 40 * i, 200) for i in range(3)] + [line("left", i, 0, 100 + 50 * i) for i in range(3)] + [line("one", 0, 0, 9)])
    df = spark.createDataFrame(rows, "k string, i int, x0 double, x1 double, baseline double, size double")
    want = {"justify": "justify", "center": "center", "right": "right", "left": "left", "one": "left"}
    assert {r.k: r.align for r in layout.block_shape(df, ["k"], "i").collect()} == want
    assert {(r.k, r.align) for r in layout.with_align(df, ["k"], "i").select("k", "align").distinct().collect()} == set(want.items())


def test_merge_rects_follows_the_running_median(spark):
    """A tall glyph must not widen the line's band into the next line."""
    from corpusloom.operators.geometry import merge_rects

    rows = [(1, 0, 100, 20, 10), (1, 25, 95, 5, 30), (1, 40, 100, 30, 10), (1, 0, 114, 50, 10)]
    df = spark.createDataFrame(rows, "page long, x long, y long, w long, h long")
    got = [tuple(r)[1:] for r in merge_rects(df, ["page"]).orderBy("line").collect()]
    assert len(got) == 2 and got[1][1:] == (0, 114, 50, 10)


def _bytes(spark, raw):
    from corpusloom.sources import html

    rows = spark.createDataFrame([(i, b) for i, b in enumerate(raw)], "page_id long, raw binary").withColumn("charset", html.pick_charset("raw"))
    return [(r.charset, r.text) for r in rows.select("page_id", "charset", html.decode_html("raw", F.col("charset")).alias("text")).orderBy("page_id").collect()]


def test_declared_charsets(spark):
    def page(name, text):
        return f'<html><head>{" " * 3000}<meta charset="{name}"></head><body>{text}</body></html>'

    cases = [("windows-1251", "Привет"), ("shift_jis", "日本語テスト"), ("gb18030", "中文"), ("iso-8859-2", "Łódź"), ("koi8-r", "мир")]
    for (name, text), (charset, got) in zip(cases, _bytes(spark, [page(n, t).encode(n) for n, t in cases])):
        assert charset == name and text in got
    unknown, cyrillic = _bytes(spark, [page("no-such-name", "é").encode("latin1"), page("zip", "plain").encode()])
    assert unknown[0] == "no-such-name" and "é" in unknown[1]
    assert "plain" in cyrillic[1]


def test_pages_of_the_web(spark):
    from corpusloom.sources import html

    pages = ['<ol start="1e999"><li>a<li value="inf">b<li value="nan">c</ol>', '<ol start="-2"><li>x</ol>', None, "<p>fine"]
    rows = html.html_blocks(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).collect()
    assert {r.page_id for r in rows} >= {0, 1, 3}
    assert [r.text for r in rows if r.page_id == 0] == ["a", "b", "c"] and not [r for r in rows if r.kind == "error"]


def test_counters_and_padding_keep_every_digit(spark):
    from corpusloom.functions.numerals import letters
    from corpusloom.operators.prose import zero_padded

    n = 9_000_000_000_000_000_000
    want, left = "", n
    while left:
        left, r = divmod(left - 1, 26)
        want = chr(97 + r) + want
    row = spark.range(1).select(letters(F.lit(n)).alias("l"), F.lit(1000).alias("k"), F.lit(7).alias("j")).select("l", zero_padded("k", 3).alias("k"), zero_padded("j", 3).alias("j")).first()
    assert tuple(row) == (want, "1000", "007")


def test_pages_without_blocks_lists_or_ends(spark):
    from corpusloom.sources import html

    pages = ["plain", "", "<nav>x", "<![CDATA[ <![if", "<hr>", "<ul>x<li>a</ul>b", "<pre>\n a\n</pre>c", "<blockquote>q</blockquote>", "<ol start=0><li value=0>z<ul><li>y</ul><li value=4>w<li>v"]
    want = {0: [("p", "plain", 0, False, None)], 3: [("p", "<![CDATA[ <![if", 0, False, None)], 4: [("rule", "", 0, False, None)],
            5: [("p", "x", 1, False, None), ("li", "a", 1, False, "•"), ("p", "b", 0, False, None)],
            6: [("pre", " a", 0, False, None), ("p", "c", 0, False, None)], 7: [("p", "q", 0, False, None)],
            8: [("li", "z", 1, False, "1."), ("li", "y", 2, False, "–"), ("li", "w", 1, False, "4."), ("li", "v", 1, False, "5.")]}
    for some in [pages, *[[p] for p in pages]]:  # in one slice and alone
        rows = html.html_blocks(spark.createDataFrame([(i, p) for i, p in enumerate(pages) if p in some], "page_id long, html string").coalesce(1)).orderBy("page_id", "seq").collect()
        for i, p in enumerate(pages):
            assert [tuple(r)[2:] for r in rows if r.page_id == i] == (want.get(i, []) if p in some else [])


def test_nesting_costs_in_proportion(spark):
    from time import perf_counter

    from corpusloom.sources import html

    def seconds(n):
        page = "<table><td><p>" + "<div><p>x" * n
        began = perf_counter()
        assert html.html_blocks(spark.createDataFrame([(1, page)], "page_id long, html string")).count() == n
        return perf_counter() - began

    seconds(10)
    assert seconds(80_000) < 5 * seconds(20_000) + 2


def test_charset_of_the_first_meta_that_names_one(spark):
    metas = [("<META name=x><meta http-equiv='Content-Type' content='text/html; charset=Windows-1251'>", "windows-1251"), ("<meta charset = koi8-r />", "koi8-r"),
             ("<meta charset='utf8'><meta charset=koi8-r>", "utf-8"), ("<meta content='text/html'>", "utf-8"), ("<metal charset=koi8-r>", "utf-8")]
    got = _bytes(spark, [f"<html><head>{m}</head>x".encode() for m, _ in metas])
    assert [g[0] for g in got] == [w for _, w in metas]
