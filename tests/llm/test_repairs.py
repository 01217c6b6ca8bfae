"""Pages that used to fail, generated tables against a plain layout, many rows
without an id, pipeline stages on empty, null, repeated and clashing input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventlens.llm import chat_format, common, html_text, substring_dedup

page = html_text.page_text


def test_pages_that_failed():
    assert page("a<![foo[bar]]>b") == "ab" and page("a<![ 1]>b") == "ab" and page("a<![CDATA[x]]>b") == "ab"
    assert page(f"<ol start={'9' * 5000}><li>a") == "1. a"
    assert page(f"<table><tr><td colspan={'9' * 5000}>x<td rowspan={'8' * 5000}>y") == "x  y"
    assert page("<table><tr><td>" * 5000 + "deep") == "deep"
    assert page("<div><ul><li>" * 3000 + "deep").endswith("- deep")


def test_cells_and_lists():
    assert page('<table><tr><td style="visibility:hidden">SECRET<td>b') == "  b"
    assert page("<table><tr style='visibility:hidden'><td>no<td style='visibility:visible'>yes") == "  yes"
    assert page("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>") == "a  b\n   c\nd  e"
    assert page("<table><tr><td><p>one<p>two<ul><li>a<li>b</ul><td>right</table>") == "one  right\n\ntwo\n\n- a\n- b"
    assert page("<table><tr><td>x<table><tr><td>in1<td>in2<tr><td>i3<td>i4</table><td>y") == "x         y\n\nin1  in2\ni3   i4"
    assert page("<svg><title>no</title><text>seen</text></svg> <math><mi>x</mi><annotation>no</annotation></math>") == "seen x"
    assert page("<ol start=-2><li>a<li>b<li value=7>c<li>d</ol>") == "-2. a\n-1. b\n7. c\n8. d"


def test_any_markup_is_laid_out():
    rng = random.Random(1)
    bits = ["<table>", "<tr>", "<td>", "<td rowspan=3>", "<td colspan=2>", "</table>", "</tr>", "</td>", "<li>", "<ul>", "<ol start=3>", "</ul>",
            "<![", "<!", "<!--", "-->", "]]>", "<p>", "</p>", "text", "&amp;", "&#x110000;", "&#", "<svg>", "</svg>", "<style>p{display:none}",
            "</style>", "<script>", "</script>", '<td style="visibility:hidden">', "<br>", "<pre>", "\n", " ", '"', "'", ">", "<", "=", "<details>",
            "<summary>", "<head>", "<body>", "</body>", "\x00", "é", "<caption>", "<thead>", "</ol>", "<dl><dt>", "<dd>"]
    for _ in range(6000):
        assert isinstance(page("".join(rng.choice(bits) for _ in range(rng.randrange(40)))), str)


def plain_table(grid):
    """Grid of words (None: covered from above) laid out the obvious way."""
    width = [max((len(r[c]) for r in grid if c < len(r) and r[c]), default=0) for c in range(max(map(len, grid)))]
    return "\n".join("  ".join((v or "").ljust(w) for v, w in zip(r, width)).rstrip() for r in grid)


def test_generated_tables_equal_a_plain_layout():
    rng = random.Random(2)
    for _ in range(300):
        rows, cols = rng.randrange(1, 6), rng.randrange(1, 5)
        grid = [["w" * rng.randrange(1, 9) for _ in range(cols)] for _ in range(rows)]
        span = [[1] * cols for _ in range(rows)]
        for c in range(1, cols):            # the first column stays whole, so every row has a cell
            r = 0
            while r < rows:
                n = rng.randrange(1, 4) if rng.random() < 0.4 else 1
                n = min(n, rows - r)
                span[r][c] = n
                for below in range(r + 1, r + n):
                    grid[below][c] = None
                r += n
        html = "<table>" + "".join("<tr>" + "".join(
            f"<td rowspan={span[r][c]}>{grid[r][c]}" for c in range(cols) if grid[r][c] is not None) for r in range(rows)) + "</table>"
        assert page(html) == plain_table(grid), html


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(500)}" for _ in range(n))


@pytest.mark.parametrize("ident", [None, 5])
def test_rows_that_share_an_id_are_joined_once(spark, ident, monkeypatch):
    """300 rows without an id, or with one: the texts are joined row by row."""
    shared = words(0, 60)
    rows = [(1, shared)] + [(ident, f"{words(i, 30)} {shared} {words(1000 + i, 30)}") for i in range(300)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    kept, stage = {}, common.stage

    def counted(frame, name):
        out = stage(frame, name)
        kept[name] = out
        return out
    monkeypatch.setattr(substring_dedup, "stage", counted)
    out = substring_dedup.remove_repeats(df).collect()
    source = df.select(F.coalesce("doc_id", F.lit(substring_dedup._NO_ID)).alias("id"), F.xxhash64("text").alias("k"))
    joined = source.join(kept["candidates"], ["id", "k"]).count()
    assert joined <= 301 and len(out) == 301
    assert {r.n_removed for r in out if r.doc_id != 1} == {60}
    assert [r.n_removed for r in out if r.doc_id == 1] == [0]


CASES = {
    "empty": [],
    "nulls": [(None, None, None, None, None), (1, None, None, "s", None), (2, "", "en", None, 0), (3, "plain words here", None, None, 3)],
    "repeated": [(1, "the same words in every row of this table", "en", "s", 5)] * 6 + [(2, "the same words in every row of this table", "en", "t", 5)],
    "long": [(1, words(1, 40_000), "en", "a", 1), (2, words(2, 10), "en", "b", 1)],
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_pipeline_runs_on_edge_input(spark, tmp_path, case):
    """Every stage, with a clashing column, and without any label to learn from."""
    docs = spark.createDataFrame([(*r, "clash", 7) for r in CASES[case]], DOCS + ", position string, id long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    seen, out = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = common.stage(step(spark, seen, str(tmp_path)), name)
        assert out.columns == docs.columns, name
        seen = out
    kept = [r.doc_id for r in seen.collect()]
    want = {"empty": 0, "nulls": 2, "repeated": 1, "long": 2}[case]
    assert len(kept) == want
    starts = [p for p in pieces if p.start == 0]
    assert len(starts) == want and sorted(map(repr, (p.doc_id for p in starts))) == sorted(map(repr, kept))
    assert all(p.length > 0 for p in pieces)


def test_one_turn_value_is_cut_into_pieces(spark, monkeypatch):
    """A conversation whose rows all share a turn, or have none, and a hot one."""
    monkeypatch.setattr(chat_format, "PIECE", 50)
    rows = [(1, None, "user", f"t{i:05d}") for i in range(1200)] + [(2, 7, "user", f"t{i:05d}") for i in range(1200)]
    rows += [(3, t, "user", f"t{t:05d}") for t in range(2500)] + [(4, t, "user", f"t{t:05d}") for t in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat_format.numbered(df.select(df.conv_id.alias("conv"), "turn", "role", "text"))
    assert turns.groupBy("conv", "piece").count().agg(F.max("count")).first()[0] == 50
    got = chat_format.collapse_and_render(df).orderBy("conv_id", "segment").collect()
    text = {}
    for r in got:
        text[r.conv_id] = text.get(r.conv_id, "") + r.text
    line = "<|user|>\nt{:05d}\n".format
    # 2 equals 1 in roles, texts and order; both, and 4, are prefixes of 3
    assert text == {3: "".join(map(line, range(2500)))} and [r.segment for r in got] == list(range(50))
