"""Layout, leaves, repeats and readers on small cases with every kind of dirt."""

import io
import json
import random
import re
import zipfile

import pytest

from millrace.functions.scorers import TokenOverlap
from millrace.operators import evaluation as V
from millrace.operators import layout as L
from millrace.operators import leaves as A
from millrace.operators import repeats as R
from millrace.operators import vectors as W
from millrace.sources import files as S

BLOCK = "doc string, page int, pos int, label string, content string, box array<int>"


def blocks(spark, rows):
    return spark.createDataFrame([(d, p, i, k, c, b) for d, p, i, k, c, b in rows], BLOCK)


def texts(df):
    return [(r.label, r.content) for r in df.orderBy("doc", "page", "pos").collect()]


def test_reading_order(spark):
    rows = [("d", 1, 0, "text", "right top", [600, 0, 900, 10]), ("d", 1, 1, "text", "left low", [0, 50, 300, 60]), ("d", 1, 2, "text", "left top", [0, 5, 300, 10]), ("d", 1, 3, "text", "none", None), ("d", 1, 4, "text", "short", [1]),
            ("d", 2, 0, "text", "b", [10, 90, 50, 95]), ("d", 2, 1, "text", "a", [20, 10, 45, 20]), ("e", 1, 0, "text", "y", None), ("e", 1, 1, "text", "x", [0, 0, 1, 1])]
    got = [r.content for r in L.reading_order(blocks(spark, rows)).orderBy("doc", "page", "place").collect()]
    assert got == ["left top", "left low", "right top", "none", "short", "a", "b", "y", "x"]
    assert L.reading_order(blocks(spark, []).limit(0)).count() == 0


def test_bullets(spark):
    rows = [("d", 1, 0, "text", "- a", [10, 0, 9, 9]), ("d", 1, 1, "text", "b", [15, 0, 9, 9]), ("d", 1, 2, "text", "- c", [10, 0, 9, 9]), ("d", 1, 3, "text", "far", [40, 0, 9, 9]), ("d", 1, 4, "text", "- e", [10, 0, 9, 9]), ("d", 1, 5, "text", None, [10, 0, 9, 9]), ("d", 1, 6, "table", "- f", [10, 0, 9, 9])]
    assert [c for _, c in texts(L.add_bullets(blocks(spark, rows)))] == ["- a", "- b", "- c", "far", "- e", None, "- f"]


def test_formula_numbers(spark):
    f, n = "x\n$$", "(1)"
    kinds = [["formula", "formula_number", "formula", "formula_number", "formula"], ["formula_number", "formula", "formula_number", "formula"], ["formula", "formula", "formula_number", "text"], ["formula_number", "formula_number", "formula"], ["formula_number"]]
    rows = [("d", p, i, k, {"formula": f, "formula_number": n}.get(k, "t"), None) for p, ks in enumerate(kinds) for i, k in enumerate(ks)]
    tag = ("formula", "x \\tag{1}\n$$")
    assert texts(L.merge_formula_numbers(blocks(spark, rows))) == [tag, tag, ("formula", f), tag, tag, ("formula", f), tag, ("text", "t"), tag]


def test_captions(spark):
    rows = [("d", 1, 0, "image", "i ", None), ("d", 1, 1, "text", " Figure 3 shows", None), ("d", 1, 2, "image", None, None), ("d", 1, 3, "figure_caption", "cap", None), ("d", 1, 4, "image", "j", None), ("d", 1, 5, "text", "plain", None), ("d", 2, 0, "figure_caption", "own", None)]
    assert texts(L.attach_captions(blocks(spark, rows))) == [("figure", "i\n\n Figure 3 shows"), ("figure", "\n\ncap"), ("image", "j"), ("text", "plain"), ("figure_caption", "own")]


def test_broken_words(spark):
    rows = [("d", 1, 0, "text", "the pro- ", None), ("d", 1, 1, "image", "i", None), ("d", 1, 2, "text", " gram ends re-", None), ("d", 1, 3, "text", "turn", None), ("d", 1, 4, "text", "odd-", None), ("d", 1, 5, "text", "qqq", None), ("d", 1, 6, "text", "pro-", None), ("d", 1, 7, "text", "Gram", None)]
    words = spark.createDataFrame([("program", 4.0), ("return", 5.0), ("oddqqq", 1.0)], "word string, zipf double")
    assert texts(L.merge_broken_words(blocks(spark, rows), words)) == [("text", "the program ends re-"), ("image", "i"), ("text", "turn"), ("text", "odd-"), ("text", "qqq"), ("text", "pro-"), ("text", "Gram")]
    counts = spark.createDataFrame([("a", 10**6), ("b", 10**6)], "word string, n long")
    assert {r.word: round(r.zipf, 3) for r in L.zipf(counts).collect()} == {"a": 8.699, "b": 8.699}


def test_stitched_pages(spark):
    rows = [
        ("d", 1, 0, "text", "First paragraph is complete.", None), ("d", 1, 1, "text", "This sentence is not finished and", None), ("d", 2, 0, "text", "goes on over the whole page with more words", None), ("d", 3, 0, "text", "and ends here.", None), ("d", 3, 1, "text", "Another one.", None),
        ("e", 1, 0, "table", "| a | b |\n|---|---|\n| 1 | 2 |", None), ("e", 2, 0, "table", "| a | b |\n|---|---|\n| 3 | 4 |", None), ("e", 2, 1, "text", "- list item that is open and", None), ("e", 3, 0, "text", "goes nowhere as lists stay.", None), ("f", 1, 0, "text", None, None),
        ("g", 1, 0, "text", "a word that is bro-", None), ("g", 2, 0, "text", "ken over pages.", None), ("g", 3, 0, "text", "|||||| #### ....", None),
    ]
    got = {(r.doc, r.page, r.pos): (r.content, r.page_end) for r in L.stitch_pages(blocks(spark, rows)).collect()}
    assert got == {
        ("d", 1, 0): ("First paragraph is complete.", 1), ("d", 1, 1): ("This sentence is not finished and goes on over the whole page with more words and ends here.", 3), ("d", 3, 1): ("Another one.", 3),
        ("e", 1, 0): ("| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", 2), ("e", 2, 1): ("- list item that is open and", 2), ("e", 3, 0): ("goes nowhere as lists stay.", 3), ("f", 1, 0): (None, 1),
        ("g", 1, 0): ("a word that is broken over pages.", 2), ("g", 3, 0): ("|||||| #### ....", 3),
    }
    assert L.stitch_pages(blocks(spark, []).limit(0)).count() == 0


def test_fold_rules_equal_the_columns(spark):
    """The stitching fold's own forms of the text predicates are those of the column functions."""
    from millrace.functions import text as X

    cases = ["", "  ", "open and", "done.", "done)", "a)", "# head", "| x |", "x-", "x,", "X1", "über", "Ends Ü", "and so", "Or, then", "the", "Big", "1234", "a b c", "##### ||", "word " * 9, "ab cd", "x" * 30]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    for r in df.select("t", X.is_incomplete(df.t).alias("a"), X.is_continuation(df.t).alias("b"), X.block_quality(df.t).alias("q")).collect():
        assert (L.unfinished(r.t), L.goes_on(r.t)) == (r.a, r.b) and abs(L.quality(r.t) - r.q) < 1e-9, r.t


def test_fill_forward(spark):
    rows = [(i, "s%d" % i if i % 7 == 0 else "  " if i % 2 else None, "x" if i == 3 else None, i) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "n int, a string, b string, other int")
    for block in (1, 5, 1000):
        got = [(r.a, r.b) for r in L.fill_forward(df, "n", ["a", "b"], block=block).orderBy("n").collect()]
        assert got == [("s%d" % (i // 7 * 7) if i >= 7 else None, "x" if i >= 3 else None) for i in range(1, 40)]


def test_bookmarks(spark):
    text = "cover\n1 Intro\nhello\n1.1 Deep\nmore\n2 Next\nend"
    marks = [{"title": "1 Intro", "level": 1}, {"title": "1.1 DEEP", "level": 2}, {"title": "absent title", "level": 1}, {"title": None, "level": 1}, {"title": "2 Next", "level": 1}]
    kind = "doc_id int, text string, bookmarks array<struct<title:string,level:int>>"
    df = spark.createDataFrame([(1, text, marks), (2, None, marks), (3, text, None), (4, "", [])], kind)
    got = [(r.doc_id, r.title, r.hierarchy, r.section) for r in L.bookmark_sections(df).orderBy("doc_id", "pos").collect()]
    assert got == [(1, "1 Intro", ["1 Intro"], "1 Intro\nhello"), (1, "1.1 DEEP", ["1 Intro", "1.1 DEEP"], "1.1 Deep\nmore"), (1, "2 Next", ["2 Next"], "2 Next\nend")]


def test_body_size(spark):
    df = spark.createDataFrame([("d", 10.0, "body " * 30), ("d", 10.04, "more"), ("d", 11.0, "near"), ("d", 14.0, "Head"), ("d", 18.0, "Title"), ("d", 18.0, "  "), ("e", 9.0, "x")], "doc string, size double, text string")
    assert {(r.doc, r.size): r.level for r in L.body_and_levels(df).collect()} == {("d", 10.0): 0, ("d", 11.0): None, ("d", 14.0): 2, ("d", 18.0): 1, ("e", 9.0): 0}


def test_sheets(spark):
    rows = [(1, "Main Part", "Grp & Co", "Key", "1"), (2, None, None, "Other Key", "2"), (3, "  ", "Solo", "val", None), (4, None, None, None, "x"), (5, None, "nan", "k", "NaN")]
    df = spark.createDataFrame(rows, "n int, s string, g string, k string, v string")
    got = [(r.n, r.path, r.value) for r in A.grouped_sheet(df, "n", ("s", "g", "k", "v")).orderBy("n").collect()]
    assert got == [(1, "main_part.grp_and_co.key", "1"), (2, "main_part.grp_and_co.other_key", "2"), (3, "main_part.solo", "val")]
    flat = spark.createDataFrame([(1, "A_b C", "v"), (2, None, "v"), (3, "d", None)], "n int, Path string, Value string")
    assert [(r.n, r.path, r.value) for r in A.flat_sheet(flat, "n").orderBy("n").collect()] == [(1, "a.b.c", "v"), (3, "d", "")]
    deep = spark.createDataFrame([(1, "A", None, "C d", "v"), (2, None, "none", None, "v")], "n int, L1 string, L2 string, L10 string, Value string")
    assert [(r.n, r.path, r.value) for r in A.flat_sheet(deep, "n").collect()] == [(1, "a.c_d", "v")]


def test_alignment(spark):
    gold = [("a.b", "1"), ("a.c", "x"), ("z.total amount", "7"), ("q", None), ("a.b", "2")]
    got = [("a.b", "2"), ("a.b", "1"), ("other.amount_total", "9"), ("zz.total amount", "7"), ("c", "x")]
    assert A.best_matches(gold, got) == [1, 4, 3, None, 0]
    df = lambda rows: spark.createDataFrame([("d", i, p, v) for i, (p, v) in enumerate(rows)], "doc_id string, place int, path string, value string")
    rows = A.align(df(gold), df(got)).orderBy("place").collect()
    assert [r.status for r in rows] == ["MATCH", "MATCH", "MATCH", "MISSING_KEY", "MATCH"]
    three = A.align_three(df(gold), df(got), df([])).orderBy("place").collect()
    assert [r.second_status for r in three] == ["MISSING_KEY"] * 5 and [r.first_path for r in three] == [r.predicted_path for r in rows]


def test_repeats_against_the_regex():
    rng = random.Random(3)

    def by_regex(s):
        m = re.compile(r"(.{10,%d}?)\1{9,}" % (len(s) // 10), re.S).search(s) if len(s) >= 100 else None
        return (m.start(), len(m.group(1))) if m else None

    for _ in range(250):
        unit = "".join(rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randrange(1, 50)))
        s = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 40))) + unit * rng.randrange(6, 26) + unit[:3] * rng.randrange(1, 60)
        assert R.first_repeat(s) == by_regex(s)


@pytest.mark.parametrize("size", [150, 200, 201, 2_500, 40_000])
def test_repeats_of_any_length(size):
    rng = random.Random(size)
    unit = "".join(rng.choice("abcdefghij ") for _ in range(size - 2)) + "xy"
    head = "".join(rng.choice("klmnop") for _ in range(25_000))
    assert R.without_repeats(head + unit * 10 + "tail") == head + unit
    assert R.without_repeats(head + unit * 9 + "tail") == head + unit * 9 + "tail"


def test_dominant_line_and_dirt(spark):
    s = "  one\n\ntwo\n" + "same\n" * 3 + "x\n" + "same\n" * 20
    assert R.dominant_line(s) == "  one\n\ntwo\nsame" and R.dominant_line("same\n\nx\n" * 30) == "same\n\nx\n" * 30 and R.dominant_line("a\n" * 9) == "a\n" * 9
    df = spark.createDataFrame([(1, None), (2, ""), (3, s)], "id int, text string")
    assert [r.text for r in R.cut_dominant_lines(df).orderBy("id").collect()] == [None, "", "  one\n\ntwo\nsame"] and R.truncate_repeats(df.limit(0)).count() == 0


def test_first_object(spark):
    cases = {'{"a": 1}': {"a": 1}, '```json\n{"a": 2}\n```': {"a": 2}, 'so: {"a": "}{\\"", "b": {"c": 3}} and {"d": 4}': {"a": '}{"', "b": {"c": 3}}, "[1, 2]": None, "{broken": None, "none": None, "": None, None: None, "x {not json} y": None, '"{"': None}
    for text, want in cases.items():
        got = V.first_object(text)
        assert (None if got is None else json.loads(got)) == want, text
    assert V.first_objects(spark.createDataFrame([(1, None), (2, "x {} y")], "id int, t string"), ("id",), "t").orderBy("id").collect()[1].object == "{}"


def test_semantic_first(spark):
    rows = [("g", 1, [1.0, 0.0]), ("g", 2, [0.99, 0.05]), ("g", 3, [0.0, 1.0]), ("g", 4, None), ("g", 5, [0.0, 0.0]), ("h", 6, [1.0, 0.0]), ("h", 7, [2.0, 0.0]), (None, 8, [1.0, 0.0]), (None, 9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "g string, n int, vector array<double>")
    assert sorted(r.n for r in V.semantic_first(df, "g", "n").collect()) == [1, 3, 4, 5, 6, 8]


def test_rerank_and_misses(spark):
    rows = [(1, "brake sensor", "a", "wheel speed", 1, "wheel speed brake"), (1, "brake sensor", "b", "brake sensor text", 0, "wheel speed brake"), (1, "brake sensor", "c", None, 0, None)]
    df = spark.createDataFrame(rows, "query_id int, query string, item_id string, text string, hop_index int, evidence string")
    got = V.rerank(df, TokenOverlap(), 2).orderBy("place").collect()
    assert [r.item_id for r in got] == ["b", "a"] and got[1].rerank_score > 0
    same = lambda a, b: a == b
    assert V.miss_kind("ctx", [("ctx", "f.pdf")], [], same) == "wrong_chunk"
    assert V.miss_kind("Brake manual chapter", [("x", "brake_manual.pdf")], [], same) == "wrong_chunk"
    assert V.miss_kind("ctx", [("x", "f.pdf")], [("ctx", "g.pdf")], same) == "below_cutoff" and V.miss_kind("ctx", [("x", "f.pdf")], [("ctx", "f.md")], same) == "wrong_chunk"
    assert V.miss_kind("ctx", [("x", "f.pdf")], [], same) == "wrong_doc"


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, float(i % 2)) for i in range(400)], "id int, delta double")
    a, b = (V.bootstrap(df.repartition(n), key="id", rounds=300).first() for n in (1, 5))
    assert a == b and 0.44 < a.low < 0.5 < a.high < 0.56


def test_blocks_of_queries(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, [0.0] * 8)]
    items = spark.createDataFrame([*rows, (61, None), (62, [1.0]), (None, [1.0] * 8)], "item_id int, v array<double>")
    queries = spark.createDataFrame(rows[:20] + [(90, None)], "query_id int, q array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / ((sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5 or 1)
    want = {(i, j) for i, a in rows[:20] for j, _ in sorted(((j, round(cos(a, b), 6)) for j, b in rows if j != i), key=lambda x: (-x[1], x[0]))[:4]}
    for block in (7, 1000):
        assert {(r.query_id, r.item_id) for r in W.ranked(W.scored(queries, items, k=4, block=block), k=4).collect()} == want
    assert W.scored(queries.limit(0), items, k=4).count() == 0 and W.scored(queries, items).count() == 20 * 60


def test_encoder(spark):
    df = spark.createDataFrame([(1, "brake Brake sensor"), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.vector for r in TokenOverlap().encode(df, "text").collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-9 and set(got[2]) == set(got[3]) == {0.0} and len(got[2]) == 64


def test_documents_by_suffix(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One </w:t><w:t>two</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "b.TXT").write_text("héllo\n")
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    (tmp_path / "c.bin").write_bytes(b"x")
    got = {r.path.rpartition("/")[2]: (r.kind, r.text, r.error is None) for r in S.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("docx", "One two\na | b", True), "b.TXT": ("txt", "héllo\n", True), "bad.docx": ("docx", None, False)}
    assert {r.path.rpartition("/")[2] for r in S.find_files(spark, str(tmp_path), (".docx",)).collect()} == {"a.docx", "bad.docx"}
