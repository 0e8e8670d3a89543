"""The operators for language-model data, against brute force, libraries and small cases with every kind of dirt."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import encoding, fusion, leakage, neighbours, overlap, pairs, scan, split, tokenize

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


# ---- 1 splitting

@given(st.text(alphabet="ab .\n!?é̈", max_size=400), st.integers(20, 60), st.integers(0, 15))
def test_pieces_fit_and_join(text, limit, over):
    got = split.cuts(text, limit, over)
    assert "".join(text[n:e] for _, n, e in got) == text
    assert all(e - b <= limit and 0 <= n - b <= over for b, n, e in got)


def test_cut_at_paragraphs():
    text = ("word " * 18 + "end.\n\n") * 3
    assert [text[a - 2 : a] for _, _, a in split.cuts(text, 120, 10)[:-1]] == ["\n\n"] * 2


def test_split_dirt(spark):
    rows = [("a", None, 1), ("b", "", 2), ("c", "x" * 50, 3), ("c", "x" * 50, 3), (None, "y z " * 30, 4)]
    got = split.split_oversized(spark.createDataFrame(rows, "k string, text string, piece int").select("k", "text", "piece"), 40, 8, keep=("k",)).collect()
    assert sorted((r.k or "", r.n_pieces) for r in got if r.piece_index == 0) == [("", 4), ("b", 1), ("c", 2), ("c", 2)]
    assert split.split_oversized(spark.createDataFrame([], "k string, text string"), 40, 8, keep=("k",)).count() == 0


# ---- 2 nearest vectors

def vectors(n, groups, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 64))
    near = [base[i] + 0.25 * rng.standard_normal(64) for i in range(groups) for _ in range(3)]
    return [(f"v{i:05d}", [float(x) for x in v]) for i, v in enumerate([*base, *near])]


def test_neighbours_against_brute_force(spark):
    rows = vectors(1500, 150)
    rows += [("copy1", rows[0][1]), ("copy2", rows[0][1]), ("copy2", rows[0][1])]
    dirt = [("n", None), ("e", []), ("s", [1.0]), ("z", [0.0] * 64), ("nan", [float("nan")] * 64), ("inf", [float("inf")] + [1.0] * 63), (None, [1.0] * 64)]
    df = spark.createDataFrame(rows + dirt, "id string, dense_vec array<float>")
    got = {(r.id, r.neighbour) for r in neighbours.nearest(neighbours.build_graph(df, 64, 0.85), 5).where("similarity >= 0.9").collect()}
    ids = sorted({i for i, _ in rows})
    m = np.array([dict(rows)[i] for i in ids], np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 6)
    np.fill_diagonal(s, -2)
    want = {(ids[a], ids[b]) for a in range(len(ids)) for b in sorted(range(len(ids)), key=lambda b: (-s[a, b], ids[b]))[:5] if s[a, b] >= 0.9}
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_five_of_every_vector(spark, tmp_path):
    """Weak neighbours too, of every vector, in several blocks, with copies and a key delivered twice."""
    rows = vectors(600, 40, 7)
    rows += [("copy1", rows[0][1]), ("copy2", rows[0][1]), ("v00003", rows[3][1])]
    kept = dict(rows)
    ids = sorted(kept)
    m = np.array([kept[i] for i in ids], np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 5)
    np.fill_diagonal(s, -2)
    want = {(ids[a], ids[b]) for a in range(len(ids)) for b in sorted(range(len(ids)), key=lambda b: (-s[a, b], ids[b]))[:5]}
    df = spark.createDataFrame(rows + [("n", None), ("z", [0.0] * 64)], "id string, dense_vec array<float>")
    got = {(r.id, r.neighbour) for r in neighbours.nearest(neighbours.exact_graph(df, 64, 5, block=150), 5).collect()}
    assert got == want
    df.write.parquet(str(tmp_path / "child_chunks.parquet"))
    from millrace.llm.queries import p2_neighbours

    assert {(r.id, r.neighbour) for r in p2_neighbours(spark, str(tmp_path)).collect()} == want
    assert neighbours.nearest(neighbours.exact_graph(df.limit(0), 64, 5), 5).count() == 0


def test_group_of_copies(spark):
    v = [float(x) for x in range(1, 65)]
    df = spark.createDataFrame([(f"c{i}", v) for i in range(20)], "id string, dense_vec array<float>")
    got = neighbours.nearest(neighbours.build_graph(df, 64, 0.85), 5)
    assert got.count() == 100 and got.where("id = neighbour").count() == 0
    assert [r.neighbour for r in got.where("id = 'c0'").orderBy("place").collect()] == ["c1", "c10", "c11", "c12", "c13"]


def test_full_cells_are_split():
    rng = np.random.default_rng(1)
    m = np.concatenate([np.ones((5000, 8)) + 0.01 * rng.standard_normal((5000, 8)), rng.standard_normal((1000, 8))]).astype(np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    cells = neighbours.Cells(m, 600_000, 5_000)
    _, where = cells.assign(m)
    assert np.unique(where, return_counts=True)[1].max() < 2500


def test_search_is_exact_and_empty_is_fine(spark):
    rows = vectors(300, 20, 3)
    df = spark.createDataFrame(rows, "id string, dense_vec array<float>")
    q = df.where(F.col("id") < "v00010")
    got = {(r.id, r.neighbour) for r in neighbours.search(df, q, 64, 3, block=4).collect()}
    m = np.array([v for _, v in rows], np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -2)
    assert got == {(rows[a][0], rows[b][0]) for a in range(10) for b in np.argsort(-s[a])[:3]}
    none = df.limit(0)
    assert neighbours.search(df, none, 64, 3).count() == 0
    assert neighbours.nearest(neighbours.build_graph(none, 64, 0.8), 5).count() == 0


# ---- 3 scans

def corpus():
    ws = "the module shall report every error before normal operation and return within the time limit of this system when the driver loses control".split()
    rng = random.Random(5)
    return [("clean%d" % i, "Ctl_Guide_R1.pdf", " ".join(rng.choice(ws) for _ in range(60)) + ".") for i in range(60)]


def noise_of(spark, extra):
    df = spark.createDataFrame(corpus() + extra, "chunk_id string, filename string, text string")
    model = scan.learn(df)
    got = {}
    for r in scan.noise(df, model, ("chunk_id",)).distinct().collect():
        got.setdefault(r.chunk_id, set()).add(r.noise)
    fixed = {r.chunk_id: r.text for r in scan.repair_scans(df, model, ("chunk_id",)).collect()}
    return got, fixed


def test_scan_noise(spark):
    extra = [
        ("a", "Ctl_Guide_R1.pdf", "the module shall re-\nturn within the ti¬\nme limit."),
        ("b", "Ctl_Guide_R1.pdf", "the rnodule shall rep0rt every crror."),
        ("c", "Ctl_Guide_R1.pdf", "the module shall\nPage 3    Ctl Guide - Release 1.0\nreport every error."),
        ("d", "Ctl_Guide_R1.pdf", "the module shall\n- 12 -\nreport."),
        ("e", "Ctl_Guide_R1.pdf", "1.2 The error limit\nthe module shall report\nevery error."),
        ("f", None, None),
        ("g", None, ""),
    ]
    got, fixed = noise_of(spark, extra)
    assert got == {"a": {"hyphenation"}, "b": {"misread"}, "c": {"header", "page_number"}, "d": {"page_number"}}
    assert fixed["a"] == "the module shall return within the time limit."
    assert fixed["b"] == "the module shall report every error."
    assert fixed["c"] == fixed["c"].strip() and "Release" not in fixed["c"] and "\n" not in fixed["c"]
    assert fixed["f"] is None and fixed["g"] == "" and len(fixed) == 67


def test_long_furniture_lines():
    """A running header or its page number is one at any length of the line."""
    for n in (5, 40, 200):
        x = scan.Line(" ".join(["Word"] * n) + "     Page 12")
        assert x.page and x.head == " ".join(["Word"] * n)


def test_header_must_repeat_in_a_share_of_its_file(spark):
    """Three times in a file of twelve texts is a running header, three times among six hundred is not."""
    body = "the module shall report every error before normal operation and return"
    rows = [(f"{f}{i}", f, ("Annual Safety Digest\n" if i < 3 else "") + body) for f, n in (("small.pdf", 12), ("large.pdf", 600)) for i in range(n)]
    df = spark.createDataFrame(rows, "chunk_id string, filename string, text string")
    got = {r.chunk_id for r in scan.noise(df, scan.learn(df), ("chunk_id",)).where("noise = 'header'").collect()}
    assert got == {"small.pdf0", "small.pdf1", "small.pdf2"}


def test_folds_meet():
    for a, b in (("modern", "modem"), ("clock", "dock"), ("internal", "intemal"), ("lehnt", "lelint"), ("decline", "dechne"), ("written", "vvritten")):
        assert set(scan.folds(a)) & set(scan.folds(b)), (a, b)


# ---- 4 overlaps

def test_overlaps(spark):
    q = "How does the gateway verify that module seven restores the buffered routing table after thirty milliseconds"
    r = "The gateway compares the stored digest with the routing table and restores the older copy. A second request is rejected until the watchdog confirms the result of the first comparison in normal operation"
    other = "Nothing of what is said here has any words in common beyond some articles, since it is about cooking rice and beans"
    rows = [
        ("t1", "train", q, r), ("e1", " TEST ", q.lower() + "!!", r.replace(",", "")), ("e2", "dev", "Question: " + q.replace("buffered", "bufferd"), "Answer: " + ". ".join(reversed(r.split(". ")))),
        ("e3", "test", q, other), ("e4", "test", other, r), ("x", None, q, r), ("t2", "Train", q, r), ("t3", "train", q, None), ("e5", "dev", q, ""), ("e1", " TEST ", q.lower() + "!!", r.replace(",", "")),
    ]
    found = overlap.find(spark.createDataFrame(rows, "id string, split string, user_input string, reference string"))
    got = {(p.id_a, p.id_b) for p in found.id_pairs().collect()}
    assert got == {("e1", "t1"), ("e2", "t1"), ("e1", "t2"), ("e2", "t2")}
    empty = overlap.find(spark.createDataFrame([], "id string, split string, user_input string, reference string"))
    assert empty.id_pairs().count() == 0


def test_hot_seeds_still_meet(spark):
    """Many records of one wording: every seed is frequent, and near copies must be found all the same."""
    rng = random.Random(1)
    head = "which requirement limits the cyclic report of the module during normal operation in the gateway of the second vehicle line"
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(60):
        body = "the common introduction of every answer is long and always the same in all of these records " + " ".join(words[i * 6 : i * 6 + 6])
        rows.append((f"t{i:02d}", "train", head, body))
        rows.append((f"e{i:02d}", "test", head, body.replace("long", "lengthy")))
    got = {(p.id_a, p.id_b) for p in overlap.find(spark.createDataFrame(rows, "id string, split string, user_input string, reference string")).id_pairs().collect()}
    assert {(f"e{i:02d}", f"t{i:02d}") for i in range(60)} <= got


def links(rows):
    """Brute force: all pairs across the splits that the verdict takes."""
    texts = {i: [" ".join(overlap.words(x)) for x in f] for i, _, *f in rows}
    return {tuple(sorted((i, j))) for i, s, *_ in rows for j, t, *_ in rows if s == "train" and t == "test" and overlap.compared(list(zip(texts[i], texts[j])))}


def found_links(spark, rows):
    return {(p.id_a, p.id_b) for p in overlap.find(spark.createDataFrame(rows, "id string, split string, user_input string, reference string")).id_pairs().collect()}


@pytest.mark.parametrize("direct", [65_536, 100])
def test_group_of_edited_copies_against_brute_force(spark, monkeypatch, direct):
    """Every seed of a large group is frequent, and edits leave short ones only; joined one by one and in combinations."""
    monkeypatch.setattr(overlap, "DIRECT", direct)
    rng = random.Random(4)
    say = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 10))) for _ in range(75)]

    def edited(ws):
        return " ".join(w[:1] + rng.choice("xyz") + w[2:] if rng.random() < 0.04 else w for w in ws)

    rows = [(f"{side}{i:03d}", side, edited(say[:24]), edited(say[24:])) for side in ("train", "test") for i in range(40)]
    rows += [("other", "train", " ".join(say[:18]), " ".join(reversed(say[18:40])) + " and much else that is said nowhere"), ("short", "test", "yes", "no")]
    want = links(rows)
    got = found_links(spark, rows)
    assert got == want and len(want) > 1_500


def test_frequent_seed_of_one_field_is_enough(spark, monkeypatch):
    """All questions are the same, and typing errors leave no seed that two answers share."""
    monkeypatch.setattr(overlap, "DIRECT", 100)
    rng = random.Random(6)
    ask = "what does the gateway of the second vehicle line do with the stored frame at shutdown"
    rows = []
    for i in range(12):
        say = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(30)]
        rows.append((f"train{i:02d}", "train", ask, " ".join(say)))
        rows.append((f"test{i:02d}", "test", ask, " ".join(w[:4] + "z" + w[5:] if k % 2 else w for k, w in enumerate(say))))
    seeds = {i: set(overlap.winnow(a.split(), 2)[1].tolist()) for i, _, _, a in rows}
    assert not any(seeds[f"train{i:02d}"] & seeds[f"test{j:02d}"] for i in range(12) for j in range(12))
    assert found_links(spark, rows) == links(rows) == {(f"test{i:02d}", f"train{i:02d}") for i in range(12)}


@pytest.mark.parametrize("n", [5, 30])
def test_every_pair_of_a_group_is_found(spark, n):
    """Long shared phrases, and two of about fifty words that differ in each field."""
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    say = [[word() for _ in range(52)] for _ in range(2)]

    def of(ws):
        out = list(ws)
        for k in rng.sample(range(52), 2):
            out[k] = word()
        return " ".join(out)

    rows = [(f"{side}{i}", side, of(say[0]), of(say[1])) for side in ("train", "test") for i in range(n)]
    assert found_links(spark, rows) == links(rows) == {tuple(sorted((f"train{i}", f"test{j}"))) for i in range(n) for j in range(n)}


def test_words_are_aligned():
    a = "the first module sends the frame at once. the second module stores its older entry of the table. both report to the gateway".replace(".", "").split()
    turned = a[8:] + a[:8]
    assert overlap.aligned(a, turned)[0] == 0
    mixed = a[:]
    random.Random(3).shuffle(mixed)
    assert overlap.least_left_over(a, mixed) == 0 and overlap.aligned(a, mixed)[0] > overlap.CHANGED
    assert overlap.aligned(a, a) == (0.0, 1.0, 1.0) and overlap.aligned([], a) == (1.0, 0.0, 0.0)
    assert overlap.aligned(["question", *a], a)[0] == 0


words_of = st.lists(st.sampled_from([w * k for w in "abcdefgh" for k in (1, 3, 5)]), min_size=1, max_size=30)


@given(words_of, words_of, st.integers(0, 30))
@settings(deadline=None)
def test_bag_is_a_lower_bound(a, b, k):
    for x, y in ((a, b), (a, a[k % len(a) :] + a[: k % len(a)] + b[:3])):
        left, ca, cb = overlap.aligned(x, y)
        assert overlap.least_left_over(x, y) <= left + 1e-9 and 0 <= ca <= 1 and 0 <= cb <= 1


def test_coverage_and_report(spark):
    q, r = " ".join(f"quest{i}" for i in range(20)), " ".join(f"word{i}" for i in range(50))
    cut = " ".join(f"word{i}" for i in range(45))
    rows = [("t1", "train", q, r, ["a", "b"]), ("t2", "train", q, r, ["a"]), ("e1", "dev", q, cut, ["a"]), ("e2", "test", q.upper(), r, None), ("e3", "test", "something else altogether here", r, ["b"]), ("t1", "train", q, r, ["a", "b"])]
    df = spark.createDataFrame(rows, "id string, split string, user_input string, reference string, source_documents array<string>")
    found = overlap.find(df)
    got = {x.id: (x.n_partners, round(x.coverage, 3)) for x in found.coverage().collect()}
    assert got == {"t1": (2, 1.0), "t2": (2, 1.0), "e1": (2, 1.0), "e2": (2, 1.0), "e3": (0, 0.0)}
    rep = {(x.split, x.source): (x.n_records, x.n_overlapping, x.n_partners, x.coverage) for x in overlap.report(found, df).collect()}
    assert rep == {("train", "a"): (2, 2, 4, 1.0), ("train", "b"): (1, 1, 2, 1.0), ("dev", "a"): (1, 1, 2, 1.0), ("test", None): (1, 1, 2, 1.0), ("test", "b"): (1, 0, 0, None)}


@given(st.text(alphabet="abc", min_size=1, max_size=10), st.text(alphabet="abc", min_size=1, max_size=10))
def test_near_words_share_a_variant(a, b):
    assert not overlap.near(a, b) or overlap.variants(a) & overlap.variants(b)


@given(st.lists(st.sampled_from("abcdefgh"), min_size=40, max_size=120), st.integers(0, 30), st.integers(0, 30))
@settings(deadline=None)
def test_winnowing_guarantee(ws, a, b):
    """A run of window + gram - 1 characters shares a kept hash."""
    run = "".join(random.Random(0).choice("uvwxyz") for _ in range(overlap.WINDOW + overlap.GRAM - 1))
    x = set(overlap.winnow(["".join(ws[:a]) + run + "".join(ws[a:])], 1)[1].tolist())
    y = set(overlap.winnow(["".join(ws[::-1][:b]) + run + "".join(ws[::-1][b:])], 1)[1].tolist())
    assert x & y


# ---- 6 pairs

CASES = {
    "empty_answer": [None, "", " \n", "N/A", "-", "**Answer:** tbd", "{}"],
    "refusal": ["I'm sorry, but I can't answer this from the given material.", "Note: The documents do not contain enough information about BusCtl.", "NOT_ANSWERABLE", "Based on the context, this question can not be answered."],
    "copies_question": ["how long may the sensor label stay in busctl before it reports an error", "You ask: How long may the sensor label stay in BusCtl before it reports an error?"],
    "other_language": ["Das Modul muss die Übertragung nach 8 ms bestätigen, falls kein Fehler gemeldet wird.", "Le module doit vérifier la clé de session avant que la requête ne soit appelée."],
    "truncated_answer": ["The sensor label is kept for 8 ms. After that the module reports the", "The label stays until the driver, which"],
}
FINE = ["Yes.", "8 ms", "BusCtl_Init", "Only the integrator.", "The module cannot answer a second request while the first is pending; it returns BUSY instead.", "How long may the sensor label stay in BusCtl before it reports an error? The label stays for at most 20 ms, and the driver then drops the oldest of its entries."]


def test_defects(spark):
    q = "How long may the sensor label stay in BusCtl before it reports an error?"
    rows = [("h", i, q, a) for i, a in enumerate([a for c in CASES.values() for a in c] * 3 + FINE * 12)]
    got = {r.row_id: r.defects[0] for r in pairs.defective_pairs(spark.createDataFrame(rows, "row_table string, row_id int, question string, answer string")).collect()}
    n = sum(map(len, CASES.values()))
    want = {i: d for k in range(3) for i, d in enumerate((d for d, c in CASES.items() for _ in c), k * n)}
    assert got == want
    assert pairs.defective_pairs(spark.createDataFrame([], "row_table string, row_id int, question string, answer string")).count() == 0


def test_list_marker_and_impossibility():
    sign = lambda d, v: v[sum(n for k, n in list(pairs.FUNCTIONS.items())[: pairs.DEFECTS.index(d)]) :][: pairs.FUNCTIONS[d]]
    assert list(pairs.FUNCTIONS) == list(pairs.DEFECTS)
    q = "Which entries of the routing table may the gateway drop at start-up?"
    assert "+" in sign("truncated_answer", pairs.votes(q, "All may be dropped. The exceptions are:\n1. default route\n2."))
    assert "+" not in sign("truncated_answer", pairs.votes(q, "All may be dropped (see 4.2)."))
    assert "+" in sign("refusal", pairs.votes(q, "It is impossible for me to tell from these pages what it drops."))
    assert "+" not in sign("refusal", pairs.votes(q, "After 640 us without an answer, the entry is dropped, even if it lies outside the window."))
    assert "+" not in sign("refusal", pairs.votes(q, "The module cannot answer a second request while the first is pending."))


@pytest.mark.parametrize("n", [10, 160, 4000])
def test_answers_are_read_whole(n):
    """A copy is a copy however much of the question comes before it."""
    rng = random.Random(n)
    q = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    assert pairs.votes(q + "?", q + " " + q)[3:6] == "+++" and pairs.votes(q + "?", " ".join(reversed(q.split())) + " " + q)[3] == "+"
    assert pairs.votes(q + "?", q + " " + " ".join(w[::-1] + "k" for w in q.split()))[3:6] == "---"


def test_cutoffs_are_validated():
    """Damaged pairs of every kind come out, and the cutoff parts them from sound ones."""
    fine = [(f"How long may the sensor label {i} stay in the buffer before it reports an error?", f"The label {i} stays there for at most {i} ms, and the driver then drops the oldest of its entries without a report.") for i in range(30)]
    fine += [(f"Wie lange darf die Marke {i} im Puffer bleiben?", f"Die Marke {i} bleibt dort für höchstens {i} ms, und der Treiber verwirft danach die ältesten Einträge.") for i in range(10)]
    bad = pairs.damaged(fine)
    assert all(bad[d] for d in pairs.DEFECTS)
    at = 0
    for d, n in pairs.FUNCTIONS.items():
        assert sum("+" in pairs.votes(*x)[at : at + n] for x in bad[d]) >= 0.95 * len(bad[d]), d
        at += n
    assert pairs.cutoff([0.0, 0.1, 0.6], [0.99, 0.9]) == pytest.approx(0.75) and pairs.cutoff([], []) == 0.5


SOUND = [
    ("How long may the sensor label stay in the buffer before it reports an error?", "The label stays there for at most 20 ms, and the driver then drops the oldest of its entries."),
    ("Wie lange darf die Marke im Puffer bleiben?", "Die Marke bleibt dort für höchstens 20 ms, und der Treiber verwirft danach die ältesten Einträge."),
    ("Combien de temps la marque peut-elle rester dans le tampon?", "La marque reste dans le tampon pour 20 ms, et le pilote ne garde que les plus récentes."),
    ("Which module drops the oldest entries of the table at start-up?", "The gateway."),
    ("バッファはいつ消去されますか", "バッファは起動のたびに消去され、そのあとで表が読み込まれます。"),
    ("Sensor 12 x 7?", "The second value of the stored table is only read by the gateway at start-up."),
]


def test_damage_by_counts_against_brute_force():
    """Every question of a known language under every answer of another one, each language with the same weight."""
    n = {i: 3 * i + 1 for i in range(len(SOUND))}
    words = Counter()
    for i, x in enumerate(SOUND):
        for w in pairs.damage(*x).split(" "):
            words[w] += n[i]
    got = pairs.damages(words)
    want = {d: Counter() for d in pairs.DEFECTS}
    langs = [pairs.language(a)[0] if len(a.split()) >= 6 else None for _, a in SOUND]
    for i, (q, _) in enumerate(SOUND):
        lang = pairs.language(q)[0]
        others = {x for x in langs if x and x != lang} if lang else set()
        for k, (_, a) in enumerate(SOUND):
            if langs[k] in others:
                of_it = sum(n[j] for j, x in enumerate(langs) if x == langs[k])
                want["other_language"][pairs.votes(q, a, only="other_language")] += Fraction(n[i] * n[k], len(others) * of_it)
        for d in set(pairs.DEFECTS) - {"other_language"}:
            for x in pairs.damaged([(q, SOUND[i][1])], zlib.crc32("\0".join(SOUND[i]).encode()))[d]:
                want[d][pairs.votes(*x, only=d)] += n[i]
    assert got == want and all(want.values()) and got["empty_answer"].total() == sum(n.values())
    for q, a in SOUND:
        assert "".join(pairs.votes(q, a, only=d) for d in pairs.DEFECTS) == pairs.votes(q, a)


def test_cutoffs_come_from_all_sound_pairs(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pairs, "cutoff", lambda sound, bad: seen.append((Counter(sound).total(), Counter(bad).total())) or 0.5)
    rows = [("h", i, *SOUND[i % 2]) for i in range(900)] + [("h", i, *SOUND[0]) for i in range(0, 900, 2)] + [("h", 900, SOUND[0][0], "N/A"), ("h", 901, None, SOUND[0][1])]
    got = pairs.defective_pairs(spark.createDataFrame(rows, "row_table string, row_id int, question string, answer string")).collect()
    assert [r.row_id for r in got] == [900] and [s for s, _ in seen] == [900] * len(pairs.DEFECTS)
    assert [b for _, b in seen] == [900, 900, 900, 900, 900]


# ---- 7 one ranking

def plain_walk(s, damping=0.9):
    n, m = s.shape
    p = np.zeros((n, n))
    for i in range(n):
        own = [j for j in range(m) if not np.isnan(s[i, j])]
        for j in own:
            up = [k for k in range(n) if not np.isnan(s[k, j]) and s[k, j] > s[i, j]]
            for k in up or [i]:
                p[i, k] += 1 / len(own) / max(1, len(up))
    x = np.full(n, 1 / n)
    for _ in range(500):
        y = damping * (x @ p)
        x = y + (1 - y.sum()) / n
    return x


@given(st.lists(st.lists(st.one_of(st.none(), st.integers(0, 4)), min_size=4, max_size=4), min_size=1, max_size=8))
@settings(deadline=None)
def test_walk_against_a_plain_matrix(rows):
    s = np.array([[np.nan if v is None else float(v) for v in r] for r in rows])
    assert np.allclose(fusion.stationary(s[None])[0], plain_walk(s), atol=1e-6)


def test_three_of_four_come_first():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(2, 30))
        s = rng.random((n, 4)) * [1, 10, 100, 1000]
        s[0, :3] = s[1:, :3].max(axis=0) + 1
        x = fusion.stationary(s[None])[0]
        assert x.argmax() == 0


def test_ranking_dirt(spark):
    kind = "array<struct<source_id:string,a:double,b:double>>"
    rows = [(1, [("x", 1.0, None), ("y", 0.0, 5.0), None, (None, 9.0, 9.0)]), (2, None), (3, []), (4, [("z", None, None)]), (5, [("p", 1.0, 1.0), ("q", 1.0, 1.0)])]
    got = [(r.row_id, r.source_id, r.position) for r in fusion.rank_walk(spark.createDataFrame(rows, f"row_id int, context_chunks {kind}"), ("a", "b")).orderBy("row_id", "position").collect()]
    assert [g for g in got if g[0] != 1] == [(4, "z", 1), (5, "p", 1), (5, "q", 2)] and len([g for g in got if g[0] == 1]) == 2


# ---- 8 tokens

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@given(st.text(max_size=200))
@settings(deadline=None, max_examples=300)
def test_ids_of_the_library(s):
    from tokenizers import Tokenizer

    t = test_ids_of_the_library.__dict__.setdefault("t", Tokenizer.from_file(PATH))
    t.encode_special_tokens = True
    b = tokenize.bpe(PATH)
    assert b.encode(s) == t.encode(s, add_special_tokens=False).ids
    assert b.decode(b.encode(s)) == s


def test_long_pieces_stream(library):
    b = tokenize.bpe(PATH)
    rng = random.Random(3)
    for s in ("a" * 9000, "状態" * 3000, "0123456789" * 700, "".join(rng.choice("abcd") for _ in range(6000)), "=-" * 4000, " " * 3000 + "x", "<|endoftext|>"):
        assert b.encode(s) == library.encode(s, add_special_tokens=False).ids
    data = ("".join(rng.choice("abcdefgh") for _ in range(5000))).encode()
    assert list(b.stream([data])) == list(b.stream(data[i : i + 7] for i in range(0, len(data), 7)))


@given(st.text(alphabet="ab é'.\n\t状12 s", max_size=120), st.integers(1, 9))
@settings(deadline=None, max_examples=200)
def test_ids_of_parts(text, size):
    """However a text is parted, its ids are those of the whole."""
    b = tokenize.bpe(PATH)
    assert list(b.ids(text[i : i + size] for i in range(0, len(text), size))) == b._whole_pieces(text)


def test_text_longer_than_a_part(library):
    rng = random.Random(6)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "don't", "éa", "1234", "状態", ".", "x" * 300]) for _ in range(60_000))
    assert len(text) > 4 * tokenize.PART and tokenize.bpe(PATH).encode(text) == library.encode(text, add_special_tokens=False).ids


def test_tokens_dirt(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a b", 5), (3, "a b", 5), (3, "a b", 5)], "doc_id int, text string, ids int")
    got = sorted((r.doc_id or 0, r.ids) for r in tokenize.encode(df, PATH).collect())
    assert got[1:3] == [(1, []), (2, [])] and got[0][1] == got[3][1] == got[4][1] != []
    assert tokenize.encode(df.limit(0), PATH).count() == 0


# ---- 9 leaks

@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=6), st.lists(st.lists(st.sampled_from("abc"), max_size=20), min_size=1, max_size=4))
@settings(deadline=None)
def test_leaks_against_grams(docs, tests):
    least = 5
    texts = [" ".join(d).upper() for d in docs]
    got = {(k, i) for k, i, _, _ in leakage.matches(texts, leakage.Suffixes([(i, "-".join(t)) for i, t in enumerate(tests)], least))}
    grams = lambda w: {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}
    assert got == {(k, i) for k, d in enumerate(docs) for i, t in enumerate(tests) if grams(d) & grams(t)}


def longest_runs(texts, tests, least):
    """Brute force: the longest common run of words of each text and test, the first of equal ones."""
    out = set()
    for k, d in enumerate(texts):
        for i, t in tests:
            best = (0, 0)
            for p in range(len(d)):
                for q in range(len(t)):
                    n = 0
                    while p + n < len(d) and q + n < len(t) and d[p + n] == t[q + n]:
                        n += 1
                    if n > best[0]:
                        best = (n, p)
            if best[0] >= least:
                out.add((k, i, *best))
    return out


@given(st.lists(st.lists(st.sampled_from("abcx"), max_size=30), min_size=1, max_size=5), st.lists(st.lists(st.sampled_from("abc"), max_size=20), min_size=1, max_size=4))
@settings(deadline=None)
def test_longest_matches(docs, tests):
    named = list(enumerate(tests))
    got = leakage.matches([" ".join(d) for d in docs], leakage.Suffixes([(i, " ".join(t)) for i, t in named], 4))
    assert len(got) == len(set(got)) and set(got) == longest_runs(docs, named, 4)


def test_repeating_passages_take_linear_time():
    """A passage that repeats itself, in documents that do so, too: its places are not multiplied."""
    import time

    took = []
    for n in (2_000, 16_000):
        t = time.time()
        assert leakage.matches([("a b " * n)] * 3, leakage.Suffixes([(1, "a b " * n), (2, "b a " * n)], 12)) == [(k, i, 2 * n - (i == 2), 0) for k in range(3) for i in (1, 2)]
        took.append(time.time() - t)
    assert took[1] < 40 * took[0] + 1


def test_blocks_of_tests_and_shards(spark, monkeypatch):
    rng = random.Random(2)
    ws = [f"w{i}" for i in range(300)]
    tests = [(i, " ".join(rng.choice(ws) for _ in range(30))) for i in range(20)]
    docs = [(k, "intro " + tests[k % 20][1][: 60 + 5 * k] + " end") for k in range(40)]
    a, b = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(tests, "item_id int, passage string")
    want = sorted(leakage.leaked_passages(a, b, 5).collect())
    assert len({r.doc_id for r in want}) == 40
    monkeypatch.setattr(leakage, "SHARD_CHARS", 150)
    assert sorted(leakage.leaked_passages(a, b, 5, test_chars=700).collect()) == want
    assert leakage.matches([d for _, d in docs], leakage.Suffixes(tests, 5)) == [(r.doc_id, r.item_id, r.n_words, r.word_position) for r in want]


def test_leak_dirt(spark):
    p = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, f"x {p.upper().replace(' ', ', ')} y", "k"), (2, None, ""), (3, "", ""), (4, p.replace("seven", "sevén"), ""), (5, p.replace("six", "siK"), "")], "doc_id int, text string, passage string")
    tests = spark.createDataFrame([(7, p), (8, None), (9, ""), (None, p)], "item_id int, passage string")
    got = leakage.leaked_passages(docs, tests).collect()
    assert [(r.doc_id, r.item_id, r.n_words, r.word_position) for r in got] == [(1, 7, 13, 1)]
    assert sorted(r.doc_id for r in leakage.without_leaks(docs, leakage.leaked_passages(docs, tests)).collect()) == [2, 3, 4, 5]
    assert leakage.leaked_passages(docs, tests.limit(0)).count() == 0 and leakage.leaked_passages(docs.limit(0), tests).count() == 0


# ---- 10 encodings

TEXT = "Der Schlüssel wird geprüft, größere Änderungen übernimmt das Gerät; la clé protégée est relevée après l'arrêt."


@pytest.mark.parametrize("taken", ["cp1252", "latin_1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850"])
def test_multibyte_repair(taken):
    bad = TEXT.encode().decode(taken, "replace")
    out, n, lost = encoding.repair(bad)
    assert n and (lost or out == TEXT)


@pytest.mark.parametrize("times", [1, 2, 3, 4, 6])
def test_garbled_many_times(times):
    bad = TEXT
    for _ in range(times):
        bad = bad.encode().decode("latin_1")
    assert encoding.repair(bad)[0] == TEXT


def test_both_kinds_in_one_text():
    """A part that went through a multibyte decoding, one that went through another single-byte encoding, and a lost sign."""
    good = "die Schlüssel prüfen später größere Geräte"
    other = good.encode("cp1252").decode("cp437")
    fine = "über Öl"
    out, n, lost = encoding.repair(f"{good.encode().decode('cp1252')} . {other} . {fine} . gr\ufffdn")
    assert out == f"{good} . {good} . {fine} . gr\ufffdn" and n and lost == 1


def test_twice_garbled():
    bad = TEXT.encode().decode("latin_1").encode().decode("latin_1")
    assert encoding.repair(bad)[0] == TEXT


@pytest.mark.parametrize("taken", ["cp437", "cp850", "mac_roman"])
def test_single_byte_repair(taken):
    bad = TEXT.encode("cp1252").decode(taken)
    out, n, _ = encoding.repair(bad)
    assert n and sum(a != b for a, b in zip(out, TEXT)) <= 2


@pytest.mark.parametrize("fine", [TEXT, "São Tomé, NÃO, AÇÃO – labels", "Σ xᵢ² ≤ ³√π · Ω, Ð and þ are letters", "château, âge, Å, Õ, ñandú – sort", "« l’été » : “Über” – 25 °C ±3 µs §4 kΩ", "Контроль завершён «да»", "状態が変わる。", "مرحبا", "└── cfg\n│   ├── a", "💨✅🚗", "isn’t “binding”…", "", None])
def test_correct_texts_stay(fine):
    assert encoding.repair(fine) == (fine, 0, 0)


def test_encoding_dirt(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "plain"), (4, "gr�n"), (None, "prÃ¼ft"), (None, "prÃ¼ft")], "doc_id int, text string")
    got = sorted((r.doc_id or 0, r.text or "", r.n_repaired, r.n_lost) for r in encoding.repair_encoding(df).collect())
    assert got == [(0, "prüft", 1, 0), (0, "prüft", 1, 0), (1, "", 0, 0), (2, "", 0, 0), (3, "plain", 0, 0), (4, "gr�n", 0, 1)]


def test_queries_of_the_package_stay_with_it():
    import __spark_entry__ as e

    from millrace.llm import queries

    assert set(queries.QUERIES) <= set(e.queries()) and set(queries.ORACLE) <= set(queries.QUERIES)
    assert all(re.match(r"p\d+_", n) for n in queries.QUERIES)
