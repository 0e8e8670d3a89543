"""The same or nearly the same records in different splits.

Method: winnowing. Each field is reduced to its letters and digits; of the rolling hashes of every window the smallest is
kept, so any two fields with a common run of `window + gram - 1` characters share a kept hash. Kept hashes are joined
across the splits, each whole, however frequent: one that makes more than DIRECT pairs (a turn of phrase of the domain) is
spread by a salt. Of the pairs that this makes, those are dropped at once that the verdict would drop anyway, by a lower
bound of the words left over, from bit sets of the words of one side and of all that are near the other's; the others are
compared once each: words that both texts have are chained where they are collinear, chains are extended by alignment, and
what no chain covers is left over. Chains may stand in any order, as sentences may. A pair counts if in every field no more
than a share of the words is left over. Exact copies are one class throughout: classes are compared, and members are added
at the end.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stage

WORD = re.compile(r"[^\W_]+")
GRAM, WINDOW = 16, 16
#: Pairs across the splits up to which a seed is joined in one piece; one that makes more is salted.
DIRECT = 65_536
#: Pairs that a salted seed should make in one piece.
PAIRS_A_TASK = 500_000
#: 64-bit parts of the bit set of a field's words.
MARKS = 6
#: Longer words are not looked up among the near ones and never count as missing before the texts are compared.
LONG_WORD = 40
#: Words of a field that may be changed, added or dropped: a sixth, and what typing errors and lead-ins leave.
CHANGED = 0.2
LEAD_IN_WORDS = 4
#: Words that a chain may pass over, words it needs, and places of a word in both texts up to which it can begin or carry one.
GAP, CHAIN, PLACES = 8, 2, 16
#: What a link of a chain may cost in words passed over and in gaps that differ; beyond it another chain begins.
LINK = 1.5


def words(text: str | None) -> list[str]:
    return WORD.findall(unicodedata.normalize("NFKC", text or "").casefold())


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing of bits (the finaliser of a public hash function)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS = np.array([pow(1_000_003, GRAM - 1 - i, 1 << 64) for i in range(GRAM)], np.uint64)


def winnow(ws: list[str], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the kept grams of a field's characters; a short field has its one hash."""
    s = "".join(ws)
    if not s:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    chars = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        if len(chars) < GRAM:
            h = np.array([(chars * _POWERS[: len(chars)]).sum()], np.uint64)
        else:
            h = (np.lib.stride_tricks.sliding_window_view(chars, GRAM) * _POWERS).sum(axis=1, dtype=np.uint64)
        h = mixed(h + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    if len(h) <= WINDOW:
        i = np.array([len(h) - 1 - int(h[::-1].argmin())])
    else:
        view = np.lib.stride_tricks.sliding_window_view(h, WINDOW)[:, ::-1]
        i = np.unique(np.arange(len(view)) + WINDOW - 1 - view.argmin(axis=1))  # of equal ones the last
    return i, h[i]


def variants(w: str) -> set[str]:
    """What is left of a word without one letter or, where `near` allows two, two of them: near words share one."""
    out = {w[:i] + w[i + 1 :] for i in range(len(w))} if len(w) >= 3 else set()
    if len(w) >= 6:
        out |= {v[:i] + v[i + 1 :] for v in out for i in range(len(v))}
    return out | {w}


@lru_cache(1 << 18)
def near(a: str, b: str) -> bool:
    """Whether two words differ by typing: one or, in longer words, two letters changed, added, dropped or swapped."""
    if a == b:
        return True
    n, m = len(a), len(b)
    most = 1 if max(n, m) <= 7 else 2
    if abs(n - m) > most or min(n, m) < 3:
        return False
    prev2, prev = None, list(range(m + 1))
    for i in range(1, n + 1):
        row = [i] + [0] * m
        for j in range(1, m + 1):
            row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (a[i - 1] != b[j - 1]))
            if prev2 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], prev2[j - 2] + 1)
        prev2, prev = prev, row
    return prev[m] <= most


@lru_cache(1 << 18)
def _letters(w: str) -> int:
    """The letters of a word as bits; an edit changes two at most."""
    out = 0
    for c in w:
        out |= 1 << (ord(c) & 63)
    return out


def _rests(a: list[str], b: list[str]) -> tuple[Counter, Counter, dict[str, str]]:
    """The words of each side without an equal or near one on the other, as bags; and which word of a each near one of b is."""
    ca, cb = Counter(a), Counter(b)
    ra, rb = ca - cb, cb - ca
    same: dict[str, str] = {}
    others = [(x, _letters(x), len(x)) for x in rb]
    for w in list(ra):
        lw, nw = _letters(w), len(w)
        for x, lx, nx in others:
            if -3 < nw - nx < 3 and (lw ^ lx).bit_count() <= 4 and rb[x] > 0 and ra[w] > 0 and near(w, x):
                k = min(ra[w], rb[x])
                ra[w] -= k
                rb[x] -= k
                same[x] = w
    return ra, rb, same


def _share(rest: int, lead: int, n: int, size: int) -> float:
    """Of the words left over, without those of a short lead-in."""
    return (rest - (lead if lead <= LEAD_IN_WORDS and n > 2 * LEAD_IN_WORDS else 0)) / size


def least_left_over(a: list[str], b: list[str]) -> float:
    """No more than what `aligned` finds left over: words without a partner on the other side, wherever it stands."""
    if not a or not b:
        return 1.0
    size = max(len(a), len(b))
    ra, rb, _ = _rests(a, b)
    rests = [(sum(n for n in r.values() if n > 0), len(ws)) for ws, r in ((a, ra), (b, rb))]
    return max(_share(rest, min(rest, LEAD_IN_WORDS), n, size) for rest, n in rests)


def _matched(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of words, with bits as cells."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full, row = (1 << len(a)) - 1, 0
    for w in b:
        if m := where.get(w, 0):
            x = row | m
            row = x & ((x - (row << 1 | 1)) ^ x) & full
    return row.bit_count()


def _best_chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The best chain of seeds that stand in one order on both sides, none further than GAP words from the next: most
    seeds, less what its links cost."""
    score, back = [1.0] * len(seeds), [-1] * len(seeds)
    for k, (i, j) in enumerate(seeds):
        for m in range(k - 1, -1, -1):
            p, q = seeds[m]
            if i - p > GAP:
                break
            if p < i and 0 < j - q <= GAP:
                cost = 0.8 * abs((i - p) - (j - q)) + 0.25 * (i - p + j - q - 2)
                if cost <= LINK and score[m] + 1 - cost > score[k]:
                    score[k], back[k] = score[m] + 1 - cost, m
    k = max(range(len(seeds)), key=lambda x: score[x])
    out = []
    while k >= 0:
        out.append(seeds[k])
        k = back[k]
    return out[::-1]


def aligned(a: list[str], b: list[str]) -> tuple[float, float, float]:
    """(share left over, share of a covered, share of b covered) of two texts by chains of words in any order: first the
    chains, best ones first, then each is extended over the words around it that no chain has."""
    if not a or not b:
        return 1.0, 0.0, 0.0
    if a == b:
        return 0.0, 1.0, 1.0
    _, _, same = _rests(a, b)
    b = [same.get(w, w) for w in b]
    at_a: dict[str, list[int]] = {}
    for i, w in enumerate(a):
        at_a.setdefault(w, []).append(i)
    times = Counter(b)
    seeds = sorted((i, j) for j, w in enumerate(b) if w in at_a and len(at_a[w]) * times[w] <= PLACES for i in at_a[w])
    free_a, free_b = [True] * len(a), [True] * len(b)
    spans = []
    short = min(len(a), len(b)) <= 2 * CHAIN
    while seeds:
        chain = _best_chain(seeds)
        if len(chain) < CHAIN and not short:
            break
        (i0, j0), (i1, j1) = chain[0], chain[-1]
        spans.append((i0, i1, j0, j1))
        free_a[i0 : i1 + 1] = [False] * (i1 + 1 - i0)
        free_b[j0 : j1 + 1] = [False] * (j1 + 1 - j0)
        seeds = [(i, j) for i, j in seeds if free_a[i] and free_b[j]]
    matched, first_a, first_b = 0, len(a), len(b)
    for i0, i1, j0, j1 in spans:
        matched += _matched(a[i0 : i1 + 1], b[j0 : j1 + 1])
        first_a, first_b = min(first_a, i0), min(first_b, j0)
    for i0, i1, j0, j1 in spans:
        for ahead in (True, False):
            x, y = (_free(free_a, i1 + 1, 1), _free(free_b, j1 + 1, 1)) if ahead else (_free(free_a, i0 - 1, -1), _free(free_b, j0 - 1, -1))
            got = [k for k in x if a[k] in {b[m] for m in y}] if x and y else ()
            if got:
                matched += _matched([a[k] for k in x], [b[m] for m in y])
                hit = [m for m in y if b[m] in {a[k] for k in x}]
                first_a, first_b = min(first_a, *got), min(first_b, *hit)
                for k in x[: x.index(got[-1]) + 1]:
                    free_a[k] = False
                for m in y[: y.index(hit[-1]) + 1]:
                    free_b[m] = False
    size = max(len(a), len(b))
    left = max(_share(len(a) - matched, first_a, len(a), size), _share(len(b) - matched, first_b, len(b), size))
    return max(0.0, left), min(1.0, matched / len(a)), min(1.0, matched / len(b))


def _free(free: list[bool], at: int, step: int) -> list[int]:
    """Up to GAP places from `at` on that no chain has."""
    out: list[int] = []
    while 0 <= at < len(free) and free[at] and len(out) < GAP:
        out.append(at)
        at += step
    return out


def compared(texts: list[tuple[str, str]], changed: float = CHANGED) -> tuple[float, float, float] | None:
    """(share left over in the worst field, share of the first record's words covered, of the second's) of two records'
    fields, words parted by blanks; None if in a field more than `changed` is left over."""
    both = [(x.split(" "), y.split(" ")) for x, y in texts]
    if any(least_left_over(a, b) > changed for a, b in both):
        return None
    got = [aligned(a, b) for a, b in both]
    worst = max(g[0] for g in got)
    if worst > changed:
        return None
    na, nb = sum(len(a) for a, _ in both), sum(len(b) for _, b in both)
    return worst, sum(g[1] * len(a) for g, (a, _) in zip(got, both)) / na, sum(g[2] * len(b) for g, (_, b) in zip(got, both)) / nb


def _near_words(said: DataFrame) -> DataFrame:
    """(word, other): the words of `said` and each of its words that is `near`, itself included."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                got = [(w, v) for w in batch.column(0).slice(at, 1024).to_pylist() for v in variants(w)]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in got], pa.string()), pa.array([v for _, v in got], pa.string())], names=["word", "variant"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([near(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.bool_()))

    vocabulary = said.select("word").distinct()
    v = stage(vocabulary.where(F.length("word") <= LONG_WORD + 2).mapInArrow(spread, "word string, variant string"), "variants")
    both = v.join(v.withColumnRenamed("word", "other"), "variant").select("word", "other").distinct()
    return both.mapInArrow(check, "word string, other string")


def _bits(said: DataFrame, fields: int, side: str) -> DataFrame:
    """(c, a bit set of the words of each field) of rows (c, field, word)."""
    at = F.pmod(F.xxhash64("word"), F.lit(64 * MARKS)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % 64)
    parts = [F.coalesce(F.bit_or(F.when((F.col("field") == i) & (F.floor(F.col("at") / 64) == j), one)), F.lit(0).cast("long")).alias(f"{side}m{i}_{j}") for i in range(fields) for j in range(MARKS)]
    return said.select("c", "field", at.alias("at")).distinct().groupBy("c").agg(*parts)


def _may_agree(fields: int, changed: float) -> Column:
    """Whether a pair can have little enough left over in every field. What is counted here is never more than what
    `aligned` counts: the train side's distinct words without an equal or near one in the held-out record, less those
    whose bits fall together, and the difference in length; a lead-in is allowed for."""
    ok = F.lit(True)
    for i in range(fields):
        most = F.lit(changed) * F.greatest(f"xn{i}", f"yn{i}") + F.lit(LEAD_IN_WORDS + 1e-6)
        missing = sum((F.bit_count(F.col(f"xm{i}_{j}").bitwiseAND(F.bitwise_not(f"ym{i}_{j}"))) for j in range(MARKS)), F.lit(0))
        ok = ok & (F.abs(F.col(f"xn{i}") - F.col(f"yn{i}")) <= most) & (missing <= most)
    return ok


class Overlaps:
    """What `find` gives. members: class_id, id, side ('train' or 'held'), split. pairs: two classes that hold the
    same or nearly the same record, with the share of each one's words that chains cover and the share left over in the
    worst field."""

    def __init__(self, members: DataFrame, pairs: DataFrame):
        self.members, self.pairs = members, pairs

    def id_pairs(self) -> DataFrame:
        """(id_a, id_b) of all pairs of a train and a held-out record, smaller id first, members of classes included."""
        m = self.members
        train, held = m.where("side = 'train'"), m.where("side = 'held'")
        links = self.pairs.select("class_a", "class_b")
        links = links.unionByName(links.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
        links = links.unionByName(m.groupBy("class_id").agg(F.count_if(F.col("side") == "train").alias("t"), F.count_if(F.col("side") == "held").alias("h")).where("t > 0 AND h > 0").select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b")))
        a = train.select(F.col("class_id").alias("class_a"), F.col("id").alias("x"))
        b = held.select(F.col("class_id").alias("class_b"), F.col("id").alias("y"))
        return links.join(a, "class_a").join(b, "class_b").where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


    def coverage(self) -> DataFrame:
        """(id, split, side, n_partners, coverage) of every record that takes part: how many records of the other side it
        overlaps, and the largest share of its words that one of them covers. Partners are counted by class."""
        m = self.members
        sizes = m.groupBy("class_id").agg(F.count_if(F.col("side") == "train").alias("t"), F.count_if(F.col("side") == "held").alias("h"))
        p = self.pairs
        both = p.select(F.col("class_a").alias("class_id"), F.col("class_b").alias("other"), F.col("coverage_a").alias("coverage")).unionByName(p.select(F.col("class_b").alias("class_id"), F.col("class_a").alias("other"), F.col("coverage_b").alias("coverage")))
        both = both.unionByName(sizes.select("class_id", F.col("class_id").alias("other"), F.lit(1.0).alias("coverage")))
        links = both.join(sizes.withColumnRenamed("class_id", "other"), "other")
        of = lambda n: (F.sum(n), F.max(F.when(F.col(n) > 0, F.col("coverage"))))
        by = links.groupBy("class_id").agg(of("h")[0].alias("nh"), of("h")[1].alias("ch"), of("t")[0].alias("nt"), of("t")[1].alias("ct"))
        train = F.col("side") == "train"
        return m.join(by, "class_id").select("id", "split", "side", F.when(train, F.col("nh")).otherwise(F.col("nt")).alias("n_partners"), F.coalesce(F.when(train, F.col("ch")).otherwise(F.col("ct")), F.lit(0.0)).alias("coverage"))


def find(records: DataFrame, fields: tuple[str, ...] = ("user_input", "reference"), key: str = "id", split: str = "split", train: tuple[str, ...] = ("train",), held: tuple[str, ...] = ("dev", "test"), changed: float = CHANGED) -> Overlaps:
    """Overlaps between the train records and the held-out ones; every field must agree.

    Splits are compared without case and outer blanks; a null split or key takes no part, nor does a record with a field
    that holds no letter or digit (there is nothing to agree). Repeated deliveries of a key count once. Other columns are
    not read. Starts jobs that stage the records, the seeds and the pairs; classes, seeds and pairs stay distributed."""
    side = F.lower(F.trim(F.regexp_replace(F.col(split), r"^\s+|\s+$", "")))
    src = (
        records.select(F.col(key).cast("string").alias("id"), side.alias("split"), *fields)
        .where(F.col("id").isNotNull() & F.col("split").isin(*train, *held))
        .dropDuplicates(["id"])
        .withColumn("side", F.when(F.col("split").isin(*train), "train").otherwise("held"))
    )
    schema = "id string, split string, side string, " + ", ".join(f"f{i} string" for i in range(len(fields)))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [pa.array([" ".join(words(s)) for s in batch.column(3 + i).to_pylist()], pa.string()) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *cols], names=["id", "split", "side", *(f"f{i}" for i in range(len(fields)))])

    plain = src.select("id", "split", "side", *fields).mapInArrow(normal, schema)
    for i in range(len(fields)):
        plain = plain.where(F.col(f"f{i}") != "")
    plain = stage(plain.withColumn("class_id", F.md5(F.concat_ws("|", *(f"f{i}" for i in range(len(fields)))))), "records")
    members = plain.select("class_id", "id", "side", "split")
    texts = tuple(f"f{i}" for i in range(len(fields)))
    classes = plain.groupBy("class_id").agg(F.max((F.col("side") == "train").cast("int")).alias("train"), F.max((F.col("side") == "held").cast("int")).alias("held"), *(F.first(t).alias(t) for t in texts))
    # a short number for each class, fixed by being written
    classes = stage(classes.withColumn("c", F.monotonically_increasing_id()), "classes")

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, keys, of = [], [], []
                for f in range(len(fields)):
                    for r, s in enumerate(part.column(3 + f).to_pylist()):
                        h = np.unique(winnow(s.split(" "), f + 1)[1])
                        rows.append(np.full(len(h), r))
                        keys.append(h)
                        of.append(np.full(len(h), f, np.int8))
                if rows:
                    take = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([*(part.column(i).take(take) for i in range(3)), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(of))], names=["c", "train", "held", "seed", "field"])

    texts_of = classes.select("c", "train", "held", *texts)
    seeds = stage(texts_of.mapInArrow(seed, "c long, train int, held int, seed long, field byte"), "seeds")

    # a seed of one side only, or of one class alone, makes no pair
    counts = seeds.groupBy("seed").agg(F.sum("train").alias("nt"), F.sum("held").alias("nh")).where("nt > 0 AND nh > 0 AND nt + nh > 2 OR nt = 1 AND nh = 1")
    made = F.col("nt") * F.col("nh")
    salts = F.when(made > DIRECT, F.ceil(made / PAIRS_A_TASK) + 1).otherwise(1).cast("int")
    use = stage(seeds.drop("field").join(counts.select("seed", salts.alias("salts")), "seed"), "shared")
    sizes = [F.size(F.split(t, " ")).alias(f"n{i}") for i, t in enumerate(texts)]
    said = classes.select("c", "train", "held", F.posexplode(F.array(*texts)).alias("field", "text")).select("c", "train", "held", "field", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    held_said = said.where("held = 1").select("c", "field", "word")
    close = held_said.join(_near_words(said), "word").select("c", "field", F.col("other").alias("word")).unionByName(held_said)
    # the words' bits travel with the seeds, so that a pair is judged where it is made
    mx = stage(_bits(said.where(F.length("word") <= LONG_WORD).where("train = 1"), len(fields), "x").join(classes.select("c", *sizes), "c", "right").withColumnsRenamed({f"n{i}": f"xn{i}" for i in range(len(fields))}).withColumnRenamed("c", "xc"), "bits").na.fill(0)
    my = stage(_bits(close, len(fields), "y").join(classes.select("c", *sizes), "c").withColumnsRenamed({f"n{i}": f"yn{i}" for i in range(len(fields))}).withColumnRenamed("c", "yc"), "bits")
    a = use.where("train = 1").select("seed", F.pmod(F.xxhash64("c"), "salts").cast("int").alias("salt"), F.col("c").alias("xc")).join(mx, "xc")
    b = use.where("held = 1").select("seed", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("c").alias("yc")).join(my, "yc")
    links = a.hint("merge").join(b, ["seed", "salt"]).where((F.col("xc") != F.col("yc")) & _may_agree(len(fields), changed))
    candidates = stage(links.select(F.least("xc", "yc").alias("ca"), F.greatest("xc", "yc").alias("cb")).distinct(), "candidates")
    ta = classes.select(F.col("c").alias("ca"), F.col("class_id").alias("class_a"), *(F.col(t).alias(f"a{i}") for i, t in enumerate(texts)))
    tb = classes.select(F.col("c").alias("cb"), F.col("class_id").alias("class_b"), *(F.col(t).alias(f"b{i}") for i, t in enumerate(texts)))
    both = candidates.join(ta, "ca").join(tb, "cb").drop("ca", "cb")
    w = len(fields)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = {c: batch.column(c).to_pylist() for c in batch.schema.names if c not in ("class_a", "class_b")}
            keep, worst, cover_a, cover_b = [], [], [], []
            for r in range(batch.num_rows):
                got = compared([(d[f"a{i}"][r], d[f"b{i}"][r]) for i in range(w)], changed)
                if got:
                    keep.append(r)
                    worst.append(got[0])
                    cover_a.append(got[1])
                    cover_b.append(got[2])
            take = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("class_a").take(take), batch.column("class_b").take(take), *(pa.array(x, pa.float64()) for x in (worst, cover_a, cover_b))], names=["class_a", "class_b", "left_over", "coverage_a", "coverage_b"])

    pairs = stage(both.mapInArrow(align, "class_a string, class_b string, left_over double, coverage_a double, coverage_b double"), "pairs")
    return Overlaps(members, pairs)


def report(found: Overlaps, records: DataFrame, key: str = "id", sources: str = "source_documents") -> DataFrame:
    """(split, source, n_records, n_overlapping, n_partners, coverage): per split, train included, and source document the
    records that take part, those that overlap the other side, the partners that these have, and the mean share of their
    words that is covered. A record of several sources counts for each, one without any for the null source."""
    src = records.select(F.col(key).cast("string").alias("id"), sources).dropDuplicates(["id"])
    hit = F.col("n_partners") > 0
    by = found.coverage().join(src, "id").select("split", "n_partners", "coverage", F.explode_outer(F.array_distinct(sources)).alias("source")).groupBy("split", "source")
    return by.agg(F.count(F.lit(1)).alias("n_records"), F.count_if(hit).alias("n_overlapping"), F.sum("n_partners").alias("n_partners"), F.round(F.avg(F.when(hit, F.col("coverage"))), 6).alias("coverage"))
