"""The most similar vectors of every vector.

Method: NN-descent. A first neighbour graph comes from cells: every vector is put into the cells of its nearest centres
(sampled vectors, several sets of them), and each cell is compared within. Then the graph is joined with itself:
neighbours of neighbours, along edges in either direction, are compared and replace worse ones, until hardly any edge
changes. Equal directions are one point throughout and their members are added at the end, so copies fill no cell.
Cells that the sample shows to be overfull are split by the signs of what sets their vectors apart from the centre.

`floor` leaves out edges below a similarity. Without structure (independent directions in 64 dimensions) a graph can't
be followed to weak neighbours, which the strong ones don't depend on; `exact_graph` has no floor and compares all with all; see the README for figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stage

#: Sets of centres, cells a vector is put into by each, vectors a cell should hold, and the most that it may be expected to.
TABLES, PROBES, CELL, FULL = 2, 2, 700, 6_000
#: Most centres of one set, which every worker holds; with more vectors cells grow and are split.
CENTRES = 32_768
#: Sampled vectors by which the share of each cell is judged.
SAMPLE = 20_000
#: Neighbours kept for each point in the graph, rounds of descent at most, and the share of new edges that ends them.
KEPT, ROUNDS, STILL = 16, 4, 0.001
#: Ids that are sent to the vectors instead of shuffling the vectors to them.
IDS_TO_ALL = 1_000_000
#: Vectors of a block where all are compared with all.
BLOCK = 32_768


def usable(df: DataFrame, dims: int, key: str = "id", vector: str = "dense_vec") -> DataFrame:
    """(id, vec) of vectors that take part: not null, of the right length, of finite values not all zero, under a key."""
    vec = df.select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vec"))
    return vec.where(F.col("id").isNotNull() & (F.size("vec") == dims) & ~_bad("vec") & F.exists("vec", lambda x: x != 0))


def _bad(c: str) -> Column:
    return F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors of an array column without nulls."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    m = np.asarray(flat, np.float32).reshape(-1, dims)
    big = np.abs(m).max(axis=1, keepdims=True)
    m = m / np.where(big > 0, big, 1)  # so that no square overflows
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _directions(src: DataFrame, dims: int) -> DataFrame:
    """(id, h1, h2): two hashes of the direction, to six decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            if batch.num_rows:
                # adding 0 makes one zero of both
                rows = np.ascontiguousarray(np.round(_matrix(batch.column(1), dims), 6) + np.float32(0))
                h = np.array([(xxhash.xxh64_intdigest(r, 1), xxhash.xxh64_intdigest(r, 2)) for r in rows], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["id", "h1", "h2"])

    return src.mapInArrow(run, "id string, h1 long, h2 long")


class Cells:
    """The sets of centres, and how many sign bits each cell is split by."""

    def __init__(self, sample: np.ndarray, total: int, cell: int = CELL):
        rng = np.random.default_rng(11)
        c = int(min(CENTRES, max(1, total // cell), max(1, len(sample) // TABLES)))
        order = rng.permutation(len(sample))
        self.centres = [np.ascontiguousarray(sample[order[t * c : (t + 1) * c]]) for t in range(TABLES)]
        self.probes = [min(PROBES, len(x)) for x in self.centres]
        dims = sample.shape[1] if len(sample) else 1
        self.planes = rng.standard_normal((dims, 24)).astype(np.float32)
        self.bits = []
        judged = sample[order[-SAMPLE:]]
        for x, p in zip(self.centres, self.probes):
            share = np.bincount(self.nearest(judged, x, p).ravel(), minlength=len(x)) * (total / max(1, len(judged)))
            bits = np.ceil(np.log2(np.maximum(share / FULL, 1))).astype(np.int64)
            self.bits.append(np.minimum(np.where(bits > 0, bits + 1, 0), 24))

    @staticmethod
    def nearest(m: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
        out = np.empty((len(m), probes), np.int64)
        step = max(1, 8_000_000 // max(1, len(centres)))
        for a in range(0, len(m), step):
            s = m[a : a + step] @ centres.T
            out[a : a + step] = np.argpartition(-s, probes - 1, axis=1)[:, :probes] if probes < s.shape[1] else np.arange(probes)
        return out

    def assign(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every place a vector is put into."""
        rows, cells = [], []
        for t, (centres, probes, bits) in enumerate(zip(self.centres, self.probes, self.bits)):
            near = self.nearest(m, centres, probes)
            r = np.repeat(np.arange(len(m)), probes)
            c = near.ravel()
            b = bits[c]
            code = np.zeros(len(c), np.int64)
            full = np.flatnonzero(b)
            if len(full):
                # the parts of a full cell: signs of the difference to the centre, and once more with the least sure sign turned
                d = (m[r[full]] - centres[c[full]]) @ self.planes
                used = np.arange(24)[None, :] < b[full][:, None]
                sign = (d > 0) & used
                code[full] = (sign << np.arange(24)).sum(axis=1)
                weak = np.argmin(np.where(used, np.abs(d), np.inf), axis=1)
                rows.append(r[full])
                cells.append(((np.int64(t) * CENTRES + c[full]) << 24) | (code[full] ^ (1 << weak)))
            rows.append(r)
            cells.append(((np.int64(t) * CENTRES + c) << 24) | code)
        return np.concatenate(rows), np.concatenate(cells)


def _compare(ids: np.ndarray, m: np.ndarray, floor: float, kept: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Edges within one cell: for each row its `kept` most similar others of at least `floor`."""
    ps, qs, ss = [], [], []
    step = max(1, 4_000_000 // max(1, len(m)))
    for a in range(0, len(m), step):
        s = m[a : a + step] @ m.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        p, q = np.nonzero(s >= floor)
        v = s[p, q]
        if len(p):
            o = np.lexsort((-v, p))
            p, q, v = p[o], q[o], v[o]
            first = np.searchsorted(p, p)  # where a row's edges begin
            few = np.arange(len(p)) - first < kept
            ps.append(p[few] + a)
            qs.append(q[few])
            ss.append(v[few])
    return ps, qs, ss


EDGE = "v string, u string, s float"


def _top(edges: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("v").orderBy(F.desc("s"), "u")
    return edges.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def _vectors_of(src: DataFrame, ids: DataFrame) -> DataFrame:
    few = ids.count() <= IDS_TO_ALL
    return src.join(F.broadcast(ids) if few else ids, "id", "left_semi").dropDuplicates(["id"])


class Graph:
    """edges: (v, u, s) between representatives of directions, both ways; members: (id, h1, h2); reps: (h1, h2, rep, n)."""

    def __init__(self, edges: DataFrame, members: DataFrame, reps: DataFrame):
        self.edges, self.members, self.reps = edges, members, reps


def _points(df: DataFrame, dims: int, key: str, vector: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(usable vectors, members, reps, the vectors of one id of every direction)."""
    src = usable(df, dims, key, vector)
    members = stage(_directions(src, dims).groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("id", "h.h1", "h.h2"), "members")
    reps = members.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    reps = stage(reps.where("n > 1"), "reps")
    copies = members.join(reps, ["h1", "h2"]).where("id <> rep").select("id")
    n_copies = copies.count()
    points = src if not n_copies else src.join(F.broadcast(copies) if n_copies <= IDS_TO_ALL else copies, "id", "left_anti")
    return src, members, reps, points


def exact_graph(df: DataFrame, dims: int, k: int, key: str = "id", vector: str = "dense_vec", block: int = BLOCK) -> Graph:
    """The graph of the `k` most similar of every usable vector without a floor: blocks of vectors (by hash of the id)
    are compared each with each, so the work grows with the square of the vectors. Rows take part as in `build_graph`.

    A task holds two blocks; of each vector it hands on `k` for each other block."""
    spark = df.sparkSession
    _, members, reps, points = _points(df, dims, key, vector)
    total = members.count()
    if not total:
        return Graph(spark.createDataFrame([], EDGE), members, reps)
    n = max(1, -(-total // block))
    # of several deliveries of one key the same one is taken in every block
    points = stage(points.groupBy("id").agg(F.min("vec").alias("vec")).withColumn("b", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(n)).cast("int")), "points")

    def read(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(t.column("id").to_pylist(), object)
        o = np.argsort(ids, kind="stable")
        return ids[o], _matrix(t.column("vec").combine_chunks(), dims)[o]

    def against(left: pa.Table, right: pa.Table) -> pa.Table:
        vs, us, ss = [pa.array([], pa.string())], [pa.array([], pa.string())], [pa.array([], pa.float32())]
        if left.num_rows and right.num_rows:
            one, other = read(left), read(right)
            same = left.column("x")[0] == left.column("y")[0]
            for (a, ma), (b, mb) in ((one, other),) if same else ((one, other), (other, one)):
                for at in range(0, len(a), 512):
                    s = ma[at : at + 512] @ mb.T
                    if same:
                        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
                    q, v = _best(s, k)
                    p, j = np.nonzero(v > -2)
                    vs.append(pa.array(a[at + p], pa.string()))
                    us.append(pa.array(b[q[p, j]], pa.string()))
                    ss.append(pa.array(v[p, j]))
        return pa.table({"v": pa.concat_arrays(vs), "u": pa.concat_arrays(us), "s": pa.concat_arrays(ss)})

    # each pair of blocks once, the left one and the right one
    left = points.select(F.col("b").alias("x"), F.explode(F.sequence("b", F.lit(n - 1))).alias("y"), "id", "vec")
    right = points.select(F.explode(F.sequence(F.lit(0), "b")).alias("x"), F.col("b").alias("y"), "id", "vec")
    first = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(against, EDGE)
    return Graph(stage(_top(first, k), "edges"), members, reps)


def _best(s: np.ndarray, k: int, run: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of the `k` largest of every row: they lie in the `k` runs of columns with the largest maxima."""
    rows, n = s.shape
    if n > 2 * k * run:
        pad = -n % run
        s = np.pad(s, ((0, 0), (0, pad)), constant_values=-2) if pad else s
        most = s.reshape(rows, -1, run).max(axis=2)
        runs = np.argpartition(-most, k - 1, axis=1)[:, :k]
        cols = (runs[:, :, None] * run + np.arange(run)).reshape(rows, -1)
        vals = np.take_along_axis(s, cols, 1)
    else:
        cols, vals = np.broadcast_to(np.arange(n), s.shape), s
    o = np.argsort(-vals, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(cols, o, 1), np.take_along_axis(vals, o, 1)


def build_graph(df: DataFrame, dims: int, floor: float, key: str = "id", vector: str = "dense_vec", kept: int = KEPT, rounds: int = ROUNDS) -> Graph:
    """The neighbour graph of all usable vectors. Null, short, zero and not finite vectors take no part; a repeated key
    counts once, with its smallest direction if it has several; an empty table gives an empty graph.

    Shuffled are the ids once and the vectors once per cell they are put into; rounds shuffle edges, of which a point has
    `kept`, and the vectors of points with new candidates only. To the driver come the sample and counts."""
    spark = df.sparkSession
    src, members, reps, points = _points(df, dims, key, vector)
    total = members.count()
    if not total:
        return Graph(spark.createDataFrame([], EDGE), members, reps)
    size = min(total, max(SAMPLE, TABLES * min(CENTRES, total // CELL + 1)))
    # about `size` points by the hash of their ids, so that the sample is spread over all and the same each time
    some = points.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, size / total) * (1 << 30)) + 1).toArrow().sort_by("id")
    cells = Cells(_matrix(some.column("vec").combine_chunks(), dims) if some.num_rows else np.zeros((0, dims), np.float32), total)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                m = _matrix(part.column(1), dims)
                rows, where = cells.assign(m)
                unit = pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), dims).cast(pa.list_(pa.float32()))
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(where), part.column(0).take(take), unit.take(take)], names=["cell", "id", "vec"])

    def within(t: pa.Table) -> pa.Table:
        ids = np.array(t.column("id").to_pylist(), object)
        m = np.asarray(t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dims)
        ids, first = np.unique(ids, return_index=True)  # deliveries of one key
        ps, qs, ss = _compare(ids, m[first], floor, kept)
        if not ps:
            return pa.table({"v": pa.array([], pa.string()), "u": pa.array([], pa.string()), "s": pa.array([], pa.float32())})
        p, q, s = map(np.concatenate, (ps, qs, ss))
        return pa.table({"v": pa.array(ids[p], pa.string()), "u": pa.array(ids[q], pa.string()), "s": pa.array(s)})

    first = points.mapInArrow(put, "cell long, id string, vec array<float>").groupBy("cell").applyInArrow(within, EDGE)
    edges = stage(_top(_both(first), kept).withColumn("fresh", F.lit(True)), "edges")

    def similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.einsum("ij,ij->i", _matrix(batch.column("a"), dims), _matrix(batch.column("b"), dims))
                ok = pa.array(s >= floor)
                yield pa.RecordBatch.from_arrays([batch.column("v").filter(ok), batch.column("u").filter(ok), pa.array(s.astype(np.float32)).filter(ok)], names=["v", "u", "s"])

    for _ in range(rounds):
        # neighbours of neighbours: at least one of the two edges is new, and each point keeps `kept`, so lists are short
        a = edges.select(F.col("u").alias("mid"), F.col("v").alias("x"), F.col("fresh").alias("f1"))
        b = edges.select(F.col("v").alias("mid"), F.col("u").alias("y"), F.col("fresh").alias("f2"))
        near = a.join(b, "mid").where("x < y AND (f1 OR f2)").select(F.col("x").alias("v"), F.col("y").alias("u")).distinct()
        near = stage(near.join(edges.select("v", "u"), ["v", "u"], "left_anti"), "candidates")
        ids = stage(near.select(F.col("v").alias("id")).unionByName(near.select(F.col("u").alias("id"))).distinct(), "ids")
        vecs = stage(_vectors_of(src, ids), "vectors")
        found = near.join(vecs.select(F.col("id").alias("v"), F.col("vec").alias("a")), "v").join(vecs.select(F.col("id").alias("u"), F.col("vec").alias("b")), "u").mapInArrow(similarity, EDGE)
        after = edges.select("v", "u", "s", F.lit(False).alias("fresh")).unionByName(_both(found).withColumn("fresh", F.lit(True)))
        edges = stage(_top(after, kept), "edges")
        new, all_ = edges.agg(F.count_if("fresh"), F.count(F.lit(1))).first()
        if new <= STILL * all_:
            break
    return Graph(edges.select("v", "u", "s"), members, reps)


def _both(edges: DataFrame) -> DataFrame:
    """Edges in both directions, each once."""
    back = edges.select(F.col("u").alias("v"), F.col("v").alias("u"), "s")
    return edges.select("v", "u", "s").unionByName(back).groupBy("v", "u").agg(F.max("s").alias("s"))


def nearest(graph: Graph, k: int) -> DataFrame:
    """(id, neighbour, similarity, place): for every id the `k` most similar others that the graph has, copies included;
    of equal similarity the smaller id first. A copy's list needs the first k + 1 of its group only."""
    m = graph.members.join(graph.reps.select("h1", "h2", "rep"), ["h1", "h2"], "left").select("id", F.coalesce("rep", "id").alias("v"))
    copies = graph.members.join(graph.reps.select("h1", "h2", "rep"), ["h1", "h2"])
    w = Window.partitionBy("rep").orderBy("id")
    first = copies.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1).select(F.col("rep").alias("u"), "id")
    out = graph.edges.join(first, "u", "left").select("v", F.coalesce("id", "u").alias("neighbour"), "s")
    own = first.select(F.col("u").alias("v"), F.col("id").alias("neighbour"), F.lit(1.0).cast("float").alias("s"))
    by = Window.partitionBy("v").orderBy(F.desc("s"), "neighbour")
    lists = out.unionByName(own).withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list(F.struct("_n", "neighbour", "s"))).alias("all"))
    rest = m.join(lists, "v").select("id", F.slice(_without("all", "id"), 1, k).alias("all"))
    return rest.select("id", F.posexplode("all").alias("place", "x")).select("id", F.col("x.neighbour").alias("neighbour"), F.col("x.s").alias("similarity"), (F.col("place") + 1).alias("place"))


def _without(items: str, key: str) -> Column:
    return F.filter(items, lambda x: x["neighbour"] != F.col(key))


def search(df: DataFrame, queries: DataFrame, dims: int, k: int, key: str = "id", vector: str = "dense_vec", block: int = 4096) -> DataFrame:
    """(id, neighbour, similarity, place): the exact `k` nearest of a stated set of queries among all vectors, itself left
    out. Queries go to the workers in blocks, one pass over the vectors each; a task hands on k of each query."""
    src = usable(df, dims, key, vector)
    mine = usable(queries, dims, key, vector).dropDuplicates(["id"])
    count = mine.count()
    out = None
    blocks = max(1, -(-count // block))
    for b in range(blocks):
        part = mine.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)) == b).toArrow()
        if not part.num_rows:
            continue
        names, q = part.column("id").to_pylist(), _matrix(part.column("vec").combine_chunks(), dims)

        def run(batches: Iterator[pa.RecordBatch], names=names, q=q) -> Iterator[pa.RecordBatch]:
            best = np.full((len(q), k), -2, np.float32)
            who = np.full((len(q), k), "", object)
            where = {n: i for i, n in enumerate(names)}
            for batch in batches:
                for at in range(0, batch.num_rows, 8192):
                    p = batch.slice(at, 8192)
                    ids = np.array(p.column(0).to_pylist(), object)
                    s = q @ _matrix(p.column(1), dims).T
                    for j, x in enumerate(ids):
                        if x in where:
                            s[where[x], j] = -2
                    t = min(k, s.shape[1])
                    hit = np.flatnonzero(s.max(axis=1) >= best[:, -1])
                    if len(hit):
                        c = np.argpartition(-s[hit], t - 1, axis=1)[:, :t]
                        cs, cn = np.concatenate([best[hit], np.take_along_axis(s[hit], c, 1)], axis=1), np.concatenate([who[hit], ids[c]], axis=1)
                        for r, h in enumerate(hit):
                            o = sorted({n: (-float(v), n, i) for i, (v, n) in enumerate(zip(cs[r], cn[r])) if n}.values())[:k]
                            best[h], who[h] = -2, ""
                            for i, (v, n, _) in enumerate(o):
                                best[h, i], who[h, i] = -v, n
            i, j = np.nonzero(who != "")
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.array(names, object)[i], pa.string()), pa.array(who[i, j], pa.string()), pa.array(best[i, j])], names=["v", "u", "s"])

        one = src.mapInArrow(run, EDGE)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = df.sparkSession.createDataFrame([], EDGE)
    w = Window.partitionBy("v").orderBy(F.desc("s"), "u")
    return out.groupBy("v", "u").agg(F.max("s").alias("s")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(F.col("v").alias("id"), F.col("u").alias("neighbour"), F.col("s").alias("similarity"), "place")
