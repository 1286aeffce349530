"""Approximate nearest neighbours by largest inner product: an NN-descent graph and greedy graph search, both as Spark joins.

Equal vectors form a class with one node. The graph starts from blocks of a few random-projection trees; in each NN-descent
round every node's neighbours, forward and reverse, meet at that node and keep whom they find nearer than their own farthest
neighbour. Only pairs with a neighbour that is new since the last round meet, and rounds go on, at every size, until few edges
change. Queries start from their node's neighbours and go on, best unvisited nodes first, in rounds of joins. Graph and
search work on 8-bit directions with each vector's own norm beside them, so no vector's norm coarsens another's code; the
nodes that remain are scored on the original vectors in double precision.

An approximate method: reverse neighbours that meet at a node are limited to ``width``, as NN-descent is defined. Every
vector is a node of the graph. Members of a class beyond the ``top + 1`` smallest ids can't be among a query's results.

Vectors that are null, empty, zero, or that hold nulls or non-finite numbers take no part, nor do rows without an id. Where
vectors differ in length, those of the commonest length take part (of equally common ones the greatest). Of rows that repeat
an id each different vector is one candidate. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, lookup, shuffle_partitions

TOP, NEIGHBOURS, WIDTH = 20, 24, 48
TREES, BLOCK, EMIT = 6, 512, 6
STILL = 0.01  # the descent ends when a smaller share of the edges is new
BEAM, STEP_EMIT, POOL = 64, 32, 256
ROUNDS = 2  # search rounds a job; a plan of r rounds has 2^r - 1 of them in it, whose shuffles are shared
SEED = 7

_EDGE = "u long, w long, sim float, fresh boolean"


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal values."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(key)))


def by_group(key: str, fn: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """A mapInArrow function for rows sorted by ``key``: fn gets tables that hold whole groups."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(key).to_numpy()
            last = int(np.searchsorted(k, k[-1]))
            if last or held and held[-1].column(key)[-1].as_py() != k[0]:
                held += [b.slice(0, last)] if last else []
                yield from fn(pa.Table.from_batches(held).combine_chunks())
                held = [b.slice(last)]
            else:
                held.append(b)
        if held:
            yield from fn(pa.Table.from_batches(held).combine_chunks())

    return run


def grouped(df: DataFrame, key: str, fn: Callable, schema: str) -> DataFrame:
    n = shuffle_partitions(df.sparkSession)
    return df.repartition(n, key).sortWithinPartitions(key).mapInArrow(by_group(key, fn), schema)


def _edges(u: np.ndarray, w: np.ndarray, sim: np.ndarray, fresh: np.ndarray | None = None) -> pa.RecordBatch:
    fresh = np.ones(len(u), bool) if fresh is None else fresh
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(w, pa.int64()), pa.array(sim, pa.float32()), pa.array(fresh)], names=["u", "w", "sim", "fresh"])


def best_per_node(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest different w of each u; of edges that come twice the one that isn't fresh."""

    def keep(t: pa.Table):
        u, w, sim, fresh = (t.column(c).to_numpy() for c in ("u", "w", "sim", "fresh"))
        o = np.lexsort((fresh, w, u))
        u, w, sim, fresh = u[o], w[o], sim[o], fresh[o]
        new = np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
        u, w, sim, fresh = u[new], w[new], sim[new], fresh[new]
        o = np.lexsort((w, -sim, u))
        start, size = runs(u)
        o = o[np.arange(len(u)) - np.repeat(start, size) < k]
        yield _edges(u[o], w[o], sim[o], fresh[o])

    return grouped(edges, "u", keep, _EDGE)


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col("v")
    return (
        df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
        .where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
        .where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    )


def unpack(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a column of codes as a matrix of vectors."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return decoded(np.frombuffer(b"".join(a.to_pylist()), "u1").reshape(len(a), -1))


def decoded(raw: np.ndarray) -> np.ndarray:
    """Vectors from rows of code bytes: a float32 scale, then 8-bit coordinates."""
    return np.ascontiguousarray(raw[:, 4:]).view("i1").astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view("<f4")


def quantised(nodes: DataFrame, dim: int) -> DataFrame:
    """(id, q): each vector's scale and its coordinates in 8 bits, the largest of which is 127."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("v").flatten().to_numpy().reshape(b.num_rows, dim)
            top = np.abs(x).max(1, keepdims=True)
            q = np.concatenate([(top / 127).astype("<f4").view("u1"), np.rint(x / top * 127).astype("i1").view("u1")], 1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r.tobytes() for r in q], pa.binary())], names=["id", "q"])

    return nodes.select("id", "v").mapInArrow(run, "id long, q binary")


def first_graph(coded: DataFrame, dim: int, n: int, k: int, trees: int, block: int) -> DataFrame:
    """Edges from brute force in blocks that random hyperplanes make; blocks over ``block`` nodes are cut along one more."""
    bits = max(0, int(np.ceil(np.log2(max(1, n) / block))))

    def leaves(batches):
        r = np.random.default_rng(SEED).standard_normal((trees, dim, bits + 1))
        for b in batches:
            if not b.num_rows:
                continue
            x = unpack(b.column("q"))
            for t in range(trees):
                side = x @ r[t]
                leaf = (side[:, :bits] > 0) @ (1 << np.arange(bits)) + (t << 40) if bits else np.full(len(x), t << 40)
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(side[:, bits], pa.float64()), b.column("id"), b.column("q")], names=["leaf", "along", "id", "q"])

    def brute(t: pa.Table):
        start, size = runs(t.column("leaf").to_numpy())
        ids, x = t.column("id").to_numpy(), unpack(t.column("q"))
        for a, m in zip(start.tolist(), size.tolist()):
            parts = -(-m // block)
            for p in range(parts):
                lo, hi = a + p * m // parts, a + (p + 1) * m // parts
                for c in range(lo, hi, 512):  # rows against their block, in slices of bounded memory
                    d = min(hi, c + 512)
                    s = x[c:d] @ x[lo:hi].T
                    s[np.arange(d - c), np.arange(c - lo, d - lo)] = -np.inf
                    m1 = min(k, hi - lo - 1)
                    if m1 > 0:
                        at = np.argpartition(-s, m1 - 1, axis=1)[:, :m1]
                        yield _edges(np.repeat(ids[c:d], m1), ids[lo:hi][at].ravel(), np.take_along_axis(s, at, 1).ravel())

    parts = shuffle_partitions(coded.sparkSession)
    dealt = coded.mapInArrow(leaves, "leaf long, along double, id long, q binary").repartition(parts, "leaf").sortWithinPartitions("leaf", "along")
    return cut(best_per_node(dealt.mapInArrow(by_group("leaf", brute), _EDGE), k))


def both_ways(graph: DataFrame, width: int) -> DataFrame:
    """(v, m, sim, fresh): every node v with its forward and reverse neighbours m, the ``2 * width`` nearest. Spark applies the
    limit before the shuffle too, so the reverse neighbours of a hub never come together."""
    near = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "m"))
    both = graph.select(F.col("u").alias("v"), F.col("w").alias("m"), "sim", "fresh").union(graph.select(F.col("w").alias("v"), F.col("u").alias("m"), "sim", "fresh"))
    return both.withColumn("near", near).where(F.col("near") <= 2 * width).drop("near")


def descend(graph: DataFrame, coded: DataFrame, k: int, width: int, emit: int) -> DataFrame:
    """One NN-descent round: neighbours of a node meet there, new ones with all, old ones with new ones."""
    # nodes without a new neighbour leave here, by a window over the rows as they lie already: no second table, shuffle or sort
    met = both_ways(graph, width).withColumn("live", F.max("fresh").over(Window.partitionBy("v"))).where("live").drop("live")
    known = coded.select(F.col("id").alias("m"), "q").join(graph.groupBy(F.col("u").alias("m")).agg(F.min("sim").alias("limit")), "m", "left")

    def meet(t: pa.Table):
        start, size = runs(t.column("v").to_numpy())
        ids, sim, limit, fresh = (t.column(c).to_numpy(zero_copy_only=False) if c == "fresh" else t.column(c).to_numpy() for c in ("m", "sim", "limit", "fresh"))
        x = unpack(t.column("q"))
        for a, n in zip(start.tolist(), size.tolist()):
            at = a + np.lexsort((~fresh[a : a + n], ids[a : a + n]))
            at = at[np.concatenate([[True], ids[at][1:] != ids[at][:-1]])]
            if len(at) > width:
                at = at[np.argpartition(-sim[at], width - 1)[:width]]
            new = fresh[at]
            if len(at) < 2 or not new.any():
                continue
            s = x[at] @ x[at].T
            np.fill_diagonal(s, -np.inf)
            s[np.ix_(~new, ~new)] = -np.inf
            e = min(emit, len(at) - 1)
            best = np.argpartition(-s, e - 1, axis=1)[:, :e]
            value = np.take_along_axis(s, best, 1)
            row, col = np.nonzero((value > limit[at][:, None]) | (np.isnan(limit[at])[:, None] & (value > -np.inf)))
            if len(row):
                yield _edges(ids[at][row], ids[at][best[row, col]], value[row, col])

    found = grouped(met.join(known, "m"), "v", lambda t: joined(meet(t)), _EDGE)
    return cut(best_per_node(graph.withColumn("fresh", F.lit(False)).unionByName(found), k))


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer, larger batches."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows > 50_000:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def packed(graph: DataFrame, coded: DataFrame, width: int) -> DataFrame:
    """(id, ids, block): a node's neighbours, the ``width`` nearest of both directions, and their vectors in one value."""

    def pack(t: pa.Table):
        start, size = runs(t.column("v").to_numpy())
        v, ids, sim, q = t.column("v").to_numpy(), t.column("m").to_numpy(), t.column("sim").to_numpy(), t.column("q").to_pylist()
        rows = []
        for a, n in zip(start.tolist(), size.tolist()):
            _, first = np.unique(ids[a : a + n], return_index=True)
            at = a + first
            if len(at) > width:
                at = at[np.argpartition(-sim[at], width - 1)[:width]]
            rows.append((v[a], ids[at].tolist(), b"".join([q[i] for i in at.tolist()])))
            if len(rows) == 2000:
                yield _packed(rows)
                rows = []
        if rows:
            yield _packed(rows)

    known = coded.select(F.col("id").alias("m"), "q")
    return grouped(both_ways(graph, width).join(known, "m"), "v", pack, "id long, ids array<long>, block binary")


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["id", "ids", "block"])


_STATE = "u long, w long, sim float, visited boolean, frontier boolean"


def ranked(pool: DataFrame, beam: int, keep: int) -> DataFrame:
    """Of each query's pool the ``keep`` best nodes, and of those not yet visited the ``beam`` best as the next frontier."""

    def merge(t: pa.Table):
        u, w, sim, seen = (t.column(c).to_numpy(zero_copy_only=False) if c == "visited" else t.column(c).to_numpy() for c in ("u", "w", "sim", "visited"))
        o = np.lexsort((~seen, w, u))
        u, w, sim, seen = u[o], w[o], sim[o], seen[o]
        new = np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
        u, w, sim, seen = u[new], w[new], sim[new], seen[new]
        o = np.lexsort((w, -sim, u))
        start, size = runs(u)
        place = np.arange(len(u)) - np.repeat(start, size)
        fresh = ~seen[o]
        before = np.cumsum(fresh) - fresh
        nth = before - np.repeat(before[start], size)
        frontier = fresh & (nth < beam) & (place < keep)
        o, frontier = o[place < keep], frontier[place < keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array(u[o]), pa.array(w[o]), pa.array(sim[o], pa.float32()), pa.array(seen[o] | frontier), pa.array(frontier)], names=["u", "w", "sim", "visited", "frontier"]
        )

    return grouped(pool, "u", merge, _STATE)


def directions(nodes: DataFrame) -> DataFrame:
    """(u, own): the nodes' unit vectors as queries."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("f4")
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["u", "own"])

    return nodes.select("id", "v").mapInArrow(run, "u long, own binary")


def search(graph: DataFrame, coded: DataFrame, own: DataFrame, beam: int, keep: int, width: int, emit: int, rounds: int = ROUNDS) -> DataFrame:
    """(u, w): each query node's nearest nodes by greedy search from the node itself, until its ``keep`` best have all been visited.

    own: the queries, from directions(). rounds: how many rounds go into one job; they share the shuffles of the node table.
    """
    node = cut(packed(graph, coded, width))
    own = cut(own)
    state = own.select("u", F.col("u").alias("w"), F.lit(-1e9).cast("float").alias("sim"), F.lit(True).alias("visited"), F.lit(True).alias("frontier"))

    def visit(batches):
        for b in batches:
            out_u, out_w, out_s = [], [], []
            for u, own_, ids, block in zip(b.column("u").to_pylist(), b.column("own").to_pylist(), b.column("ids"), b.column("block").to_pylist()):
                x = np.frombuffer(own_, "f4")
                w = ids.values.to_numpy()
                s = decoded(np.frombuffer(block, "u1").reshape(len(w), -1)) @ x
                s[w == u] = -np.inf
                best = np.argpartition(-s, emit - 1)[:emit] if len(s) > emit else np.arange(len(s))
                best = best[s[best] > -np.inf]
                out_u.append(np.full(len(best), u))
                out_w.append(w[best])
                out_s.append(s[best])
            if out_u:
                yield _edges(np.concatenate(out_u), np.concatenate(out_w), np.concatenate(out_s))

    # a round without a frontier changes nothing, so it doesn't matter where among the rounds the state is written
    while not state.where("frontier").isEmpty():
        for _ in range(rounds):
            ahead = state.where("frontier").select("u", F.col("w").alias("id")).join(own, "u").join(node, "id").select("u", "own", "ids", "block")
            found = ahead.mapInArrow(visit, _EDGE).drop("fresh").withColumn("visited", F.lit(False))
            state = ranked(state.drop("frontier").unionByName(found), beam, keep)
        state = cut(state)
    return state.select("u", "w")


def build(coded: DataFrame, dim: int, n: int, trees: int = TREES, block: int = BLOCK) -> DataFrame:
    """The neighbour graph: NN-descent rounds from the trees' blocks until fewer than STILL of the edges are new."""
    graph = first_graph(coded, dim, n, NEIGHBOURS, trees, block)
    while True:
        graph = descend(graph, coded, NEIGHBOURS, WIDTH, EMIT)
        edges, fresh = graph.agg(F.count("*"), F.count_if("fresh")).first()
        if fresh <= STILL * edges:
            return graph


def nearest(df: DataFrame, every: int = 20, top: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of each row whose id is divisible by ``every``."""
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors(df, id_col, vector_col)
    is_query = F.col("vec_id") % every == 0
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim = sizes["dim"]
    # one node per vector; of each the queries, and the least ids, one more than asked for as a query doesn't find itself
    rows = cut(rows.where(F.size("v") == dim).distinct())
    classes = cut(rows.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))
    n, members = classes.agg(F.count("*"), F.sum("n")).first()
    same = lookup(rows, classes, "v", members).select("id", "vec_id")
    classes = classes.drop("n")
    # the least ids of each class, found without bringing a class together: by partial top lists
    small = _least_members(same, top + 1)
    coded = cut(quantised(classes, dim))
    graph = build(coded, dim, n, trees, block)
    asked = cut(same.where(is_query).select(F.col("vec_id").alias("query_id"), "id"))
    per = cut(asked.groupBy("id").agg(F.count("*").alias("n")))
    own = directions(classes.join(per.select("id"), "id", "left_semi"))
    found = search(graph, coded, own, BEAM, POOL, WIDTH, STEP_EMIT)
    best = best_by_score(found.union(per.select("id", "id")), classes, top)
    # every query of a class, against the least members of the classes found
    hits = lookup(asked, best.withColumnRenamed("u", "id").join(per, "id"), "id", members)
    hits = hits.select("query_id", F.col("w").alias("id"), "score").join(small, "id").where("vec_id <> query_id")

    def cut_off(t: pa.Table):
        q, v, s = (t.column(c).to_numpy() for c in ("query_id", "vec_id", "score"))
        o = np.lexsort((v, -s, q))
        start, size = runs(q)
        place = np.arange(len(q)) - np.repeat(start, size)
        o, place = o[place < top], place[place < top]
        yield pa.RecordBatch.from_arrays([pa.array(q[o]), pa.array(place + 1, pa.int32()), pa.array(v[o]), pa.array(s[o])], names=["query_id", "rank", "vec_id", "score"])

    return grouped(hits.select("query_id", "vec_id", "score"), "query_id", cut_off, schema)


def _least_members(same: DataFrame, k: int) -> DataFrame:
    """(id, vec_id): the k least members of each class, salted first so that a class of any size is dealt out."""
    n = shuffle_partitions(same.sparkSession)
    part = same.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(n)))
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("id", "salt").orderBy("vec_id"))).where(F.col("r") <= k)
    return part.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))).where(F.col("r") <= k).select("id", "vec_id")


def best_by_score(found: DataFrame, classes: DataFrame, top: int) -> DataFrame:
    """(u, w, score): pairs of nodes scored on the original vectors, the best top + 1 of each u."""
    mine, other = classes.select(F.col("id").alias("u"), F.col("v").alias("a")), classes.select(F.col("id").alias("w"), F.col("v").alias("b"))

    def score(batches):
        for b in batches:
            if b.num_rows:
                x, y = (b.column(c).flatten().to_numpy().reshape(b.num_rows, -1) for c in ("a", "b"))
                yield pa.RecordBatch.from_arrays([b.column("u"), b.column("w"), pa.array((x * y).sum(1))], names=["u", "w", "score"])

    scored = found.join(other, "w").join(mine, "u").mapInArrow(score, "u long, w long, score double")

    def keep(t: pa.Table):
        u, w, s = (t.column(c).to_numpy() for c in ("u", "w", "score"))
        o = np.lexsort((w, -s, u))
        start, size = runs(u)
        o = o[np.arange(len(u)) - np.repeat(start, size) < top + 1]
        yield pa.RecordBatch.from_arrays([pa.array(u[o]), pa.array(w[o]), pa.array(s[o])], names=["u", "w", "score"])

    return grouped(scored, "u", keep, "u long, w long, score double")
