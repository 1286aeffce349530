"""Near-duplicates by similarity: documents whose sets of five-word shingles have a Jaccard similarity of SIMILARITY or more.

Two methods bring candidates together. SimHash fingerprints of the shingles at 4 or fewer differing bits (op2's pigeonhole keys) give
the nearest ones. At similarity 0.8 fingerprints differ in some 10 of 64 bits, so MinHash bands add the others: of two sets at similarity 0.8 each of 32 bands of five hashes is equal with probability
0.33, so such a pair misses all bands with probability 3e-6, and a nearer one less often. Every link is verified on the whole
sets of 64-bit shingle hashes. Equal sets are one node, so copies never meet each other. First each node meets the least one of its
bucket in a few bands. Then every bucket that still spans components goes, with its nodes' sets, to tasks that compare all its pairs
from different components once: a bucket over BLOCK nodes in pairs of parts of it, so no bucket is brought together in one task,
and no row is made for a pair. So the links join exactly what chains of verified candidates join, in two steps at every size.

Null texts are empty; texts without words are copies of each other, a text of fewer than five words is one shingle. Rows with
a null doc_id take part and come last. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup, release, shuffle_partitions
from .graph import grown
from . import simhash
from .simhash import keep_rows, least_row, row_key

SHINGLE, SIMILARITY = 5, (4, 5)
BANDS, ROWS, SEED = 32, 5, 11
FIRST = 4  # bands whose buckets are looked at before the others
CACHED, VERIFY_ROWS = 100_000, 128
BLOCK = 256  # nodes of a bucket in one part
DENSE, COLUMNS = 4_000_000, 4096  # hashes of sets that are compared as a matrix, and its columns at a time
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingler():
    """A function from text to its sorted different shingle hashes."""
    from xxhash import xxh64_intdigest

    known: dict[bytes, int] = {}

    def shingles(text: str) -> np.ndarray:
        words = text.encode().lower().split()
        if len(known) > CACHED:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxh64_intdigest(w, SEED)
        w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(SHINGLE, len(w))
        h = np.full(max(0, len(w) - k + 1) if k else 0, k, np.uint64)
        for i in range(k):
            h = _mix(h + w[i : i + len(h)])
        return np.unique(h)

    return shingles


def node_of(s: np.ndarray) -> int:
    """The set's name, a signed long; 0 for the empty set."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(s.tobytes(), SEED)).view(np.int64)) if len(s) else 0


def fingerprint(s: np.ndarray) -> int:
    """The set's SimHash, a signed long: bits that over half of its hashes have; 0 for the empty set."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(s), 4096):
        ones += np.unpackbits(s[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(s), bitorder="little").view("<i8")[0])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the similarity."""
    p, q = SIMILARITY
    if q * min(len(a), len(b)) < p * max(len(a), len(b)):
        return False
    return (p + q) * len(np.intersect1d(a, b, assume_unique=True)) >= p * (len(a) + len(b))


def signed(df: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, node, n, fp, keys): the row's hashes, its set's name, size and fingerprint, and the set's band keys."""

    def run(batches):
        shingles, r = shingler(), np.random.default_rng(SEED)
        times, plus = r.integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for b in batches:
            if not b.num_rows:
                continue
            nodes, sizes, fps, keys = [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t)
                nodes.append(node_of(s))
                sizes.append(len(s))
                fps.append(fingerprint(s))
                low = np.full(BANDS * ROWS, ~np.uint64(0))
                for k in range(0, len(s), 1024):
                    low = np.minimum(low, (s[k : k + 1024, None] * times + plus).min(0))
                key = np.arange(BANDS, dtype=np.uint64)
                for c in low.reshape(BANDS, ROWS).T:
                    key = _mix(key + c)
                keys.append(key.view(np.int64))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), flat], names=["doc_id", "k1", "k2", "node", "n", "fp", "keys"])

    k1, k2 = row_key(df)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), text)
    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, node long, n int, fp long, keys array<long>")


def common(s: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many hashes the sets of each pair (a, b) share."""
    total = sum(map(len, s))
    if len(a) > 4 * len(s) and total <= DENSE:
        row = np.repeat(np.arange(len(s)), [len(x) for x in s])
        _, col, often = np.unique(np.concatenate(s), return_inverse=True, return_counts=True)
        kept = often > 1
        width = int(kept.sum())
        if len(a) > len(s) ** 2 * width // 150_000:  # else pair by pair is faster
            row, col = row[kept[col]], (np.cumsum(kept) - 1)[col[kept[col]]]
            order = np.argsort(col, kind="stable")
            row, col = row[order], col[order]
            met = np.zeros((len(s), len(s)), np.float32)
            for k in range(0, width, COLUMNS):
                i, j = np.searchsorted(col, [k, k + COLUMNS])
                m = np.zeros((len(s), min(COLUMNS, width - k)), np.float32)
                m[row[i:j], col[i:j] - k] = 1
                met += m @ m.T
            return met[a, b].astype(np.int64)
    return np.array([len(np.intersect1d(s[x], s[y], assume_unique=True)) for x, y in zip(a, b)], np.int64)


def links(roots: np.ndarray, part: np.ndarray, keys: np.ndarray, s: list[np.ndarray], band: int, crossed: bool) -> np.ndarray:
    """Pairs of roots that similar nodes of a bucket of ``band`` join, those of different parts if ``crossed``. Nodes that an
    earlier band has in one bucket too have met there."""
    p, q = SIMILARITY
    n = np.array([len(x) for x in s], np.int64)
    meet = np.triu(roots[:, None] != roots, 1) & (q * np.minimum(n[:, None], n) >= p * np.maximum(n[:, None], n))
    if crossed:
        meet &= part[:, None] != part
    for k in range(band):
        meet &= keys[:, k, None] != keys[:, k]
    a, b = np.nonzero(meet)
    ok = (p + q) * common(s, a, b) >= p * (n[a] + n[b])
    return np.unique(np.sort(np.stack([roots[a[ok]], roots[b[ok]]]), axis=0), axis=1)


def sets(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, keys, s): the sets of the nodes that ``wanted`` (k1, k2, node, keys) names by one row of ``df`` each."""

    def run(batches):
        shingles = shingler()
        for b in batches:
            out = [shingles(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("keys"), pa.array(out, pa.binary())], names=["node", "keys", "s"])

    k1, k2 = row_key(df)
    rows = df.select(k1.alias("k1"), k2.alias("k2"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.join(wanted, ["k1", "k2"]).dropDuplicates(["node"]).select("node", "keys", "text")
    return found.mapInArrow(run, "node long, keys array<long>, s binary")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, a mapping of rows that hold whole sets, cut with VERIFY_ROWS rows a batch."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = conf.get(name)
    conf.set(name, str(VERIFY_ROWS))
    try:
        return cut(df)
    finally:
        conf.set(name, usual)


def verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) that have the similarity."""

    def run(batches):
        for b in batches:
            ok = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column("x"), b.column("y"))]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(known.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(known.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    return small_batches(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def fits(x: str, y: str) -> Column:
    """Whether sets of these sizes can have the similarity at all."""
    p, q = SIMILARITY
    return F.least(x, y).cast("long") * q >= F.greatest(x, y).cast("long") * p


def joined(rows: DataFrame, facts: DataFrame, total: int) -> DataFrame:
    """``rows`` with the facts of their bucket. A bucket that many rows are in is broadcast."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("_size"))
    return lookup(rows, facts.join(sizes, "key").withColumnRenamed("_size", "n"), "key", total)


def first_pairs(buckets: DataFrame) -> DataFrame:
    """(a, b): each bucket's least node with its others, where their sizes fit."""
    total = buckets.count()
    least = buckets.groupBy("key").agg(F.min(F.struct("node", "size")).alias("m")).select("key", F.col("m.node").alias("head"), F.col("m.size").alias("head_size"))
    met = joined(buckets, least, total).where((F.col("node") != F.col("head")) & fits("size", "head_size"))
    return met.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()


def bucket_links(buckets: DataFrame, roots: DataFrame, known: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): the roots of components that similar nodes of one bucket join.

    Of buckets with the same nodes that of the least band stands for all. A bucket of more than ``block`` nodes is dealt into parts,
    and each of its nodes meets every part.
    """

    def run(batches):
        at, rows = None, []

        def found():
            r, part, band, keys, s = zip(*rows)
            sets_ = [np.frombuffer(x.as_buffer(), np.uint64) for x in s]
            got = links(np.array(r), np.array(part), np.stack([k.values.to_numpy() for k in keys]), sets_, band[0], at[1] != at[2])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], names=["a", "b"])

        for b in batches:
            names = list(zip(*(b.column(c).to_pylist() for c in ("key", "i", "j"))))
            row = zip(*(b.column(c).to_pylist() for c in ("root", "part", "band")), b.column("keys"), b.column("s"))
            for name, (root, part, band, keys, s) in zip(names, row):
                if name != at:
                    if len(rows) > 1:
                        yield found()
                    at, rows = name, []
                rows.append((root, part, band, keys, s))
        if len(rows) > 1:
            yield found()

    labelled = cut(buckets.join(roots, "node", "left").select("key", "band", "node", F.coalesce("root", "node").alias("root")))
    second = F.xxhash64(F.lit("second"), "node")
    per = labelled.groupBy("key").agg(F.min("band").alias("band"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(second).alias("y"), F.min("root").alias("least"), F.max("root").alias("most"))
    open_ = per.where("least <> most").groupBy("n", "x", "y").agg(F.min(F.struct("band", "key")).alias("m"))
    facts = cut(open_.select("m.key", "n", F.ceil(F.col("n") / block).cast("int").alias("parts")))
    rows = lookup(labelled, facts, "key", labelled.count()).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "node"), "parts").cast("int"))
    dealt = rows.select("key", "band", "node", "root", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("key", "band", "node", "root", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    place = ["key", "i", "j"]
    met = dealt.join(known, "node").repartition(shuffle_partitions(buckets.sparkSession), *place).sortWithinPartitions(*place)
    return small_batches(met.select(*place, "band", "root", "part", "keys", "s").mapInArrow(run, "a long, b long"))


def hashed_pairs(per: DataFrame) -> DataFrame:
    """(a, b): nodes by SimHash. Each node with the least of its fingerprint, and those of fingerprints that links join."""
    nodes = per.where("n > 0").select("node", "fp")
    least = cut(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")))
    same = least.where("n > 1").join(nodes, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    a, b = (least.select(F.col("fp").alias(x), F.col("least").alias("least_" + x)) for x in "ab")
    near = simhash.links(least.select("fp")).join(a, "a").join(b, "b").select(F.least("least_a", "least_b").alias("a"), F.greatest("least_a", "least_b").alias("b"))
    return cut(same.union(near).distinct())


def linked(df: DataFrame, per: DataFrame, first: int = FIRST, block: int = BLOCK) -> DataFrame:
    """(node, root) of the nodes that verified links join with others: root is the least node of the component.

    SimHash pairs and a few bands' buckets, each node with its bucket's least, are looked at first. That joins most of what belongs
    together, so in the buckets of all bands only nodes of different components are left to compare.
    """
    near = hashed_pairs(per)
    release(df.sparkSession)
    keyed = per.where("n > 0").select("node", F.col("n").alias("size"), F.posexplode("keys").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("nodes")).where("nodes > 1")
    buckets = cut(keyed.join(shared, "key", "left_semi").select("key", "node", "size", "band"))
    release(df.sparkSession)
    nodes = buckets.select("node").union(near.select("a")).union(near.select("b")).distinct()
    known = cut(sets(df, per.join(nodes, "node", "left_semi").select("first.k1", "first.k2", "node", "keys")))
    release(df.sparkSession)
    pairs = near.union(first_pairs(buckets.where(F.col("band") < first))).distinct()
    roots = grown(None, verified(pairs, known))
    release(df.sparkSession)
    return grown(roots, bucket_links(buckets, roots, known, block))


def keep_one(df: DataFrame, first: int = FIRST, block: int = BLOCK) -> DataFrame:
    """The rows of ``df``, all columns as they are, of which one of each near-duplicate group stays: the row with the least
    doc_id, rows without one last; of different texts with that doc_id the one whose hash is least."""
    per = cut(signed(df).groupBy("node").agg(least_row().alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    roots = linked(df, per, first, block)
    kept = per.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    return keep_rows(df, kept.select("first.k1", "first.k2"))
