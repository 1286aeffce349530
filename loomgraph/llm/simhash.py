"""SimHash near-duplicates: pigeonhole blocks find close fingerprints, then their Hamming distance is verified.

64 bits are split into 7 blocks. At most 4 differing bits leave at least 3 blocks equal, so each of the 35 choices of three
blocks is a key, and every close pair shares one. Only distinct fingerprints are keyed; copies never meet each other. In a
bucket a search from each fingerprint links it to those it reaches, so a bucket of n members gives n - 1 links, not all
pairs. Buckets beyond ``bucket_limit`` distinct fingerprints go another exact way that is linear in their size: two
fingerprints at 4 bits or fewer share a point at 2 bits or fewer from both, so each meets its least fellow at such points.

Null texts are empty; texts without words have fingerprint zero and link like any other. Repeated rows share a component.
Rows with a null doc_id take part; a component of only such rows has a null component_id. An empty table gives no rows.
Other columns of the input are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, lookup, map_texts, shuffle_partitions, texts
from .graph import components

SHINGLE, DISTANCE, SEED = 4, 4, 42
BLOCKS = ((0, 10), (10, 9), (19, 9), (28, 9), (37, 9), (46, 9), (55, 9))
BUCKET_LIMIT = 4096
SLICE = 65_536


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash; bits set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    raw = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, n, SLICE):
        h = np.array([xxh64_intdigest(raw[a:z], SEED) for a, z in zip(starts[k : k + SLICE], stops[k : k + SLICE])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def make():
        return lambda batch: {"fp": np.array([fingerprint(t, shingle) for t in batch], np.uint64).view(np.int64)}

    return map_texts(texts(df), make, "fp long")


def block_keys(fp: Column) -> Column:
    """Array of one key per choice of three blocks."""
    bits = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1)) for at, n in BLOCKS]
    out = []
    for k, (a, b, c) in enumerate(combinations(range(len(BLOCKS)), 3)):
        out.append(F.lit(k << 40).bitwiseOR(F.shiftleft(bits[a], 20)).bitwiseOR(F.shiftleft(bits[b], 10)).bitwiseOR(bits[c]))
    return F.array(*out)


def forest(fp: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, first member) of the groups that fingerprints within ``distance`` chain together."""
    left = np.arange(len(fp))
    member, head = [], []
    while len(left) > 1:
        first, left = left[0], left[1:]
        queue = [first]
        while queue and len(left):
            near = np.bitwise_count(fp[left] ^ fp[queue.pop()]) <= distance
            got = left[near]
            if len(got):
                left = left[~near]
                queue += got.tolist()
                member.append(got)
                head.append(np.full(len(got), first))
    none = np.zeros(0, np.int64)
    return fp[np.concatenate([none, *member])], fp[np.concatenate([none, *head])]


def near_points(distance: int = DISTANCE) -> list[int]:
    """Masks of up to distance / 2 bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for k in range((distance + 1) // 2 + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, bucket_limit: int = BUCKET_LIMIT, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``fp``: they join exactly what chains of close pairs join."""
    if distance > 4:
        raise ValueError("seven blocks, three of them equal, find distances of up to 4")

    def search(batches):
        out_a, out_b, out_hot = [], [], []

        def groups(key: np.ndarray, fp: np.ndarray, size: np.ndarray, start: np.ndarray) -> None:
            for n in range(2, 9):  # small groups of one size together: all their pairs, at most 28 a group
                s = start[size == n]
                for i, j in combinations(range(n), 2) if len(s) else ():
                    near = np.bitwise_count(fp[s + i] ^ fp[s + j]) <= distance
                    out_a.append(fp[s + i][near])
                    out_b.append(fp[s + j][near])
            for s, n in zip(start[size > 8].tolist(), size[size > 8].tolist()):
                a, b = forest(fp[s : s + n], distance)
                out_a.append(a)
                out_b.append(b)

        def flush():
            a, b = np.concatenate([np.zeros(0, np.uint64), *out_a]), np.concatenate([np.zeros(0, np.uint64), *out_b])
            hot = np.concatenate([np.zeros(0, np.uint64), *out_hot])
            for c in (out_a, out_b, out_hot):
                c.clear()
            edge = np.unique(np.stack([a, b]), axis=1)
            hot = np.unique(hot)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([x, hot]).view(np.int64)) for x in edge] + [pa.array(np.arange(edge.shape[1] + len(hot)) >= edge.shape[1])], names=["a", "b", "hot"]
            )

        key, fp, over = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for b in batches:
            key = np.concatenate([key, b.column("key").to_numpy()])
            fp = np.concatenate([fp, b.column("fp").to_numpy().view(np.uint64)])
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            if not len(start):
                continue
            if over is not None and key[0] == over:  # the rest of a bucket that is over the limit
                stop = start[1] if len(start) > 1 else len(key)
                out_hot.append(fp[:stop])
                key, fp = key[stop:], fp[stop:]
                start = start[1:] - stop
                if not len(start):
                    yield flush()
                    continue
            last = start[-1]
            groups(key, fp, np.diff(start), start[:-1])
            key, fp, over = key[last:], fp[last:], None
            if len(key) > bucket_limit:
                over = key[-1]
                out_hot.append(fp)
                key, fp = key[:0], fp[:0]
            yield flush()
        if len(key) > 1:
            groups(key, fp, np.array([len(key)]), np.array([0]))
        yield flush()

    n = shuffle_partitions(distinct.sparkSession)
    keyed = distinct.select("fp", F.explode(block_keys(F.col("fp"))).alias("key")).repartition(n, "key").sortWithinPartitions("key")
    found = cut(keyed.mapInArrow(search, "a long, b long, hot boolean"))
    edges = found.where("NOT hot").select("a", "b")
    hot = found.where("hot").select(F.col("a").alias("fp")).distinct()
    masks = near_points(distance)
    points = hot.select("fp", F.explode(F.lit(masks)).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b <> top").select("point", "b")
    met = points.join(least, "point").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return edges.union(met).distinct()


def labelled(docs: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``docs`` (doc_id, fp and more; a checkpoint) with component_id, the least doc_id of all documents linked."""
    per = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    n_fp, n_docs = per.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    roots = components(links(per.select("fp"), bucket_limit)).withColumnRenamed("node", "fp")
    owned = cut(per.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = owned.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    of = lookup(owned.select("root", "fp", "copies"), least, "root", n_fp)
    return lookup(docs, of.select("fp", "component_id", F.col("copies").alias("n")), "fp", n_docs)


def near_duplicates(df: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """doc_id, fingerprint, component_id per document."""
    found = labelled(cut(fingerprints(df)), bucket_limit)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_key(df: DataFrame) -> list[Column]:
    """Two hashes that name a row by its doc_id and text."""
    row = [F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))]
    return [F.xxhash64(*row), F.xxhash64(F.lit("second"), *row)]


def least_row(doc_id: str = "doc_id") -> Column:
    """Aggregate: the row of a group that stays, by the least doc_id (nulls last), then by the row's hashes k1 and k2."""
    return F.min(F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("doc_id"), "k1", "k2"))


def keep_rows(df: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``df`` with the hashes (k1, k2) in ``kept``, one of each. Copies of one row are cut before the shuffle."""
    names = [f"__{x}_{len(df.columns)}" for x in ("k1", "k2", "copy")]
    keyed = df.select("*", *[c.alias(n) for c, n in zip(row_key(df), names)])
    one = keyed.withColumn(names[2], F.row_number().over(Window.partitionBy(*names[:2]).orderBy(names[0]))).where(F.col(names[2]) == 1)
    return one.join(kept.select(F.col("k1").alias(names[0]), F.col("k2").alias(names[1])), names[:2], "left_semi").drop(*names)


def keep_one(df: DataFrame) -> DataFrame:
    """The rows of ``df``, all columns as they are, of which one of each near-duplicate group stays.

    It is the row with the least doc_id, rows without one last; of different texts with that doc_id the one whose hash is least.
    Rows decide for themselves: of rows that repeat a doc_id each stays that stands for its group.
    """
    keys = dict(zip(("k1", "k2"), row_key(df)))

    def make():
        return lambda batch: {"fp": np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64)}

    rows = df.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(n) for n, c in keys.items()]).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = cut(map_texts(rows, make, "fp long", "struct<doc_id: long, k1: long, k2: long>").select("doc_id.*", "fp"))
    per = cut(docs.groupBy("fp").agg(least_row().alias("first")))
    roots = components(links(per.select("fp"))).withColumnRenamed("node", "fp")
    kept = per.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    return keep_rows(df, kept.select("first.k1", "first.k2"))
