"""Best-two-fit packing of token pieces into fixed-length sequences.

Packing needs lengths only, and there are at most ``capacity`` different ones, so the packer works on a histogram of
``capacity`` counts whatever the input's size: it makes bin patterns with a repeat count. Each pattern is filled greedily
(largest length, then the largest that fits); then its smallest document gives way to two unpacked ones that fill the gap
more tightly. Documents get a rank within their length (counted in salted buckets, so that a length held by a third of all
documents is no hot key), and the rank picks the pattern's sequence and offset.

Null texts are empty: one piece that holds the end token alone. Repeated rows are documents of their own. An empty table
gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, shuffle_partitions, texts

CAPACITY, END_ID = 1024, 2
SIMPLE = 0x250  # below this code point the letter and number classes of all Unicode versions agree
CACHE_PIECES, CACHE_CHARS = 400_000, 64  # pieces kept at a time, and their length at most


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(SIMPLE) if unicodedata.category(chr(c))[0] == kind)


_L, _N, _S = _class("L"), _class("N"), "\t-\r \x85\xa0"
# The byte-level pre-tokeniser's split, its alternatives that begin with different characters put in order of frequency.
SPLIT = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
BEYOND = re.compile(f"[^\0-{chr(SIMPLE - 1)}]")


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Byte strings of a byte-level vocabulary: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(c): c for c in plain} | {chr(0x100 + k): c for k, c in enumerate(c for c in range(256) if c not in set(plain))}
    return {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if all(c in byte for c in t)}


class Tokens(dict):
    """Little-endian ids of a text by its pre-tokenised pieces, each merged once.

    A piece is merged by tiktoken over the same file's vocabulary, whose ids are in merge order. Texts with characters
    beyond SIMPLE go to the tokenizers library whole. Strings of special tokens are ordinary text.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        ranks = byte_ranks({t: i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t not in special})
        self.merge = tiktoken.Encoding("pieces", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self) > CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if BEYOND.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, SPLIT.findall(text)))


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, the first shorter where they don't come out even."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of every document's pieces."""

    def run(batches):
        tokens, end = Tokens(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = tokens.encode(text) + end
                for k, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, k, start, length, zlib.crc32(part), part))
            if rows:
                cols = list(zip(*rows))
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return texts(df).mapInArrow(run, schema)


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths that share a sequence, number of such sequences) that use up the histogram ``counts``."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a length is out of range")
    order = sorted(left)
    out = []

    def largest(most: int, used: dict[int, int]) -> int:
        at = bisect.bisect_right(order, most) - 1
        while at >= 0 and left[order[at]] <= used.get(order[at], 0):
            at -= 1
        return order[at] if at >= 0 else 0

    while order:
        used: dict[int, int] = {}
        gap = capacity
        while gap and (n := largest(gap, used)):
            used[n] = used.get(n, 0) + 1
            gap -= n
        if gap and len(used) + sum(used.values()) > 2:
            small = min(used)
            used[small] -= 1
            room = gap + small
            best = (small, ())
            at = bisect.bisect_right(order, room - order[0]) - 1
            while at >= 0 and 2 * order[at] >= best[0] and best[0] < room:
                a = order[at]
                if left[a] > used.get(a, 0):
                    used[a] = used.get(a, 0) + 1
                    b = largest(min(a, room - a), used)
                    used[a] -= 1
                    if b and a + b > best[0]:
                        best = (a + b, (a, b))
                at -= 1
            for n in best[1] or (small,):
                used[n] = used.get(n, 0) + 1
        used = {n: c for n, c in used.items() if c}
        times = min(left[n] // c for n, c in used.items())
        out.append(([n for n in sorted(used, reverse=True) for _ in range(used[n])], times))
        for n, c in used.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
                order.pop(bisect.bisect_left(order, n))
    return out


def slots(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank of each run of slots, its first sequence, slots a sequence, and the first slot's offset."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for lengths, times in patterns:
        at = 0
        for n in dict.fromkeys(lengths):
            c = lengths.count(n)
            runs.setdefault(n, []).append((taken.get(n, 0), sequence, c, at))
            taken[n] = taken.get(n, 0) + c * times
            at += c * n
        sequence += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*r)) for n, r in runs.items()}


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows that have a ``length`` of 1 to capacity.

    The driver gets the histogram of lengths, ``capacity`` counts at most. How many pieces of a length stand in the buckets
    before a piece's own comes by a window over the counts of the buckets.
    """
    spark = parts.sparkSession
    fields = [f for f in parts.schema.fields if f.name not in ("sequence_id", "offset")]
    buckets = shuffle_partitions(spark)
    parts = cut(parts.select([f.name for f in fields]).withColumn("_b", F.pmod(F.xxhash64(*[f.name for f in fields if f.name != "ids"]), F.lit(buckets)).cast("int")))
    per = parts.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(best_two_fit(counts, capacity)))
    earlier = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("length", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    order = [F.col(f.name) for f in fields if f.name not in ("length", "ids")]
    ranked = parts.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_b").orderBy(*order))).join(per, ["length", "_b"])

    def run(batches):
        runs = table.value
        for b in batches:
            n = b.column("length").to_numpy()
            rank = b.column("_before").to_numpy() + b.column("_r").to_numpy() - 1
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for length in np.unique(n).tolist():
                at = np.flatnonzero(n == length)
                first, seq, each, start = runs[length]
                k = np.searchsorted(first, rank[at], "right") - 1
                q, rest = np.divmod(rank[at] - first[k], each[k])
                sequence[at] = seq[k] + q
                offset[at] = start[k] + rest * length
            yield pa.RecordBatch.from_arrays(
                [b.column(f.name) for f in fields] + [pa.array(sequence), pa.array(offset)], names=[f.name for f in fields] + ["sequence_id", "offset"]
            )

    return ranked.mapInArrow(run, T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of every document with its place: sequence_id and offset, gapless from 0."""
    return place(pieces(df, tokenizer_path, capacity, end_id, with_ids), capacity)
