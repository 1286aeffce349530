"""Removal of repeated strings by difference-cover suffix arrays over content-anchored buckets.

Strings are of bytes or of words (Unit). Every window of ``length`` symbols has an anchor: the place of the least hash of
``gram`` symbols (leftmost on ties) among its first ``reach`` places. Equal windows have equal anchors at equal offsets, so
they share the ``length - reach + 1`` symbols that follow the anchor. Anchors are dealt by the hash of those symbols; an anchor
whose symbols occur once has no repeated window and goes no further. What is left is dealt to buckets, and the text of the
buckets gets a suffix array by the difference-cover algorithm (sort sampled triples, recurse on their names, merge the
remaining suffixes); neighbours in it are compared symbol for symbol. Before that, slices leave that share with no other of
their bucket the half of the reach to the left or to the right that any of their windows holds.

Two things are decided by hashes instead of a comparison: an anchor's windows that occur as a whole elsewhere (88 bits over all
of them and 64 over the shared symbols), and, by 128 bits, the windows of buckets with more than ``bucket_rows`` different members (a passage in very many contexts), which are dealt at
random, counted within each task first and then by key. So no group has to fit into a task, and none is dealt to one.

Null texts are empty; texts shorter than ``length`` lose nothing. Equal texts, and repeated rows, are documents of their own:
from ``length`` symbols on they lose everything. An empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_SHARE, cut, release, shuffle_partitions, texts


@dataclass(frozen=True)
class Unit:
    """What strings are made of ("bytes" or "words", which whitespace parts), and their least length."""

    kind: str
    length: int
    reach: int
    gram: int

    def check(self) -> None:
        if self.length < self.reach + self.gram or not 2 <= self.reach <= 1024:
            raise ValueError("length has to be at least reach + gram, and reach 2 to 1024")

    @property
    def width(self) -> int:
        """Bytes a symbol in a slice."""
        return 1 if self.kind == "bytes" else 8


LENGTH, PASSAGE = 400, 50
BYTES = Unit("bytes", LENGTH, 160, 16)
#: A passage's first and last word may be joined to what stands around it, so its inner words are what has to match.
WORDS = Unit("words", PASSAGE - 2, 45, 3)
BUCKET_ROWS = 256
MOST_TIMES = (1 << 19) - 1  # counts within a batch go no further
SORTED = 1 << 16  # symbols that share a suffix array, at least
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = np.uint64(0xD6E8FEB86659FD93)
PART = 1 << 20  # symbols of a text that are looked at together
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
GAP = re.compile(rb"[\x20\x09-\x0D]")


def difference_cover_order(s: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of non-negative integers by the difference cover {1, 2} of 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64) + 1, np.zeros(3, np.int64)])
    symbols = int(t.max()) + 1
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    if symbols < 1 << 21:  # a triple fits one integer
        key = (t[sample] * symbols + t[sample + 1]) * symbols + t[sample + 2]
        o = np.argsort(key, kind="stable")
        by_triple, same = sample[o], key[o[1:]] == key[o[:-1]]
    else:
        by_triple = sample[np.lexsort((t[sample + 2], t[sample + 1], t[sample]))]
        same = np.ones(len(by_triple) - 1, bool)
        for k in range(3):
            same &= t[by_triple[1:] + k] == t[by_triple[:-1] + k]
    names = np.cumsum(np.concatenate([[True], ~same])) - 1
    rank = np.zeros(n + 4, np.int64)
    if names[-1] + 1 == len(sample):
        order = by_triple
    else:
        name_at = np.zeros(n + 4, np.int64)
        name_at[by_triple] = names
        order = sample[difference_cover_order(name_at[sample])]
    rank[order] = np.arange(1, len(order) + 1)
    order = order[order < n]
    rest = np.arange(0, n, 3)
    wide = np.int64(len(sample) + 2)
    rest = rest[np.argsort(t[rest] * wide + rank[rest + 1], kind="stable")]
    ones, twos = order[order % 3 == 1], order[order % 3 == 2]
    below_one = np.searchsorted(t[ones] * wide + rank[ones + 1], t[rest] * wide + rank[rest + 1])
    pair = lambda i: t[i] * symbols + t[i + 1]
    if float(symbols) ** 2 * float(wide) < 2**63:
        below_two = np.searchsorted(pair(twos) * wide + rank[twos + 2], pair(rest) * wide + rank[rest + 2])
    else:  # pairs as dense names, so that three keys fit one integer
        _, dense = np.unique(np.concatenate([pair(twos), pair(rest)]), return_inverse=True)
        below_two = np.searchsorted(dense[: len(twos)] * wide + rank[twos + 2], dense[len(twos) :] * wide + rank[rest + 2])
    out = np.empty(n, np.int64)
    at = np.arange(len(rest)) + below_one + below_two
    out[at] = rest
    free = np.ones(n, bool)
    free[at] = False
    out[free] = order
    return out


def repeated_starts(parts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each sequence, ascending, where a string of ``length`` symbols starts that starts elsewhere in the sequences too."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    start = np.cumsum(sizes + 1) - sizes - 1
    end = np.zeros(1, parts[0].dtype)
    flat = np.concatenate([x for p in parts for x in (p, end)])
    s = flat.astype(np.int64) if flat.dtype == np.uint8 else np.unique(flat, return_inverse=True)[1].astype(np.int64)
    s[start + sizes] = max(256, int(s.max()) + 1) + np.arange(len(parts))  # ends differ: nothing matches across them
    room = np.repeat(start + sizes, sizes + 1) - np.arange(len(s))
    order = difference_cover_order(s)
    order = order[room[order] >= length]
    hit = np.zeros(len(s), bool)
    windows = np.lib.stride_tricks.sliding_window_view(flat, length)
    for k in range(0, len(order) - 1, 16384):
        a, b = order[k : k + 16384], order[k + 1 : k + 16385]
        a = a[: len(b)]
        near = flat[a + length - 1] == flat[b + length - 1]  # most neighbours differ, and most of these at the end
        a, b = a[near], b[near]
        alike = (windows[a] == windows[b]).all(1)
        hit[a[alike]] = True
        hit[b[alike]] = True
    return [np.flatnonzero(hit[a : a + n]) for a, n in zip(start.tolist(), sizes.tolist())]


_tables: dict[tuple[int, int], np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    """Powers of ``base`` or its inverse, at least n of them."""
    for key in ((base, 1), (base, -1)):
        if key not in _tables or len(_tables[key]) < n:
            step = base if key[1] == 1 else pow(base, -1, 1 << 64)
            _tables[key] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, step, np.uint64))])
    return _tables[base, 1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


BYTE_VALUE = [mixed(np.arange(1, 257, dtype=np.uint64) + np.uint64(k << 32)) for k in range(2)]


class Hashes:
    """Hashes of any spans of a sequence: polynomial prefix sums modulo 2**64, shifted back by the inverse power. Two kinds,
    of different bases and symbol values."""

    def __init__(self, symbols: np.ndarray, kind: int = 0) -> None:
        self.base = BASES[kind]
        with np.errstate(over="ignore"):
            powers = _table(self.base, len(symbols) + 1)
            value = BYTE_VALUE[kind][symbols] if symbols.dtype == np.uint8 else mixed(symbols + np.uint64(1 + (kind << 32)))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * powers[: len(symbols)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * _tables[self.base, -1][start] + (end - start).astype(np.uint64))


def word_edges(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word. Long texts are read in parts that end between words."""
    out, at = [], 0
    while at < len(raw):
        stop = len(raw)
        if at + PART < stop:
            gap = GAP.search(raw, at + PART)
            stop = gap.end() if gap else stop
        part = np.frombuffer(raw, np.uint8, stop - at, at)
        edge = np.flatnonzero(np.diff(~SPACE[part], prepend=False, append=False)).reshape(-1, 2)
        out.append((Hashes(part).of(edge[:, 0], edge[:, 1]), edge[:, 0] + at, edge[:, 1] + at))
        at = stop
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(none, *out))


def symbols(raw: bytes, unit: Unit) -> np.ndarray:
    return np.frombuffer(raw, np.uint8) if unit.kind == "bytes" else word_edges(raw)[0]


def anchors(s: np.ndarray, unit: Unit) -> Iterator[tuple[np.ndarray, ...]]:
    """(shared, whole, check, anchor, lo, hi) arrays: windows starting at lo..hi have that anchor; hashes as signed integers.

    Long texts come in overlapping parts of PART windows; a part's first and last ranges may be halves of one range, which
    is as good: equal windows still meet by the symbols after their anchor.
    """
    length, reach = unit.length, unit.reach
    for base in range(0, max(0, len(s) - length + 1), PART):
        part = s[base : base + PART + length - 1]
        n = len(part) - length + 1
        h, second = Hashes(part), Hashes(part, 1)
        at = np.arange(n + reach - 1)
        low = h.of(at, at + unit.gram) >> np.uint64(24) << np.uint64(24)
        # least hash of each window by doubling; the place rides in the low bits, so that ties go left
        least, width = low | (at & 0xFFFFFF).astype(np.uint64), 1
        while 2 * width <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < reach:
            least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
        place = (least[:n] & np.uint64(0xFFFFFF)).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        hi = np.append(lo[1:], n) - 1
        anchor = place[lo]
        offset = (anchor - lo).astype(np.uint64)
        with np.errstate(over="ignore"):
            yield (
                (h.of(anchor, anchor + length - reach + 1) + np.uint64(unit.kind == "words")).view(np.int64),
                (h.of(lo, hi + length) ^ offset).view(np.int64),
                (second.of(lo, hi + length) ^ offset).view(np.int64),
                *(x + base for x in (anchor, lo, hi)),
            )


def keyed(docs: DataFrame) -> DataFrame:
    """Adds h1, h2: a text is named by 96 bits of hashes, so a rerun of a lost task names it alike."""
    return docs.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.shiftright(F.xxhash64(F.lit("second"), F.col("text")), 32))


def _runs(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    if len(at):
        edge = np.flatnonzero(np.diff(at) > 1)
        yield from zip(at[np.append(0, edge + 1)].tolist(), at[np.append(edge, len(at) - 1)].tolist())


def meeting(rows: list[tuple], unit: Unit) -> list[tuple]:
    """Of a bucket's slices (.., anchor, lo, .., bytes last) those that share a half of the reach with another one."""
    half, w = unit.reach // 2, unit.width
    shared, keys = unit.length - unit.reach + 1, []
    for _, _, _, anchor, lo, _, raw in rows:
        off = anchor - lo
        left = raw[(off - half) * w : (off + shared) * w] if off >= half else None
        right = raw[off * w : (off + unit.length - half + 1) * w]
        keys.append((left, right if len(right) == (unit.length - half + 1) * w else None))
    lefts, rights = Counter(k for k, _ in keys), Counter(k for _, k in keys)
    return [r for r, (a, b) in zip(rows, keys) if a is not None and lefts[a] > 1 or b is not None and rights[b] > 1]


def hot_texts(docs: DataFrame) -> DataFrame:
    """(h1, h2) of the texts that more than a 1 / HOT_SHARE of all rows have, HOT_SHARE texts at most."""
    limit = max(1, docs.count() // HOT_SHARE)
    return cut(docs.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("h1", "h2"))


def repeated_spans(docs: DataFrame, hot: DataFrame, units: tuple[Unit, ...] = (BYTES,), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(h1, h2, unit, start, end): spans of repeated strings in the texts with these hashes, in symbols of units[unit]; spans
    may overlap. docs: from keyed(); hot: from hot_texts().
    """
    if len(units) > 2:
        raise ValueError("one or two units")
    for u in units:
        u.check()
    n = shuffle_partitions(docs.sparkSession)

    def find(batches):
        """One row for each different (shared, whole, check) of a batch, with its count. The other places of a class go through
        as ``direct``: they are repeated for certain, and are dealt at random, so a common line makes no hot key."""
        for b in batches:
            parts = []
            for text, h1, h2 in zip(b.column("text"), b.column("h1").to_pylist(), b.column("h2").to_pylist()):
                raw = text.as_buffer().to_pybytes()
                for k, unit in enumerate(units):
                    if len(raw) >= unit.length:
                        for *found, anchor, lo, hi in anchors(symbols(raw, unit), unit):
                            m = len(lo)
                            parts.append((*found, np.full(m, h1), np.full(m, h2) << 32 | lo, np.full(m, k) << 20 | (anchor - lo) << 10 | (hi - lo)))
            if not parts:
                continue
            shared, whole, check, h1, place, small = (np.concatenate(x) for x in zip(*parts))
            o = np.lexsort((check, whole, shared))
            direct = np.zeros(len(o), bool)
            a, z = o[:-1], o[1:]
            direct[z] = (shared[a] == shared[z]) & (whole[a] == whole[z]) & (check[a] == check[z])
            first = np.flatnonzero(~direct[o])
            times = np.zeros(len(o), np.int64)
            times[o[first]] = np.minimum(np.diff(np.append(first, len(o))), MOST_TIMES)
            with np.errstate(over="ignore"):
                shared[direct] = mixed((h1[direct] + place[direct]).view(np.uint64)).view(np.int64)
            # five numbers a row, as this is the largest shuffle: the text's second name with the place, 24 bits of the second hash
            # with the count and the offsets
            small |= times << 21 | (check << 40)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shared, whole, h1, place, small)], names=["shared", "whole", "h1", "place", "small"])

    least = min(u.length for u in units)
    found = docs.where(F.octet_length("text") >= least).mapInArrow(find, "shared long, whole long, h1 long, place long, small long")
    counted = F.shiftright("small", 21).bitwiseAND(F.lit(MOST_TIMES))
    check, direct = F.shiftrightunsigned("small", 40), counted == 0
    per_class, per_bucket = Window.partitionBy("shared", "whole", check, direct), Window.partitionBy("shared")
    found = found.repartition(n, "shared").select(
        "shared", "h1", F.shiftright("place", 32).alias("h2"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"), "small", direct.alias("direct"),
        F.sum(counted).over(per_bucket).alias("n_shared"),
        F.sum(counted).over(per_class).alias("n_whole"),
        F.row_number().over(per_class.orderBy("h1", "place")).alias("copy"),
    )
    found = found.withColumn("wanted", F.expr("n_shared > n_whole AND copy = 1 AND NOT direct"))
    found = found.withColumn("members", F.sum(F.col("wanted").cast("int")).over(per_bucket)).where("n_shared > 1 OR direct")
    unit = F.shiftright("small", 20).bitwiseAND(F.lit(1))
    live = cut(
        found.select(
            "shared", "h1", "h2", unit.cast("int").alias("unit"), "lo", (F.col("lo") + F.shiftright("small", 10).bitwiseAND(F.lit(1023))).alias("anchor"),
            (F.col("lo") + F.col("small").bitwiseAND(F.lit(1023))).alias("hi"), F.expr("n_whole > 1 OR direct").alias("known"), "wanted", (F.col("members") > bucket_rows).alias("hot"),
        )
    )
    del found
    release(docs.sparkSession)
    span = F.element_at(F.array(*[F.lit(u.length) for u in units]), F.col("unit") + 1)
    whole = live.where("known").select("h1", "h2", "unit", F.col("lo").alias("start"), (F.col("hi") + span).alias("end"))
    wanted = live.where("wanted").groupBy("h1", "h2").agg(F.collect_list(F.struct("shared", "unit", "anchor", "lo", "hi", "known", "hot")).alias("want"))

    def slices(batches):
        names = ["deal", "h1", "h2", "anchor", "lo", "kind", "bytes"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        for b in batches:
            rows = []
            for text, h1, h2, want in zip(b.column("text"), *(b.column(c).to_pylist() for c in ("h1", "h2", "want"))):
                raw, read = text.as_buffer().to_pybytes(), {}
                for w in want:
                    k = w["unit"]
                    if k not in read:
                        read[k] = raw if units[k].kind == "bytes" else symbols(raw, units[k])
                    piece = read[k][w["lo"] : w["hi"] + units[k].length]
                    deal = w["shared"] if not w["hot"] else (h1 ^ w["lo"] * 0x9E3779B97F4A7C15) % (1 << 63)
                    rows.append((deal, h1, h2, w["anchor"], w["lo"], k << 2 | w["hot"] << 1 | w["known"], piece if isinstance(piece, bytes) else piece.tobytes()))
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    key = ["h1", "h2"]
    plain = docs.select(*key, "text")
    once = plain.join(F.broadcast(hot), key).groupBy(*key).agg(F.first("text").alias("text"))  # one of each hot text, cut before the shuffle
    bucketed = (
        plain.join(F.broadcast(hot), key, "left_anti").unionByName(once)
        .join(wanted, key)
        .dropDuplicates(key)
        .mapInArrow(slices, "deal long, h1 long, h2 long, anchor long, lo long, kind int, bytes binary")
        .repartition(n, "deal")
        .sortWithinPartitions("deal")
    )

    def sort_buckets(batches):
        """Spans (times null) of the buckets, and windows with their hashes and count in the task of the hot ones."""
        names = ["h1", "h2", "unit", "start", "end", "first", "second", "again", "times"]
        kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 6)
        out: list[list] = [[] for _ in names]
        held: dict[int, list[tuple]] = {k: [] for k in range(len(units))}
        hot: dict[int, list[tuple]] = {k: [] for k in range(len(units))}

        def put(h1, h2, k, a, z, *window):
            for c, v in zip(out, (h1, h2, k, a, z, *(window or (None,) * 4))):
                c.append(v)

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)
            for c in out:
                c.clear()
            return batch

        def read(raw: bytes, k: int) -> np.ndarray:
            return np.frombuffer(raw, np.uint8 if units[k].kind == "bytes" else np.uint64)

        def sort(k):
            rows, length = held[k], units[k].length
            if len(rows) > 1:
                for (_, h1, h2, _, lo, kind, _), at in zip(rows, repeated_starts([read(r[-1], k) for r in rows], length)):
                    for a, z in _runs(at) if not kind & 1 else ():
                        put(h1, h2, k, lo + a, lo + z + length)
            held[k] = []

        def windows(k):
            rows, length = hot[k], units[k].length
            if not rows:
                return
            per = []
            for i, (_, _, _, anchor, lo, _, raw) in enumerate(rows):
                s = read(raw, k)
                at = np.arange(len(s) - length + 1)
                per.append((Hashes(s).of(at, at + length).view(np.int64), Hashes(s, 1).of(at, at + length).view(np.int64), anchor - lo - at, np.full(len(at), i), at))
            one, two, again, row, at = (np.concatenate(x) for x in zip(*per))
            o = np.lexsort((again, two, one))
            new = np.concatenate([[True], (one[o][1:] != one[o][:-1]) | (two[o][1:] != two[o][:-1]) | (again[o][1:] != again[o][:-1])])
            start = np.flatnonzero(new)
            times = np.diff(np.append(start, len(o)))
            many = np.zeros(len(o), bool)
            many[o] = np.repeat(times, times) > 1
            for i, (_, h1, h2, _, lo, kind, _) in enumerate(rows):
                for a, z in _runs(at[(row == i) & many]) if not kind & 1 else ():
                    put(h1, h2, k, lo + a, lo + z + length)
            for j, t in zip(o[start].tolist(), times.tolist()):  # one stands for its class in this task
                _, h1, h2, _, lo, kind, _ = rows[row[j]]
                put(h1, h2, k, int(lo + at[j]), int(lo + at[j]) + length, int(one[j]), int(two[j]), int(again[j]), 2 if kind & 1 else t)
            hot[k] = []

        def bucket(rows):
            k = rows[0][5] >> 2
            if len(rows) > 1:
                held[k] += meeting(rows, units[k])
                if sum(len(r[-1]) for r in held[k]) >= SORTED * units[k].width:
                    sort(k)

        rows: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("deal", "h1", "h2", "anchor", "lo", "kind", "bytes"))):
                if row[5] & 2:
                    hot[row[5] >> 2].append(row)
                    if len(hot[row[5] >> 2]) >= 512:
                        windows(row[5] >> 2)
                else:
                    if rows and (rows[0][0], rows[0][5] >> 2) != (row[0], row[5] >> 2):
                        bucket(rows)
                        rows = []
                    rows.append(row)
                if len(out[0]) >= 10_000:
                    yield flush()
        if rows:
            bucket(rows)
        for k in range(len(units)):
            sort(k)
            windows(k)
        yield flush()

    sorted_ = cut(bucketed.mapInArrow(sort_buckets, "h1 long, h2 long, unit int, start long, end long, first long, second long, again long, times long"))
    del bucketed, once
    release(docs.sparkSession)
    exact = sorted_.where("times IS NULL").select("h1", "h2", "unit", "start", "end")
    key = ["first", "second", "again", "unit"]
    twice = sorted_.where("times IS NOT NULL").groupBy(*key).agg(F.sum("times").alias("n")).where("n > 1").select(*key)
    # what repeats within a task is out already
    common = sorted_.where("times = 1").join(twice, key, "left_semi").select("h1", "h2", "unit", "start", "end")
    return whole.unionByName(exact).unionByName(common)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of what the spans cover."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


def with_spans(df: DataFrame, units: tuple[Unit, ...], keep: list[str] | None = None) -> DataFrame:
    """(doc_id, text, spans) of every document: maximal runs of what repeats; null where nothing does.

    keep: instead of doc_id, a struct ``row`` of these columns, whose names then can't clash with any of these.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    docs = keyed(texts(df) if keep is None else df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text))
    hot, key = hot_texts(docs), ["h1", "h2"]

    def join_up(batches):
        for b in batches:
            if b.num_rows:
                whole = [[{"unit": k, "start": a, "end": z} for k in range(len(units)) for a, z in _of(s, k)] for s in b.column("spans").to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(whole, pa.list_(pa.struct([("unit", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])))], names=[*key, "spans"])

    found = repeated_spans(docs, hot, units).groupBy(*key).agg(F.collect_set(F.struct("unit", "start", "end")).alias("spans"))
    spans = cut(found.mapInArrow(join_up, "h1 long, h2 long, spans array<struct<unit: int, start: long, end: long>>"))
    del found
    release(df.sparkSession)
    near = docs.join(F.broadcast(hot.join(spans, key, "left")), key)
    far = docs.join(F.broadcast(hot), key, "left_anti").join(spans, key, "left")
    return near.unionByName(far).drop(*key)


def _of(spans: list | None, k: int) -> list[tuple[int, int]]:
    return merged([(s["start"], s["end"]) for s in spans or () if s["unit"] == k])


def remove_digests(df: DataFrame, unit: Unit = BYTES, passage: Unit = WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per document; then passage_words, the words in runs of passage.length
    words or more that start anywhere else too. Those are counted only, not removed."""

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, text, spans in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("spans").to_pylist()):
                raw = text.as_buffer().to_pybytes()
                gone = _of(spans, 0)
                kept, at = hashlib.sha256(), 0
                for a, z in gone:
                    kept.update(raw[at:a])
                    at = z
                kept.update(raw[at:])
                rows.append((doc_id, len(raw), sum(z - a for a, z in gone), len(gone), kept.hexdigest(), sum(z - a for a, z in _of(spans, 1))))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "passage_words"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return with_spans(df, (unit, passage)).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, passage_words long")


def remove_text(df: DataFrame, unit: Unit = BYTES) -> DataFrame:
    """The rows and columns of ``df``, text without its repeated strings and n_chars (if present) counted anew.

    Where a cut of bytes splits a character, the rest of that character goes too. Words go with the whitespace behind them.
    """
    out = df.schema

    def run(batches):
        for b in batches:
            kept = []
            for text, spans in zip(b.column("text"), b.column("spans").to_pylist()):
                raw, parts, at = text.as_buffer().to_pybytes(), [], 0
                gone = _of(spans, 0)
                if gone and unit.kind == "words":
                    start = np.append(word_edges(raw)[1], len(raw))
                    gone = [(int(start[a]), int(start[z])) for a, z in gone]
                for a, z in gone:
                    parts.append(raw[at:a])
                    at = z
                kept.append(b"".join([*parts, raw[at:]]).decode(errors="ignore"))
            row = b.column("row")
            cols = {f.name: row.field(f.name) for f in out.fields if f.name not in ("text", "n_chars")}
            cols |= {"text": pa.array(kept, pa.string()), "n_chars": pa.array(map(len, kept), pa.int64())}
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in out.fields], names=out.fieldNames())

    return with_spans(df, (unit,), keep=[c for c in df.columns if c != "text"]).mapInArrow(run, out)
