"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The words of a batch that aren't cached become one flat array of symbols. Each round looks up the best pair of every word (a
segmented minimum over score and place), merges the leftmost best pair of all words at once, drops the consumed symbols and
the finished words, and ends when no pair remains. One merge per word and round keeps the library's order exactly: a merge
can make a pair that beats the others of its word. No piece crosses from a non-space into a space mark, so words are
independent; the model is checked for that, and for anything else that this code doesn't implement.

Null texts are empty and have no ids. Every text is encoded whole. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, texts

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CACHE_WORDS, CACHE_IDS, SLICE_CHARS = 500_000, 4_000_000, 1_000_000
NONE = np.int64(1) << 62
TABLE_BITS = 18


class Codec:
    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        t, n = model.trainer_spec, model.normalizer_spec
        if (t.model_type, t.byte_fallback, t.treat_whitespace_as_suffix) != (t.BPE, True, False):
            raise ValueError("a BPE model with byte fallback is needed")
        if n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces or not n.escape_whitespaces:
            raise ValueError("an identity normaliser with a dummy prefix is needed")
        kinds = {p.type for p in model.pieces}
        if kinds - {1, 2, 3, 6}:
            raise ValueError("user-defined and unused pieces aren't supported")
        self.pieces = [p.piece for p in model.pieces]
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece crosses a word boundary")
        self.byte_id = np.zeros(256, np.int64)
        self.raw: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[3:5], 16)] = i
            self.raw.append(bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else p.piece.replace(MARK, " ").encode())
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.raw[self.unknown] = t.unk_surface.encode()
        self.is_byte = [p.type == 6 for p in model.pieces]
        self.size = len(self.pieces)
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        scores = sorted({p.score for p in model.pieces if p.type == 1}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        pairs = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = normal.get(p[:k]), normal.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = (i, rank[model.pieces[i].score])
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.rank = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.decimals = Strings([b"%d," % i for i in range(self.size)])
        self.surfaces = Strings(self.raw)
        self.forget()
        self.hash()

    def hash(self) -> None:
        """Pair keys in a hash table of a few rows: a key that finds its place taken goes to the next row."""
        self.rows, left = [], np.arange(len(self.keys))
        while len(left):
            slot = np.full(1 << TABLE_BITS, -1, np.int32)
            place = self.place(self.keys[left], len(self.rows))
            slot[place] = left
            self.rows.append(slot)
            left = left[slot[place] != left]

    @staticmethod
    def place(key: np.ndarray, row: int) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * row)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged piece and rank of each pair; rank -1 where there is none."""
        key = np.where((left < self.size) & (right < self.size), left * self.size + right, 0)
        found = np.full(len(key), -1, np.int64)
        for row, slot in enumerate(self.rows):
            at = slot[self.place(key, row)]
            hit = (at >= 0) & (self.keys[at] == key)
            found[hit] = at[hit]
        return np.where(found >= 0, self.made[found], 0), np.where(found >= 0, self.rank[found], -1)

    def merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over flat symbols; word: non-decreasing word numbers. Returns symbols and words, in word order."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        made, rank = np.zeros(len(sym), np.int64), np.full(len(sym), -1, np.int64)
        if len(sym) > 1:
            made[:-1], rank[:-1] = self.look_up(sym[:-1], sym[1:])
            rank[:-1][word[:-1] != word[1:]] = -1
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            key = np.where(rank >= 0, (rank << 32) | np.arange(len(sym)), NONE)
            best = np.minimum.reduceat(key, first)
            live = best < NONE
            if not live.all():
                mask = np.repeat(live, np.diff(np.append(first, len(sym))))
                done.append((word[~mask], sym[~mask]))
            else:
                mask = np.ones(len(sym), bool)
            at = best[live] & 0xFFFFFFFF
            sym[at] = made[at]
            mask[at + 1] = False
            place = np.cumsum(mask) - 1
            sym, word, made, rank = sym[mask], word[mask], made[mask], rank[mask]
            at = place[at]
            fresh = np.concatenate([at, at - 1])
            fresh = fresh[fresh >= 0]
            rank[fresh] = -1
            fresh = fresh[fresh + 1 < len(sym)]
            fresh = fresh[word[fresh] == word[fresh + 1]]
            if len(fresh):
                made[fresh], rank[fresh] = self.look_up(sym[fresh], sym[fresh + 1])
        if not done:
            return sym, word
        w, s = np.concatenate([x[0] for x in done]), np.concatenate([x[1] for x in done])
        order = np.argsort(w, kind="stable")
        return s[order], w[order]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of non-empty words, and the number of ids of each."""
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.char_id[flat].astype(np.int64)
        sym = np.where(sym < 0, flat.astype(np.int64) + self.size, sym)
        sym, word = self.merge(sym, np.repeat(np.arange(len(words)), lengths))
        unknown = np.flatnonzero(sym >= self.size)
        if len(unknown):  # characters without a piece become the pieces of their bytes
            raw = [chr(c).encode() for c in (sym[unknown] - self.size).tolist()]
            times = np.ones(len(sym), np.int64)
            times[unknown] = [len(r) for r in raw]
            at = np.repeat(sym >= self.size, times)
            sym, word = np.repeat(sym, times), np.repeat(word, times)
            sym[at] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return sym.astype(np.int32), np.bincount(word, minlength=len(words))

    def words(self, text: str) -> list[str]:
        return WORD.findall(MARK + text.replace(" ", MARK)) if text else []

    def flat(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and the number of ids of each; words met before come from a bounded cache."""
        split = [self.words(t) for t in batch]
        if len(self.index) > CACHE_WORDS or self.start[-1] > CACHE_IDS:
            self.forget()
        index = self.index
        new = [w for w in set().union(*split) if w not in index]
        if new:
            ids, counts = self.encode_words(new)
            index.update(zip(new, range(len(index), len(index) + len(new))))
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])
            if self.start[-1] > len(self.store):
                self.store = np.concatenate([self.store, np.zeros(max(len(self.store), len(ids)), np.int32)])
            self.store[self.start[-1] - len(ids) : self.start[-1]] = ids
        per_text = np.fromiter(map(len, split), np.int64, len(split))
        word = np.fromiter(map(index.__getitem__, chain.from_iterable(split)), np.int64, int(per_text.sum()))
        sizes = self.start[word + 1] - self.start[word]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(per_text)]
        return self.store[_spans(self.start[word], sizes)], np.diff(ends, prepend=0)

    def forget(self) -> None:
        self.index, self.start, self.store = {}, np.zeros(1, np.int64), np.zeros(1 << 20, np.int32)

    def encode(self, batch: list[str]) -> list[list[int]]:
        ids, counts = self.flat(batch)
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if batch else []

    def decode(self, ids: list[int]) -> str:
        """As the library: one leading space goes, each byte that isn't part of valid UTF-8 becomes U+FFFD."""
        out, run, first = [], b"", True
        for i in ids:
            if self.is_byte[i]:
                run += self.raw[i]
                first = False
                continue
            if run:
                out.append(_bytes_text(run))
                run = b""
            piece = self.raw[i].decode()
            if first and piece and i != self.unknown:
                piece = piece.removeprefix(" ")
                first = False
            out.append(piece)
        return "".join(out) + (_bytes_text(run) if run else "")

    def digests(self, batch: list[str]) -> dict[str, list]:
        """Token count, digest of the ids and of the text decoded from the ids, in slices of about SLICE_CHARS characters."""
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        part: list[str] = []
        size = 0
        for k, text in enumerate(batch):
            part.append(text)
            size += len(text)
            if size >= SLICE_CHARS or k == len(batch) - 1:
                ids, counts = self.flat(part)
                ends = np.cumsum(counts)
                decimal, at = self.decimals.join(ids, ends)
                raw, to = self.surfaces.join(ids, ends)
                for n, a, b, c, d in zip(counts.tolist(), [0, *at], at, [0, *to], to):
                    out["n_tokens"].append(n)
                    out["ids_sha256"].append(hashlib.sha256(decimal[a : max(a, b - 1)]).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(self.text_of(raw[c:d])).hexdigest())
                part, size = [], 0
        return out

    @staticmethod
    def text_of(raw: bytes) -> bytes:
        """The decoded text in UTF-8 from the ids' bytes: an encoded text begins with the dummy space."""
        raw = raw.removeprefix(b" ")
        try:
            raw.decode()
        except UnicodeDecodeError:
            return _bytes_text(raw).encode()
        return raw


class Strings:
    """A constant list of byte strings, joined by index in numpy."""

    def __init__(self, items: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(items), np.uint8)
        self.size = np.fromiter(map(len, items), np.int64, len(items))
        self.start = np.cumsum(self.size) - self.size

    def join(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, list[int]]:
        """The strings of ids, and the byte where each run that ends at ``ends`` ends."""
        sizes = self.size[ids]
        at = np.concatenate([[0], np.cumsum(sizes)])[ends]
        return self.data[_spans(self.start[ids], sizes)].tobytes(), at.tolist()


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1 ... start + size - 1 for each span, flat."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _bytes_text(run: bytes) -> str:
    out, k = [], 0
    while k < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[k : k + n].decode())
                k += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            k += 1
    return "".join(out)


def encode_digests(df: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per document."""
    return map_texts(texts(df), lambda: Codec(model_path).digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(df: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string per document."""
    import pyarrow as pa

    def run(batches):
        codec = Codec(model_path)
        for b in batches:
            ids = codec.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in ids], pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    return texts(df).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
