"""SCIP index import and export. Lines count from 0 and columns by the document's encoding there; from 1 and in UTF-16 here."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ident
from ..operators import facts, lookup
from ..schemas import Index
from . import wire

#: Field numbers, the definition role bit, position encodings.
INDEX_METADATA, INDEX_DOCUMENTS = 1, 2
DOC_PATH, DOC_OCCURRENCES, DOC_SYMBOLS, DOC_LANGUAGE, DOC_TEXT, DOC_ENCODING = 1, 2, 3, 4, 5, 6
OCC_RANGE, OCC_SYMBOL, OCC_ROLES, OCC_LINE, OCC_LINES = 1, 2, 3, 8, 9
SYMBOL_NAME, SYMBOL_DISPLAY = 1, 6
DEFINITION, UTF8, UTF16, UTF32 = 1, 1, 2, 3
SCORE = 0.95
SCHEME = "codegraph"
SLICE = 64  # documents turned into Python objects, or put into one index message, at a time
_ROWS = "path string, symbol string, definition boolean, s_line int, s_col int, e_line int, e_col int, nth long"


def utf16_column(line: str, column: int, encoding: int) -> int | None:
    """A column of a line in UTF-16 units; None in the midst of a character or behind the end. An unspecified encoding has to make no
    difference."""
    if encoding == 0:
        every = {utf16_column(line, column, e) for e in (UTF8, UTF16, UTF32)}
        return every.pop() if len(every) == 1 else None
    width = {UTF8: lambda c: len(c.encode()), UTF16: lambda c: 1 + (ord(c) > 0xFFFF), UTF32: lambda c: 1}[encoding]
    at = units = 0
    for c in line:
        if at >= column:
            break
        at += width(c)
        units += 1 + (ord(c) > 0xFFFF)
    return units if at == column else None


def raw_range(occurrence: dict[int, list]) -> tuple[int, int, int, int] | None:
    """Typed single-line, else typed multi-line, else three or four packed numbers."""
    if OCC_LINE in occurrence:
        f = dict(wire.fields(occurrence[OCC_LINE][-1]))
        return f.get(1, 0), f.get(2, 0), f.get(1, 0), f.get(3, 0)
    if OCC_LINES in occurrence:
        f = dict(wire.fields(occurrence[OCC_LINES][-1]))
        return f.get(1, 0), f.get(2, 0), f.get(3, 0), f.get(4, 0)
    n = [x for v in occurrence.get(OCC_RANGE, []) for x in wire.unpacked(v)]
    return (n[0], n[1], n[0], n[2]) if len(n) == 3 else tuple(n) if len(n) == 4 else None


def placed(r: tuple[int, int, int, int] | None, encoding: int, lines: list[str]) -> tuple[int, int, int, int] | None:
    """The range in lines from 1 and UTF-16 columns, or None where it is out of the text, reversed or empty in a line."""
    if r is None or not 0 <= r[0] <= r[2] < len(lines):
        return None
    a, b = utf16_column(lines[r[0]], r[1], encoding), utf16_column(lines[r[2]], r[3], encoding)
    return None if a is None or b is None or (r[0] == r[2] and a >= b) else (r[0] + 1, a, r[2] + 1, b)


def slices(batches):
    """Arrow batches in parts of at most SLICE rows."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def _grouped(raw: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for n, v in wire.fields(raw):
        out.setdefault(n, []).append(v)
    return out


def decode(indexes: DataFrame, sources: DataFrame) -> DataFrame:
    """Occurrences of index files (content binary): one row each with a valid range. sources: (path, content) for documents without
    a text of their own. Documents are dealt out before they are decoded. A source table's size says little about its texts, so it
    is never broadcast."""

    def split(batches):
        for b in slices(batches):
            for raw in b.column("content").to_pylist():
                docs = [v for n, v in wire.fields(raw) if n == INDEX_DOCUMENTS]
                paths = [next((v.decode() for n, v in wire.fields(d) if n == DOC_PATH), "") for d in docs]
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(docs, pa.binary()), pa.array(range(len(docs)), pa.int64())], names=["path", "document", "nth"])

    def read(batches):
        for b in slices(batches):
            rows = []
            for path, raw, nth, content in zip(*(b.column(c).to_pylist() for c in ("path", "document", "nth", "content"))):
                doc = _grouped(raw)
                text = doc[DOC_TEXT][-1].decode() if DOC_TEXT in doc else content
                if text is None:
                    continue
                lines, encoding = text.split("\n"), doc.get(DOC_ENCODING, [0])[-1]
                for k, o in enumerate(map(_grouped, doc.get(DOC_OCCURRENCES, []))):
                    symbol = o.get(OCC_SYMBOL, [b""])[-1].decode()
                    where = placed(raw_range(o), encoding, lines)
                    if where and symbol and not symbol.startswith("local "):
                        rows.append((path, symbol, bool(o.get(OCC_ROLES, [0])[-1] & DEFINITION), *where, nth << 32 | k))
            if rows:
                kinds = (pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "symbol", "definition", *facts.RANGE, "nth"])

    docs = indexes.select("content").mapInArrow(split, "path string, document binary, nth long")
    return docs.hint("merge").join(sources.select("path", "content"), "path", "left").mapInArrow(read, _ROWS)


def ingest(decoded: DataFrame, index: Index) -> DataFrame:
    """Edges of provenance scip: a symbol's last definition whose name token is one of the index gives the target."""
    files = index.files.select("path", F.col("id").alias("file_id"))
    d = decoded.join(files, "path")
    places = d.where("definition").select("symbol", "file_id", F.col("s_line").alias("line"), F.col("s_col").alias("col"), "nth")
    target = lookup.symbol_at_name(index, places).groupBy("symbol").agg(F.max_by("symbol_id", "nth").alias("symbol_id"))
    uses = d.where("NOT definition").join(target, "symbol").select("file_id", *facts.RANGE, "symbol_id").distinct()
    uses = uses.withColumn("id", F.xxhash64("file_id", *facts.RANGE, "symbol_id"))
    return facts.enclosing(uses, index.symbols).select("id", "symbol_id", "file_id", *facts.RANGE, F.lit("reference").alias("role"), "enclosing_id", F.lit("scip").alias("provenance"), F.lit(SCORE).alias("confidence"))


def documents(index: Index, repo: str) -> DataFrame:
    """(path, document): a protobuf Document per file, with a definition per symbol and a use per edge."""
    files = index.files.select(F.col("id").alias("file_id"), "path", "lang")
    s = index.symbols.join(files, "file_id").withColumn("symbol", ident.scip_symbol(SCHEME, F.lit(repo), F.col("path"), F.col("owner_type"), F.col("name"), F.col("kind")))
    defs = s.select("path", "lang", "symbol", F.col("name").alias("display"), F.lit(DEFINITION).alias("roles"), *[F.col(n).alias(r) for n, r in zip(facts.NAME_RANGE, facts.RANGE)])
    uses = index.occurrences.join(s.select(F.col("id").alias("symbol_id"), "symbol"), "symbol_id").join(files, "file_id").select("path", "lang", "symbol", F.lit(None).cast("string").alias("display"), F.lit(0).alias("roles"), *facts.RANGE).distinct()
    item = F.struct(*facts.RANGE, "roles", "symbol", "display")
    rows = files.select("path", "lang").join(defs.unionByName(uses).groupBy("path").agg(F.array_sort(F.collect_list(item)).alias("items")), "path", "left")

    def run(batches):
        for b in slices(batches):
            out = []
            for path, lang, items in zip(*(b.column(c).to_pylist() for c in ("path", "lang", "items"))):
                doc = [wire.block(DOC_PATH, path)]
                for o in items or []:
                    a, c, e, f = o["s_line"] - 1, o["s_col"], o["e_line"] - 1, o["e_col"]
                    typed = wire.block(OCC_LINE, wire.number(1, a) + wire.number(2, c) + wire.number(3, f)) if a == e else wire.block(OCC_LINES, wire.number(1, a) + wire.number(2, c) + wire.number(3, e) + wire.number(4, f))
                    doc.append(wire.block(DOC_OCCURRENCES, wire.packed(OCC_RANGE, [a, c, f] if a == e else [a, c, e, f]) + wire.block(OCC_SYMBOL, o["symbol"]) + wire.number(OCC_ROLES, o["roles"]) + typed))
                doc += [wire.block(DOC_SYMBOLS, wire.block(SYMBOL_NAME, o["symbol"]) + wire.block(SYMBOL_DISPLAY, o["display"])) for o in items or [] if o["roles"]]
                out.append(b"".join(doc) + wire.block(DOC_LANGUAGE, lang or "") + wire.number(DOC_ENCODING, UTF16))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.binary())], names=["path", "document"])

    return rows.mapInArrow(run, "path string, document binary")


def index_messages(docs: DataFrame) -> DataFrame:
    """(content): the documents as index messages of up to SLICE documents each, for readers that take several files."""

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(wire.block(INDEX_DOCUMENTS, d) for d in b.column("document").to_pylist())], pa.binary())], names=["content"])

    return docs.select("document").mapInArrow(run, "content binary")


def index_bytes(docs: DataFrame, root: str = "") -> bytes:
    """One index message; a file format of one message, so the documents pass through the driver one by one, in path order."""
    out = [wire.block(INDEX_METADATA, wire.block(2, wire.block(1, "loomgraph")) + wire.block(3, root) + wire.number(4, 1))]
    out += [wire.block(INDEX_DOCUMENTS, bytes(r["document"])) for r in docs.orderBy("path").toLocalIterator()]
    return b"".join(out)


def read_indexes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")
