"""Snapshots of an index as Parquet folders, one a version, and numbered manifests of which the highest is the current one.

A version is written whole before its manifest is, and a manifest's number can be claimed once only. So a reader sees the last
committed version at any time, a failed sync leaves nothing behind that is ever read, and of two syncs at once one fails.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import asdict, fields, replace
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental, resolve
from ..schemas import INHERITANCE_ROLES, Index
from .build import FrontEnd, Layout, Provider, numbered, parse, prepared, resolved, tables
from .lineage import cut

FORMAT = 2
FACTS = ("symbols", "refs", "imports", "scopes", "scope_defs")
KEPT_VERSIONS = 2
_locks: dict[str, threading.Lock] = {}


class Store:
    """A folder of snapshots of one source tree."""

    def __init__(self, spark: SparkSession, folder: str, root: str = "") -> None:
        self.spark, self.folder, self.root = spark, folder.rstrip("/"), root
        self.lock = _locks.setdefault(self.folder, threading.Lock())

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _manifests(self) -> list[int]:
        """Numbers of the manifests, the highest first."""
        fs, path = self._path("manifest")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)

    def _read(self, number: int) -> dict | None:
        fs, path = self._path(f"manifest/{number:012d}.json")
        try:
            stream = fs.open(path)
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            m = json.loads(text)
        except (ValueError, Py4JJavaError):  # not written to its end, or gone
            return None
        return m if m.get("format") == FORMAT else None

    def manifest(self) -> dict | None:
        """The current manifest, or None where there is none of this format and root."""
        for number in self._manifests():
            if m := self._read(number):
                return m if m.get("root") == self.root else None
        return None

    def _commit(self, index: Index, scip: DataFrame | None, sources: DataFrame | None, **more) -> dict:
        numbers, version = self._manifests(), uuid.uuid4().hex
        every = {f.name: getattr(index, f.name) for f in fields(Index)} | {"scip": scip, "sources": sources}
        kept = {name: df for name, df in every.items() if df is not None}
        for name, df in kept.items():
            df.write.parquet(f"{self.folder}/{version}/{name}")
        m = {"format": FORMAT, "root": self.root, "version": version, "tables": sorted(kept), "synced_at": datetime.now(UTC).isoformat(), **more}
        fs, path = self._path(f"manifest/{(numbers[0] if numbers else 0) + 1:012d}.json")
        stream = fs.create(path, False)  # fails where another sync has this number
        stream.write(bytearray(json.dumps(m).encode()))
        stream.close()
        for number in numbers[KEPT_VERSIONS - 1 :]:  # versions that no reader should still have open
            old = self._read(number)
            if old:
                fs.delete(self._path(old["version"])[1], True)
            fs.delete(self._path(f"manifest/{number:012d}.json")[1], False)
        return m

    def commit(self, index: Index, **more) -> dict:
        """Put a whole index in place."""
        with self.lock:
            return self._commit(index, None, None, **more)

    def table(self, name: str, m: dict | None = None) -> DataFrame | None:
        m = m or self.manifest()
        return self.spark.read.parquet(f"{self.folder}/{m['version']}/{name}") if m and name in m["tables"] else None

    def raw(self, m: dict | None = None) -> Index | None:
        """The current index without ingested edges."""
        m = m or self.manifest()
        return Index(**{f.name: self.table(f.name, m) for f in fields(Index)}) if m else None

    def load(self) -> Index | None:
        """The current index. Ingested edges stand for those that they cover."""
        m = self.manifest()
        index = self.raw(m)
        scip = self.table("scip", m)
        if index is None or scip is None:
            return index
        return replace(index, occurrences=resolve.drop_shadowed(index.occurrences.unionByName(scip)))

    def ready(self) -> bool:
        return self.manifest() is not None

    def verify(self, files: DataFrame) -> dict[str, int]:
        """Counts of changed, new and gone files against the tree's (path, content), which are only hashed."""
        index = self.raw()
        old = index.files if index else self.spark.createDataFrame([], "path string, hash string")
        counts = {r["state"]: r["count"] for r in incremental.diff(old, prepared(files)).groupBy("state").count().collect()}
        return {k: counts.get(k, 0) for k in ("changed", "new", "gone")}

    def ingest(self, read: Callable[[Index], DataFrame]) -> dict:
        """Replace all ingested edges by those that ``read`` makes of the index."""
        with self.lock:
            m = self.manifest()
            if m is None:
                raise ValueError("sync first")
            index = self.raw(m)
            return self._commit(index, cut(read(index)), self.table("sources", m), **{k: m.get(k) for k in ("layout", "truncated")})

    def sync(self, files: DataFrame, layout: Layout = Layout(), ends: dict[str, FrontEnd] | None = None, providers: tuple[Provider, ...] = (), truncated: bool = False, keep_sources: bool = False) -> dict:
        """Bring the store to ``files`` (path, content). Only new and changed files are parsed. References are resolved again in the
        files that the change can touch, or in all of them where the layout, a provider, inheritance or re-exports call for it.

        Gives counts of new, changed, gone, same and unparsed files, and which way the references went.
        """
        with self.lock:
            m = self.manifest()
            old = self.raw(m)
            now = cut(prepared(files))
            sources = files.select("path", "content") if keep_sources else None
            before = old.files if old is not None else self.spark.createDataFrame([], "id long, path string, hash string")
            states = cut(incremental.diff(before, now))
            counts = {r["state"]: r["count"] for r in states.groupBy("state").count().collect()}
            out = {k: counts.get(k, 0) for k in ("new", "changed", "gone", "same")} | {"unparsed": 0, "resolved": "none"}
            shape = json.dumps(asdict(layout), sort_keys=True)
            more = {"layout": shape, "truncated": truncated}
            if old is not None and not set(counts) - {"same"} and m.get("layout") == shape and not providers:
                if sources is not None or m.get("truncated") != truncated:
                    self._commit(old, self.table("scip", m), sources, **more)
                return out
            index, moved, lost = self._merged(old, now, states, ends)
            out["unparsed"] = lost
            if old is not None and m.get("layout") == shape and not providers and moved.isEmpty():  # nothing but texts that don't parse
                return out
            scope = None
            if old is not None and m.get("layout") == shape and not providers:
                scope = incremental.scope(old, index, moved)
            out["resolved"] = "all" if scope is None else "scoped"
            fresh = resolved(index, layout, providers, scope)
            scip = self.table("scip", m) if m else None
            if scope is not None:
                # other files' edges stay; inheritance is resolved in whole each time
                kept = old.occurrences.where(~F.col("role").isin(*INHERITANCE_ROLES)).join(scope, "file_id", "left_anti")
                fresh = replace(fresh, occurrences=fresh.occurrences.unionByName(kept.join(moved, "file_id", "left_anti")))
            if scip is not None:
                there = index.symbols.select(F.col("id").alias("symbol_id"))
                scip = cut(scip.join(moved, "file_id", "left_anti").join(there, "symbol_id", "left_semi"))
            self._commit(fresh, scip, sources, **more)
            return out

    def _merged(self, old: Index | None, now: DataFrame, states: DataFrame, ends: dict[str, FrontEnd] | None) -> tuple[Index, DataFrame, int]:
        """The facts after the change, without edges; (file_id) of files that were changed, gone or new; how many can't be parsed."""
        todo = now.join(states.where("state IN ('new', 'changed')").select("path"), "path", "left_semi")
        parsed = cut(parse(todo, ends))
        lost = parsed.where("facts IS NULL").count()
        parsed = parsed.where("facts IS NOT NULL")
        if old is None:
            index = tables(cut(numbered(parsed)))
            return index, index.files.select(F.col("id").alias("file_id")), lost
        known = old.files.select("path", F.col("id"))
        top = old.files.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
        again = parsed.join(known, "path")
        added = numbered(cut(parsed.join(known, "path", "left_anti")), top + 1)
        part = tables(cut(again.unionByName(added)))
        gone = cut(known.join(states.where("state IN ('gone', 'changed')").select("path"), "path", "left_semi").select(F.col("id").alias("file_id")))
        moved = cut(gone.union(part.files.select("id")).distinct())
        rest = {n: cut(getattr(old, n).join(gone, "file_id", "left_anti").unionByName(getattr(part, n), allowMissingColumns=True)) for n in FACTS}
        files = old.files.join(gone.withColumnRenamed("file_id", "id"), "id", "left_anti").unionByName(part.files, allowMissingColumns=True)
        return Index(cut(files), rest["symbols"], None, rest["refs"], rest["imports"], rest["scopes"], rest["scope_defs"]), moved, lost
