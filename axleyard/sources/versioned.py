"""Tables kept by partition under one folder, changed by whole partitions, one commit a version over all of them.

``<path>/<table>/v=<version>/part=<partition>/`` holds Parquet files; ``<path>/_manifests/<version>.json`` lists, for every
table and partition, the version it stands at, its files with their sizes, its rows and the range of its key. A version
exists once its manifest has its name, by one rename; until then nothing reads what it wrote, and writing it again
replaces that. The last two versions stay readable, what only older ones name is deleted.
"""

from __future__ import annotations

import json
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Appended partitions from which on they are written as one.
COMPACT_PARTS = 64


class VersionedTables:
    """``schemas``: table name -> its columns; ``keys``: table name -> the column whose range manifests keep."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str], keys: dict[str, str]):
        self.spark, self.path, self.schemas, self.keys = spark, path.rstrip("/"), schemas, keys

    def _at(self, *parts: str) -> tuple[JavaObject, JavaObject]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        p, fs = self._at(*parts)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self._names("_manifests") if n[0] not in "._")

    def manifest(self, before: int | None = None) -> dict:
        """The last one, or the last below version ``before``."""
        found = [v for v in self.versions() if before is None or v < before]
        if not found:
            return {"version": -1, "tables": {}}
        p, fs = self._at("_manifests", f"{found[-1]:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, manifest: dict, parts: set[str] | None = None, but: set[str] = frozenset()) -> DataFrame:
        """The table as ``manifest`` has it; only ``parts``, or all ``but`` some. Nothing else is listed or opened."""
        held = manifest["tables"].get(name, {})
        files = [f"{self.path}/{f}" for part, m in sorted(held.items()) if (parts is None or part in parts) and part not in but for f in m["files"]]
        return self.spark.read.schema(self.schemas[name]).parquet(*files) if files else self.spark.createDataFrame([], self.schemas[name])

    def bytes_of(self, name: str, manifest: dict, parts: set[str]) -> int:
        return sum(sum(m["files"].values()) for part, m in manifest["tables"].get(name, {}).items() if part in parts)

    def _write(self, name: str, version: int, rows: DataFrame, part) -> dict:
        """Writes ``rows`` as partitions of a version; what the manifest says of them."""
        columns = [F.col(c).cast(kind).alias(c) for c, kind in (x.split() for x in self.schemas[name].split(", "))]
        folder = f"{self.path}/{name}/v={version}"
        # rebalance: partitions of many rows spread over files of the advised size
        rows.select(*columns, part.alias("part")).hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(folder)
        found = {}
        for d in self._names(name, f"v={version}"):
            if d.startswith("part="):
                p, fs = self._at(name, f"v={version}", d)
                found[d[5:]] = {"v": version, "files": {f"{name}/v={version}/{d}/{x.getPath().getName()}": x.getLen() for x in fs.listStatus(p) if x.getPath().getName()[0] not in "._"}}
        if found:
            key = F.col(self.keys[name])
            for r in self.spark.read.schema(f"{self.schemas[name]}, part string").parquet(folder).groupBy("part").agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect():  # a row for each partition
                found[r.part] |= {"rows": r.n, "min": str(r.lo), "max": str(r.hi)}
        return found

    def commit(self, version: int, replaced: dict[str, tuple[DataFrame, object]], appended: dict[str, DataFrame], note: dict | None = None) -> None:
        """Makes ``version`` from the one before: of ``replaced`` tables (rows, partition column) the partitions that rows have are
        replaced; ``appended`` rows are a partition of their own. Does nothing if the version exists."""
        if version in self.versions():
            return
        old = self.manifest(version)
        tables = {n: dict(parts) for n, parts in old["tables"].items()}
        for name, (rows, part) in replaced.items():
            tables.setdefault(name, {}).update(self._write(name, version, rows, part))
        for name, rows in appended.items():
            held = tables.setdefault(name, {})
            if len(held) >= COMPACT_PARTS:
                rows, tables[name] = rows.unionByName(self.read(name, old)), {}
            tables[name].update(self._write(name, version, rows, F.lit(f"b{version}")))
        made = {"version": version, "parent": old["version"], "tables": tables} | (note or {})
        tmp, fs = self._at("_manifests", f".{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        if not fs.rename(tmp, self._at("_manifests", f"{version:012d}.json")[0]):
            raise RuntimeError(f"version {version} of {self.path} was made by another writer")
        self._clean()

    def _clean(self, keep: int = 2) -> None:
        """Deletes what only versions before the last ``keep`` name."""
        versions = self.versions()
        named = {(n, m["v"], part) for v in versions[-keep:] for n, parts in self.manifest(v + 1)["tables"].items() for part, m in parts.items()}
        for name in self.schemas:
            for v in (int(d[2:]) for d in self._names(name) if d.startswith("v=")):
                if v > versions[-1]:
                    continue
                parts = [d for d in self._names(name, f"v={v}") if d.startswith("part=")]
                gone = [d for d in parts if (name, v, d[5:]) not in named]
                for d in gone:
                    p, fs = self._at(name, f"v={v}", d)
                    fs.delete(p, True)
                if len(gone) == len(parts):
                    p, fs = self._at(name, f"v={v}")
                    fs.delete(p, True)
        for v in versions[:-keep]:
            p, fs = self._at("_manifests", f"{v:012d}.json")
            fs.delete(p, False)
