"""A store of tables with one commit log: a run's rows of all tables become visible together, or not at all.

Rows are staged as Parquet folders that no reader knows of. A commit is one small file, log/<version>.json, which lists
the folders that make up every table; it is written under another name and renamed, and the rename fails if the version
is there already. So a reader opens a version and keeps it, whatever is written meanwhile; a writer that died
leaves folders that nothing names (vacuum removes them); and of two writers the second finds its version taken,
checks its rows against what the first has added, and tries the next.

Rows go in once by key: parents whose key the store has are left out, and so are their children, so a document comes
with all its nodes or not at all, and a replay adds nothing and makes no version. Keys are digests: rows of equal key
are taken to be equal, and one of them is kept. Keys that the store has are read as one column; Spark's runtime Bloom
filter keeps most of them out of the join's shuffle.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class VersionTaken(Exception):
    """Another writer has made this version."""


@dataclass
class Part:
    """Rows for one table; those of children carry the key of their parent."""

    rows: DataFrame
    key: list[str]
    children: dict[str, Part] = field(default_factory=dict)


class Snapshot:
    """One version of a store; it reads the same rows for ever."""

    def __init__(self, spark: SparkSession, version: int, manifest: dict):
        self.spark, self.version, self.manifest = spark, version, manifest

    def tables(self) -> list[str]:
        return sorted(self.manifest["tables"])

    def read(self, table: str) -> DataFrame:
        found = self.manifest["tables"][table]
        schema = StructType.fromJson(found["schema"])
        return self.spark.read.schema(schema).parquet(*found["folders"]) if found["folders"] else self.spark.createDataFrame([], schema)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("log") if n.endswith(".json") and n[:-5].isdigit()]

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version (the last by default; 0, of no tables, is always there)."""
        version = max(self.versions(), default=0) if version is None else version
        if version == 0:
            return Snapshot(self.spark, 0, {"tables": {}})
        stream = self._fs.open(self._path(f"{self.path}/log/{version:012d}.json"))
        try:
            return Snapshot(self.spark, version, json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> None:
        """Makes the version, or raises VersionTaken."""
        temporary = self._path(f"{self.path}/log/{uuid.uuid4().hex}.tmp")
        out = self._fs.create(temporary, False)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(self._jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri() if "://" in self.path else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(temporary, self._path(f"{self.path}/log/{version:012d}.json"), options)
        except Py4JJavaError as e:
            self._fs.delete(temporary, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise VersionTaken(version) from None
            raise

    def _stage(self, table: str, rows: DataFrame) -> DataFrame:
        path = f"{self.path}/data/{table}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        staged = self.spark.read.schema(rows.schema).parquet(path)
        staged.folder = path
        return staged

    def _new(self, table: str, part: Part, base: Snapshot, parents: DataFrame | None) -> DataFrame:
        rows = part.rows
        if parents is not None:  # children of parents that came in this run, whatever key they have themselves
            shared = [c for c in parents.columns if c in rows.columns]
            return rows.join(parents, shared, "left_semi").dropDuplicates(part.key)
        rows = rows.dropDuplicates(part.key)
        if table in base.manifest["tables"]:
            rows = rows.join(base.read(table).select(*part.key), part.key, "left_anti")
        return rows

    def _staged(self, parts: dict[str, Part], base: Snapshot, parents: DataFrame | None = None) -> dict[str, DataFrame]:
        out: dict[str, DataFrame] = {}
        for table, part in parts.items():
            out[table] = self._stage(table, self._new(table, part, base, parents))
            out |= self._staged(part.children, base, out[table].select(*part.key))
        return out

    def commit(self, parts: dict[str, Part], attempts: int = 10) -> int | None:
        """Adds what is new of all parts as one version; None if nothing is. Tables that aren't named stay as they are."""
        base, staged = self.snapshot(), None
        for _ in range(attempts):
            if staged is None:
                staged = self._staged(parts, base)
            else:  # another writer was faster: what was staged meets what it added
                again = self._restaged(parts, staged, base)
                staged = self._staged(again, base)
            added = {t: d for t, d in staged.items() if not d.isEmpty()}
            if not added:
                return None
            try:
                self._publish(base.version + 1, self._manifest(base, staged))
                return base.version + 1
            except VersionTaken:
                base = self.snapshot()
        raise VersionTaken(base.version + 1)

    def _restaged(self, parts: dict[str, Part], staged: dict[str, DataFrame], base: Snapshot) -> dict[str, Part]:
        return {t: Part(staged[t], p.key, self._restaged(p.children, staged, base)) for t, p in parts.items()}

    def _manifest(self, base: Snapshot, staged: dict[str, DataFrame], replaced: bool = False) -> dict:
        tables = {} if replaced else dict(base.manifest["tables"])
        for table, rows in staged.items():
            before = tables.get(table, {"folders": [], "schema": json.loads(rows.schema.json())})
            if before["schema"] != json.loads(rows.schema.json()):
                raise ValueError(f"the columns of {table} have changed")
            tables[table] = {"folders": [*before["folders"], *([] if rows.isEmpty() else [rows.folder])], "schema": before["schema"]}
        return {"parent": base.version, "tables": tables}

    def compact(self) -> int:
        """The last version's rows as one folder a table, as a version of its own."""
        base = self.snapshot()
        staged = {t: self._stage(t, base.read(t)) for t in base.tables()}
        self._publish(base.version + 1, self._manifest(base, staged, replaced=True))
        return base.version + 1

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes folders that none of the last keep versions names, and their log entries; not while a writer is at work."""
        versions = self.versions()
        kept = versions[-keep:] if keep else []
        named = {f for v in kept for t in self.snapshot(v).manifest["tables"].values() for f in t["folders"]}
        gone = [f"{self.path}/data/{t}/{n}" for t in self._names("data") for n in self._names(f"data/{t}")]
        gone = [f for f in gone if f not in named]
        logs = [f"{self.path}/log/{n}" for n in self._names("log") if n not in {f"{v:012d}.json" for v in kept}]
        for name in [*gone, *logs]:
            self._fs.delete(self._path(name), True)
        return gone


def local_orders(references: DataFrame, nodes: DataFrame, reference: str) -> DataFrame:
    """references (document_id, <reference>: a node's id or null, ...) with <reference>_order, the node's place in its document.

    An id that the document doesn't have fails the query.
    """
    named = references.where(F.col(reference).isNotNull())
    found = named.join(nodes.select("document_id", F.col("node_id").alias(reference), F.col("ord").alias("found")), ["document_id", reference], "left")
    order = F.when(F.col("found").isNull(), F.raise_error(F.lit("reference to a node that isn't there"))).otherwise(F.col("found"))
    missing = references.where(F.col(reference).isNull()).withColumn(f"{reference}_order", F.lit(None).cast(nodes.schema["ord"].dataType))
    return missing.unionByName(found.withColumn(f"{reference}_order", order.cast(nodes.schema["ord"].dataType)).drop("found"))
