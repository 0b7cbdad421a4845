"""The catalog on disk: every table version a directory, every version of the whole a marker.

A commit writes the tables that changed and then the marker, a small file that names the
directory of each table. Readers see either the old state or the new one. Tables that are the
ones read last (a status change leaves contents and chunks alone) are named again, not
written. A marker is never overwritten: of two writers that follow one version, one fails
and its tables go.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from vellum.operators.catalog import Snapshot
from vellum.schemas import TABLES


class Conflict(RuntimeError):
    """Another writer has committed since this store was read."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._base: tuple[int, dict[str, str], Snapshot | None] | None = None

    def _at(self, place: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{place}" if place else self.path)

    @property
    def _files(self):
        return self._at("").getFileSystem(self._conf)

    def version(self) -> int:
        """The latest committed version; 0 if there is none."""
        marks = self._at("versions")
        if not self._files.exists(marks):
            return 0
        names = [f.getPath().getName() for f in self._files.listStatus(marks)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def read(self, version: int | None = None) -> Snapshot:
        """The latest state, which the next commit follows, or the one of a given version."""
        latest = self.version() if version is None else version
        if not latest:
            places, snapshot = {}, Snapshot.empty(self.spark)
        else:
            places = json.loads(self.spark.read.text(f"{self.path}/versions/{latest}.json").first()[0])
            of = lambda name, schema: self.spark.read.schema(T.StructType(schema.fields)).parquet(f"{self.path}/{places[name]}").select(*schema.names)
            snapshot = Snapshot(**{name: of(name, schema) for name, schema in TABLES.items()})
        if version is None:
            self._base = (latest, places, snapshot if latest else None)
        return snapshot

    def commit(self, s: Snapshot) -> int:
        """The new version: the one after the last read or commit of this store, or after the latest if there was none.

        Chunks, contents and documents are partitioned by library, so a library's reads prune to its files.
        """
        before, held, last = self._base or (self.version(), {}, None)
        version, token, places = before + 1, uuid.uuid4().hex, {}
        for name in TABLES:
            table = getattr(s, name)
            if last is not None and table is getattr(last, name):
                places[name] = held[name]
                continue
            places[name] = f"data/{token}/{name}"
            writer = table.select(*TABLES[name].names).write
            (writer.partitionBy("library_id") if name != "libraries" else writer).parquet(f"{self.path}/{places[name]}")
        try:
            self._mark(version, places)
        except Conflict:
            self._files.delete(self._at(f"data/{token}"), True)
            raise
        self._base = (version, places, s)
        return version

    def _mark(self, version: int, places: dict[str, str]) -> None:
        """Written beside its place and renamed to it, which fails where there is one already."""
        draft, mark = self._at(f"versions/.{uuid.uuid4().hex}"), self._at(f"versions/{version}.json")
        out = self._files.create(draft, False)
        out.writeBytes(json.dumps(places) + "\n")
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(self._conf).getUri(), self._conf).rename(draft, mark, options)
        except Exception as e:
            self._files.delete(draft, False)
            if self._files.exists(mark):
                raise Conflict(f"version {version} is there already") from e
            raise
