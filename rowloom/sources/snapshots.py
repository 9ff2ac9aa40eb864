"""Looked-up results that are kept in versions and only ever grow.

A version is a manifest that names Parquet parts: keys that were looked up and the rows found for
them. A key without rows is remembered too. A run looks up only keys that no part holds, writes new parts and, last, one new
manifest, which appears by a rename; what an interrupted run leaves belongs to no
version. A reader stays on the version it opened.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.session import discard, materialize


class Snapshot:
    """A growing table of (key -> rows) below ``folder``, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The complete versions, ascending."""
        where = self._path(f"{self.folder}/versions")
        if not self._files.exists(where):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, of the latest if none is named; empty before the first."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "parts": [], "key": None, "schema": None}
        read = self.spark.read.text(f"{self.folder}/versions/{version:08d}.json", wholetext=True)
        return json.loads(read.first()[0])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with the version that brought them in ``version``."""
        found = self.manifest(version)
        if not found["parts"]:
            raise ValueError(f"no version in {self.folder}")
        schema = f"{found['schema']}, version int"
        parts = [f"{self.folder}/{part}/rows" for part in found["parts"]]
        return self.spark.read.schema(schema).parquet(*parts)

    def _seen(self, found: dict) -> DataFrame:
        return self.spark.read.schema(found["key"]).parquet(*[f"{self.folder}/{part}/keys" for part in found["parts"]])

    def grow(self, names: DataFrame, key: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Look up the ``key`` values of ``names`` that no version has seen, and read the version that holds all.

        ``build`` takes a table of the unseen keys, once each, and returns the rows
        found for them. NULL is no key. Without unseen keys nothing is written. If another run has
        published the next version meanwhile, this one fails and leaves no trace in any version.
        """
        found = self.manifest()
        wanted = names.select(key).dropna().distinct()
        unseen = materialize(wanted.join(self._seen(found), key, "left_anti") if found["parts"] else wanted, "unseen")
        try:
            if found["parts"] and unseen.isEmpty():
                return self.read(found["version"])
            version = found["version"] + 1
            part = f"parts/{uuid.uuid4().hex}"
            unseen.write.parquet(f"{self.folder}/{part}/keys")
            rows = build(unseen)
            rows.withColumn("version", F.lit(version)).write.parquet(f"{self.folder}/{part}/rows")
            self._publish({
                "version": version, "parts": [*found["parts"], part],
                "key": _ddl(unseen), "schema": found["schema"] or _ddl(rows),
            })
        finally:
            discard(unseen)
        return self.read(version)

    def _publish(self, manifest: dict) -> None:
        folder = f"{self.folder}/versions"
        draft = self._path(f"{folder}/.{uuid.uuid4().hex}")
        target = self._path(f"{folder}/{manifest['version']:08d}.json")
        stream = self._files.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode("utf-8")))
        finally:
            stream.close()
        if self._files.exists(target) or not self._files.rename(draft, target):
            self._files.delete(draft, False)
            raise RuntimeError(f"version {manifest['version']} of {self.folder} was published by another run")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
