"""A versioned table: whole versions written aside, and a pointer that is moved in one step.

    path/versions/<number>-<id>/   rows, as Parquet
    path/metadata/<number>-<id>.json   the envelope: what the version is and where it came from
    path/CURRENT                   the name of the current version

A version is complete before the pointer names it, and the pointer is replaced by a rename, so a reader gets
one whole version whatever a writer does meanwhile. Renaming must be atomic where the path is, as
on HDFS and local disks.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.session import exists, remove

# What an envelope says of a corpus.
FORMAT, FEATURES = "3.0.0", ["semantic_text", "normalized_text", "rich_metadata"]


class Versions:
    """The versions under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _system(self):
        return self._hadoop(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _put(self, path: str, text: str) -> None:
        """A small file, complete or not there."""
        aside = f"{self.path}/.aside-{uuid.uuid4().hex}"
        out = self._system().create(self._hadoop(aside), True)
        out.write(bytearray(text.encode()))
        out.close()
        qualified = self._system().makeQualified(self._hadoop(aside))
        target = self._system().makeQualified(self._hadoop(path))
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.mkdir(target.getParent(), None, True)
        kind = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        context.rename(qualified, target, options)

    def _text(self, path: str) -> str | None:
        if not exists(self.spark, path):
            return None
        stream = self._system().open(self._hadoop(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def current(self) -> str | None:
        """The name of the current version; None before the first."""
        return self._text(f"{self.path}/CURRENT")

    def names(self) -> list[str]:
        """All complete versions, oldest first; those that were never finished have no envelope."""
        folder = f"{self.path}/metadata"
        if not exists(self.spark, folder):
            return []
        return sorted(s.getPath().getName().removesuffix(".json") for s in self._system().listStatus(self._hadoop(folder)))

    def envelope(self, version: str | None = None) -> dict:
        """What a version's metadata say."""
        name = version or self.current()
        text = self._text(f"{self.path}/metadata/{name}.json") if name else None
        if text is None:
            raise LookupError(f"no version {name} under {self.path}")
        return json.loads(text)

    def write(self, df: DataFrame, description: str = "", source: str = "", original_rows: int | None = None) -> str:
        """Writes a new version, makes it the current one and returns its name. Earlier ones stay.

        What is written is counted and hashed on its way, so the envelope costs no second pass.
        """
        from pyspark.sql import Observation

        names = self.names()
        name = f"{int(names[-1].split('-')[0]) + 1 if names else 1:08d}-{uuid.uuid4().hex[:12]}"
        seen = Observation(name)
        total = F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0))
        df.observe(seen, F.count(F.lit(1)).alias("rows"), total.cast("string").alias("sum")).write.parquet(f"{self.path}/versions/{name}")
        found = seen.get
        import hashlib

        envelope = {
            "description": description, "source": source, "exportedAt": datetime.now(UTC).isoformat(), "version": FORMAT, "features": FEATURES,
            "originalRows": found["rows"] if original_rows is None else original_rows, "uniqueDocuments": found["rows"], "corpusHash": hashlib.sha256(f"{found['rows']}:{found['sum']}".encode()).hexdigest(),
        }
        self._put(f"{self.path}/metadata/{name}.json", json.dumps(envelope, indent=2))
        self._put(f"{self.path}/CURRENT", name)
        return name

    def read(self, version: str | None = None) -> DataFrame:
        """The rows of a version, the current one unless another is named. A reader keeps the version that it began with."""
        name = version or self.current()
        if name is None or name not in self.names():
            raise LookupError(f"no version {name} under {self.path}")
        return self.spark.read.parquet(f"{self.path}/versions/{name}")

    def rollback(self, version: str | None = None) -> str:
        """Makes an earlier version the current one: the one named, or that before the current."""
        names, now = self.names(), self.current()
        if version is None:
            before = [n for n in names if now is not None and n < now]
            if not before:
                raise LookupError("there is no earlier version")
            version = before[-1]
        if version not in names:
            raise LookupError(f"no version {version} under {self.path}")
        self._put(f"{self.path}/CURRENT", version)
        return version

    def prune(self, keep: int) -> list[str]:
        """Removes all but the last ``keep`` versions and the current one, and gives the names of those removed."""
        names, now = self.names(), self.current()
        gone = [n for n in names[: max(0, len(names) - keep)] if n != now]
        for name in gone:
            remove(self.spark, f"{self.path}/metadata/{name}.json")
            remove(self.spark, f"{self.path}/versions/{name}")
        return gone

    def export_json(self, path: str, version: str | None = None) -> None:
        """A version for readers of JSON: corpus/ holds a document a line, metadata.json the envelope."""
        self.read(version).write.mode("overwrite").json(f"{path}/corpus")
        self._put(f"{path}/metadata.json", json.dumps(self.envelope(version), indent=2))
