"""A record store that a merge rewrites only where records change (SC5, SC10).

Records lie in buckets by a hash of project and id; the files of a bucket are one folder of
Parquet. A manifest per version names the folder of every bucket. A merge reads and rewrites
the buckets that incoming rows fall into, and makes the new manifest visible by one rename as its
last step: until then, and after any failure before it, readers see the old version. Of two merges
from the same version one fails at the rename and can be run again. Old versions stay readable until
``vacuum``.

The manifest has one line per bucket, so what passes through the driver does not grow with the
records. Number the buckets so that one is a few hundred MB; a hot project is spread over all of them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from projectpulse.operators.memory import check_record_types, upsert

BUCKETS = 64


class RecordStore:
    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS) -> None:
        """``schema`` is the DDL of the records; ``buckets`` holds for a new store and is read from the manifest of an old one."""
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._files = self._place("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _place(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        folder = self._place("manifests")
        if not self._files.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(folder)]
        return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "buckets", "folders": bucket -> folder}; an empty one for a new store."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "buckets": self.buckets, "folders": {}}
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"the store has no version {version}")
        lines = self.spark.read.text(f"{self.path}/manifests/{version}.json", wholetext=True).first()
        return json.loads(lines[0])

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{folder}" for folder in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """All records of the newest or a given version."""
        return self._rows(sorted(self.manifest(version)["folders"].values()))

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64("project_id", "record_id"), F.lit(buckets)).cast("int")

    def merge(self, incoming: DataFrame) -> dict:
        """Insert or replace by project and id, newest first; returns the new manifest. Merging the same rows twice changes no record."""
        before = self.manifest()
        buckets = before["buckets"]
        placed = check_record_types(self._rows([]).unionByName(incoming)).withColumn("bucket", self._bucket(buckets))
        touched = sorted(row["bucket"] for row in placed.select("bucket").distinct().collect())  # at most one per bucket
        if not touched:
            return before
        stored = self._rows([before["folders"][str(b)] for b in touched if str(b) in before["folders"]])
        merged = upsert(stored, placed.drop("bucket")).withColumn("bucket", self._bucket(buckets))
        batch = f"data/{uuid.uuid4().hex}"
        merged.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{batch}")
        folders = before["folders"] | {str(b): f"{batch}/bucket={b}" for b in touched}
        after = {"version": before["version"] + 1, "buckets": buckets, "folders": folders}
        self._publish(after)
        return after

    def _publish(self, manifest: dict) -> None:
        name = f"manifests/{manifest['version']}.json"
        draft = self._place(f"manifests/.{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._files.exists(self._place(name)) or not self._files.rename(draft, self._place(name)):
            self._files.delete(draft, False)
            raise RuntimeError(f"version {manifest['version']} was published by another merge; merge again")

    def vacuum(self, keep: int = 2) -> None:
        """Forget all but the newest ``keep`` versions, and the data that no kept manifest names."""
        known = self.versions()
        kept = known[-max(keep, 1) :]
        named = {folder for version in kept for folder in self.manifest(version)["folders"].values()}
        for version in set(known).difference(kept):
            self._files.delete(self._place(f"manifests/{version}.json"), False)
        if not self._files.exists(self._place("data")):
            return
        for batch in self._files.listStatus(self._place("data")):
            folders = {f"data/{batch.getPath().getName()}/{part.getPath().getName()}": part for part in self._files.listStatus(batch.getPath())}
            if not named.intersection(folders):
                self._files.delete(batch.getPath(), True)
                continue
            for folder, part in folders.items():
                if part.isDirectory() and folder not in named:
                    self._files.delete(part.getPath(), True)
