"""A keyed table fed by batches: a base, the changes since, and a manifest that names both.

Writers put rows into folders of new names and then publish a manifest; a version exists once its manifest does. A
manifest is written beside its place and renamed into it, which fails if the version is taken, so a crash leaves
either the old or the new version and two writers cannot both make the same one. Readers take the latest manifest and
see one version, whatever is written meanwhile.

A batch is published with its number, so a batch that is repeated after a crash is applied once. When ``most`` batches
have gathered, they and the base are folded into a new base, so a reader merges at most that many, however many batches
there have been. Folders that no manifest names (of crashes, and of versions before a fold) are left for an age rule.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.catalog import upsert
from larder.operators.scaling import as_cols, keep_first


@dataclass(frozen=True)
class Manifest:
    version: int
    base: str
    changes: tuple = ()
    last_batch: int = -1


class VersionedTable:
    """Rows with one version of each of ``keys``; the last by (batch, order) counts."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list, most: int = 8):
        self.spark, self.path, self.keys, self.order, self.most = spark, path, keys, order, most

    # files are reached through Spark's own file systems, so the table may lie in any store that Spark reads
    def _at(self, name: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _publish(self, manifest: Manifest) -> None:
        fs, draft = self._at(f"manifests/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        out.close()
        _, place = self._at(f"manifests/{manifest.version:012d}.json")
        if fs.exists(place) or not fs.rename(draft, place):
            raise RuntimeError(f"version {manifest.version} of {self.path} was published by another writer")

    def manifest(self) -> Manifest:
        """The latest published version."""
        fs, folder = self._at("manifests")
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        latest = max(n for n in names if n.endswith(".json"))
        text = self.spark.read.text(f"{self.path}/manifests/{latest}", wholetext=True).first()[0]
        found = json.loads(text)
        return Manifest(found["version"], found["base"], tuple(map(tuple, found["changes"])), found["last_batch"])

    def _write(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def create(self, base: DataFrame) -> VersionedTable:
        self._publish(Manifest(0, self._write(base, "base")))
        return self

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Publish one batch, reduced to the last row of each key; a batch that is already in is left alone."""
        now = self.manifest()
        if batch_id <= now.last_batch:
            return
        last = keep_first(batch, self.keys, [c.desc() for c in as_cols(self.order)])
        name = self._write(last, "change")
        self._publish(replace(now, version=now.version + 1, changes=(*now.changes, (batch_id, name)), last_batch=batch_id))
        if len(now.changes) + 1 >= self.most:
            self.fold()

    def _merged(self, at: Manifest) -> DataFrame:
        base = self.spark.read.parquet(f"{self.path}/{at.base}")
        if not at.changes:
            return base
        parts = [self.spark.read.parquet(f"{self.path}/{name}").withColumn("batch", F.lit(batch)) for batch, name in at.changes]
        stored = parts[0]
        for part in parts[1:]:
            stored = stored.unionByName(part)
        return upsert(base, stored, self.keys, ["batch", *self.order])

    def fold(self) -> None:
        """Write base and changes as a new base and publish it; readers of the version before go on undisturbed."""
        now = self.manifest()
        self._publish(Manifest(now.version + 1, self._write(self._merged(now), "base"), (), now.last_batch))

    def read(self) -> DataFrame:
        """The table as of its latest version."""
        return self._merged(self.manifest())
