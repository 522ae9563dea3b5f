"""A table of states by key: a snapshot and deltas, and a manifest that says which folders are the table."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has made the next version first."""


class Versions:
    """Rows by key under `path`. put and delete add a folder of rows, compact folds all folders into one, and each makes a new version: a
    manifest file that names its folders in order. The file of a version is created once, so of two writers of the same version one gets a
    Conflict and may try again. Readers take the folders of the last manifest and keep them: what a version holds is
    never written again, and only vacuum deletes what no kept version names."""

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _fs(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        fs = self._fs()
        if not fs.exists(self._at("_manifest")):
            return []
        return sorted(int(x.getPath().getName().split(".")[0]) for x in fs.listStatus(self._at("_manifest")) if x.getPath().getName().endswith(".json"))

    def folders(self, version: int) -> list[str]:
        """Of the version's manifest, the oldest first. Version 0 has none."""
        if not version:
            return []
        stream = self._fs().open(self._at(f"_manifest/{version:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["folders"]
        finally:
            stream.close()

    def last(self) -> int:
        return max(self.versions(), default=0)

    def _commit(self, version: int, folders: list[str]) -> int:
        try:
            out = self._fs().create(self._at(f"_manifest/{version:010d}.json"), False)
        except Exception as e:
            raise Conflict(f"version {version} is there already") from e
        out.write(bytearray(json.dumps({"folders": folders}).encode()))
        out.close()
        return version

    def _add(self, rows: DataFrame) -> int:
        base = self.last()
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return self._commit(base + 1, [*self.folders(base), folder])

    def put(self, rows: DataFrame) -> int:
        """Adds rows over those of the same keys; a key stands in rows once."""
        return self._add(rows.withColumn("__gone", F.lit(False)))

    def delete(self, keys: DataFrame) -> int:
        """Takes the rows of these keys away; children of a parent are tables by the parent's key, see delete_cascade."""
        rows = self._rows(self.last())
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in (*self.key, "__gone", "__order")]
        return self._add(keys.select(*self.key).distinct().select(*self.key, *rest, F.lit(True).alias("__gone")))

    def _rows(self, version: int) -> DataFrame:
        folders = self.folders(version)
        if not folders:
            raise ValueError("the table has no rows yet")
        parts = [self.spark.read.parquet(f"{self.path}/{f}").withColumn("__order", F.lit(n)) for n, f in enumerate(folders)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def read(self, version: int | None = None) -> DataFrame:
        """The last row of each key, of the last version or of a given one. A version of one folder is read as it is, without a shuffle."""
        version = self.last() if version is None else version
        rows = self._rows(version)
        if len(self.folders(version)) > 1:
            rest = [c for c in rows.columns if c not in (*self.key, "__order")]
            last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), "__order").alias("__last"))
            rows = last.select(*self.key, *[F.col(f"__last.{c}").alias(c) for c in rest])
        return rows.where("not __gone").select(*[c for c in rows.columns if c not in ("__gone", "__order")])

    def compact(self) -> int:
        """Folds all folders into one. Readers of the versions before go on with theirs; a put in between makes this a Conflict."""
        base = self.last()
        folder = f"data/{uuid.uuid4().hex}"
        self.read(base).withColumn("__gone", F.lit(False)).write.parquet(f"{self.path}/{folder}")
        return self._commit(base + 1, [folder])

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes the manifests before the last `keep` and the folders that none of those names, also what failed writers have left. Not to
        be called while writers are at work."""
        fs, all_ = self._fs(), self.versions()
        kept = {f for v in all_[-keep:] for f in self.folders(v)}
        for v in all_[:-keep]:
            fs.delete(self._at(f"_manifest/{v:010d}.json"), False)
        gone = [f"data/{x.getPath().getName()}" for x in (fs.listStatus(self._at("data")) if fs.exists(self._at("data")) else []) if f"data/{x.getPath().getName()}" not in kept]
        for f in gone:
            fs.delete(self._at(f), True)
        return gone


def delete_cascade(keys: DataFrame, parent: Versions, *children: tuple[Versions, str]) -> None:
    """Deletes keys of the parent and first all rows of the children that refer to them: (table, column that holds the parent's key)."""
    for table, column in children:
        rows = table.read()
        own = keys.select(F.col(parent.key[0]).alias(column)).distinct()
        table.delete(rows.join(own, column, "left_semi"))
    parent.delete(keys)
