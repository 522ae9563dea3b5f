"""Reading tables and source trees, writing results."""

from __future__ import annotations

import tempfile
import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that a source scan leaves out, and the size from which a file is left out.
PRUNED = ("target", ".git", "node_modules", ".anchor", "test", "tests", "migrations")
MOST_BYTES = 500_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows that a task holds of what is spread: source files, findings, keys that files are made from.
SPREAD_ROWS = 2048


def spread(df: DataFrame, *by: str, rows: int = SPREAD_ROWS) -> DataFrame:
    """df dealt by a hash of `by` over as many partitions as keep some `rows` rows each, however few files it comes from and whatever the
    number of shuffle partitions is; a key's rows stay together. The rows are counted, so df should be cheap to read twice."""
    return df.repartition(max(1, -(-df.count() // rows)), *by)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Where that is unset a local session gets a temporary one; on a cluster it
    is an error, as each machine would write to its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="factlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet under a new path in the shared folder, and read from there. remove deletes it again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["written_to"] = path
    return out


def remove(*frames: DataFrame) -> None:
    """Deletes what written has written, when nothing reads it any more."""
    for df in frames:
        remove_path(df.sparkSession, df.__dict__["written_to"])


def remove_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def source_files(spark: SparkSession, root: str, pattern: str = "*.rs", pruned: tuple[str, ...] = PRUNED, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, length, content) of the files below root, however deep, that match the pattern. The size limit reaches the
    scan, so large files aren't opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    inside = F.split(F.regexp_replace("path", f"^(file:)?/*{root.removeprefix('file:').strip('/')}/", ""), "/")
    files = files.where(F.col("length") < most_bytes).where(~F.exists(F.slice(inside, F.lit(1), F.size(inside) - 1), lambda s: s.isin(*pruned)))
    return files.select("path", "length", F.decode("content", "UTF-8").alias("content"))


def framework(sources: DataFrame, manifests: DataFrame, repo: str = "repo_id", path: str = "path", sampled: int = 20) -> DataFrame:
    """(repo_id, framework): anchor if a manifest names it, else native if one of the first `sampled` sources has an entry
    point, else unknown."""
    from pyspark.sql import Window

    named = manifests.groupBy(repo).agg(F.bool_or(F.col("content").contains("anchor-lang")).alias("anchor"))
    first = sources.withColumn("__n", F.row_number().over(Window.partitionBy(repo).orderBy(path))).where(F.col("__n") <= sampled)
    entry = F.col("content").contains("entrypoint!") | F.col("content").contains("process_instruction")
    native = first.groupBy(repo).agg(F.bool_or(entry).alias("native"))
    return named.join(native, repo, "full").select(repo, F.when(F.col("anchor"), "anchor").when(F.col("native"), "native").otherwise("unknown").alias("framework"))


def program_name(manifests: DataFrame, directory: str = "directory") -> DataFrame:
    """(repo_id, program): the first manifest's name, by path, that doesn't hold `test`, else the last part of the directory. manifests:
    repo_id, path, content, directory; a repository without a manifest has a row with null content."""
    name = F.regexp_extract(F.coalesce("content", F.lit("")), r'name\s*=\s*"([^"]+)"', 1)
    rows = manifests.withColumn("__name", F.when((name != "") & ~name.contains("test"), name))
    found = rows.groupBy("repo_id").agg(F.min(F.when(F.col("__name").isNotNull(), F.struct("path", "__name"))).alias("x"), F.min(directory).alias("d"))
    return found.select("repo_id", F.coalesce("x.__name", F.element_at(F.split("d", "/"), -1)).alias("program"))


def program_id(files: DataFrame) -> DataFrame:
    """(repo_id, program_id): of the first file by path that declares one; repositories without one are left out."""
    found = F.regexp_extract("content", r'declare_id!\s*\(\s*"([^"]+)"\s*\)', 1)
    rows = files.select("repo_id", "path", found.alias("program_id")).where("program_id <> ''")
    return rows.groupBy("repo_id").agg(F.min_by("program_id", "path").alias("program_id"))


def put_objects(df: DataFrame, path: str, job: str, key: str, body: str) -> DataFrame:
    """Stores bodies by job and key, one folder for each job, and returns (job, key, size in bytes). A later write of a key is found
    by latest(); the rows are written before they are returned."""
    rows = df.select(F.col(job).alias("job"), F.col(key).alias("key"), F.octet_length(body).cast("long").alias("size"), F.col(body).alias("body"))
    rows.write.mode("append").partitionBy("job").parquet(path)
    return rows.select("job", "key", "size")


class Store(Protocol):
    """Where objects go: anything that takes rows of (job, key, body) and gives back (job, key, size). ParquetStore is the one here."""

    def put(self, rows: DataFrame) -> DataFrame: ...

    def read(self) -> DataFrame: ...


class ParquetStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, rows: DataFrame) -> DataFrame:
        return put_objects(rows, self.path, "job", "key", "body")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    """Adds rows to a Parquet table, one folder for each value of `by`."""
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def latest(events: DataFrame, key: list[str], at: str) -> DataFrame:
    """Of an append-only table of states the last row of each key."""
    rest = [c for c in events.columns if c not in key]
    last = events.groupBy(*key).agg(F.max(F.struct(at, *[c for c in rest if c != at])).alias("__last"))
    return last.select(*key, *[F.col(f"__last.{c}").alias(c) for c in rest])


def artifacts(df: DataFrame, purpose: str, kind: str, part: str, metadata: str = "metadata", type_: str = "type", name: str = "name") -> DataFrame:
    """Rows whose metadata (JSON) has the purpose, or whose type is `kind`, or whose name contains `part`; a null or broken side decides
    nothing by itself."""
    said = F.try_variant_get(F.try_parse_json(metadata), "$.purpose", "string") == purpose
    return df.where(F.coalesce(said, F.lit(False)) | F.coalesce(F.col(type_) == kind, F.lit(False)) | F.coalesce(F.col(name).contains(part), F.lit(False)))


def without_keys(df: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """What a delete of these keys leaves; for parent and child tables alike."""
    return df.join(gone.select(*key).distinct(), key, "left_anti")
