"""A store of objects by job and key as a Spark data source, written in two phases."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .tree import PACKED_BYTES, Files, _open

_SCHEMA = pa.schema([("job", pa.string()), ("key", pa.string()), ("body", pa.string())])
#: Rows of one job that a task holds before it writes them.
HELD_BYTES = 16 << 20


def _folder(job: str | None) -> str:
    """A folder for each job; what a name may not hold is written as its code."""
    return "job=" if job is None else "job=" + "".join(c if c.isalnum() or c in "-_." else f"%{ord(c):X};" for c in f"+{job}")


class StoreReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.jobs, self.keys = options["path"], None, None
        self.packed = int(options.get("packedBytes", PACKED_BYTES))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute != ("job",):
                yield f
            else:
                self.jobs = values if self.jobs is None else self.jobs & values

    def partitions(self) -> list[InputPartition]:
        """Only the folders of the jobs asked for are listed; files are packed by size."""
        fs, base = _open(self.root)
        if self.jobs is None:
            folders = [x.path for x in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if x.base_name.startswith("job=")]
        else:
            folders = [f"{base}/{_folder(j)}" for j in self.jobs]
        files = sorted((x.path, x.size) for f in folders for x in fs.get_file_info(pafs.FileSelector(f, allow_not_found=True)) if x.extension == "parquet")
        out, pack, size = [], [], 0
        for path, n in files:
            if pack and size + n > self.packed:
                out.append(Files(pack))
                pack, size = [], 0
            pack.append((path, n))
            size += n
        return out + [Files(pack)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.root)
        for path, _ in partition.files:
            with pq.ParquetFile(fs.open_input_file(path)) as f:
                yield from f.iter_batches(4096)


@dataclass
class Staged(WriterCommitMessage):
    """Files that a task has written aside, with the folder that each goes to."""

    files: list[tuple[str, str]]


class StoreWriter(DataSourceArrowWriter):
    """Tasks write below _staging; only the driver's commit moves files to where readers look. Rows of a failed task or a failed job are in
    no job's folder, and abort deletes what they left."""

    def __init__(self, options, overwrite: bool):
        self.root, self.run, self.overwrite = options["path"], uuid.uuid4().hex, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, base = _open(self.root)
        fs.create_dir(f"{base}/_staging/{self.run}", recursive=True)
        held: dict[str, list[pa.Table]] = {}
        size, done = 0, []

        def flush():
            for folder, tables in held.items():
                name = f"_staging/{self.run}/{uuid.uuid4().hex}.parquet"
                with fs.open_output_stream(f"{base}/{name}") as out:
                    pq.write_table(pa.concat_tables(tables), out)
                done.append((name, folder))
            held.clear()

        for batch in iterator:
            table = pa.Table.from_batches([batch]).select(["job", "key", "body"]).cast(_SCHEMA)
            jobs = table.column("job").to_pylist()
            for job in dict.fromkeys(jobs):
                held.setdefault(_folder(job), []).append(table.filter(pa.array([j == job for j in jobs])))
            size += table.nbytes
            if size > HELD_BYTES:
                flush()
                size = 0
        flush()
        return Staged(done)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, base = _open(self.root)
        old = [x.path for x in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if x.base_name.startswith("job=")] if self.overwrite else []
        for path in old:
            fs.delete_dir(path)
        for name, folder in (x for m in messages if m for x in m.files):
            fs.create_dir(f"{base}/{folder}", recursive=True)
            fs.move(f"{base}/{name}", f"{base}/{folder}/{name.rpartition('/')[2]}")
        self._clean(fs, base)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clean(*_open(self.root))

    def _clean(self, fs, base: str) -> None:
        if fs.get_file_info(f"{base}/_staging/{self.run}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{base}/_staging/{self.run}")


class StoreSource(DataSource):
    """Format factlake_store: rows of (job, key, body) below `path`. A condition on job reaches the listing."""

    @classmethod
    def name(cls) -> str:
        return "factlake_store"

    def schema(self) -> str:
        return "job string, key string, body string"

    def reader(self, schema) -> StoreReader:
        return StoreReader(self.options)

    def writer(self, schema, overwrite: bool) -> StoreWriter:
        return StoreWriter(self.options, overwrite)


class SparkStore:
    """A Store over the format factlake_store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(StoreSource)

    def put(self, rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col("job").cast("string").alias("job"), F.col("key").cast("string").alias("key"), F.col("body").cast("string").alias("body"))
        rows.write.format("factlake_store").mode("append").save(self.path)
        return rows.select("job", "key", F.octet_length("body").cast("long").alias("size"))

    def read(self) -> DataFrame:
        return self.spark.read.format("factlake_store").load(self.path)
