"""What the operators share: tables in the shared folder, Arrow batches of bounded size, salted runs
of equal keys, and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker handles at once; a longer text is handled alone.
SLICE_BYTES = 4 << 20
#: Bytes that a Python worker reads between two times that it gives freed memory back.
GIVE_BYTES = 8 << 20
#: Rows of one key that one task compares with each other; larger groups are cut and compared in pairs of cuts.
RUN_ROWS = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it. Where it is unset a local session gets a
    temporary one; on a cluster that would be another folder on each machine, so there it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="factlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def discard(*frames: DataFrame) -> None:
    """Deletes the files of frames that materialize has written and that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.__dict__["materialized"])
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: lineage is cut, and lost
    executors cost nothing that was written. Unlike checkpoint() it computes df once, not twice. discard deletes it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["materialized"] = path
    return out


def unlike(name: str, columns: list[str]) -> str:
    """name, longer if a column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(ids: pa.Array, texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Cuts a batch at row borders into parts of at most limit bytes of text, one row at least."""
    n = len(texts)
    if not n:
        return
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, lo = np.cumsum(size, dtype=np.int64), 0
    while lo < n:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield ids.slice(lo, hi - lo), texts.slice(lo, hi - lo)
        lo = hi


def give_back() -> None:
    """Hands memory that is free in this process back to the system, as Arrow and the C library keep it. Where the library has no such
    call it is left as it is."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, in a worker that gives freed memory back after every GIVE_BYTES of input and when run has ended and its state
    is gone. Workers are used again for later tasks, so what the largest task took would stay with them through all later stages."""

    def given(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = 0
        for batch in batches:
            read += batch.nbytes
            yield batch
            del batch
            if read >= GIVE_BYTES:
                read = 0
                give_back()

    def out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(given(batches))
        give_back()

    return out


def map_texts(docs: DataFrame, fn: Callable[[pa.Array, pa.Array], dict], schema: str, start: Callable[[], object] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs fn over bounded slices of (ids, texts); fn returns named columns. With start, fn gets what
    start made once in the task as third argument. Only the two columns are read."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (start(),) if start else ()
        for batch in batches:
            for ids, texts in slices(batch.column(0), batch.column(1)):
                out = fn(ids, texts, *state)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[k] for k in names)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), schema)


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary()).to_pylist()]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts one after another, and where each begins (one more entry than texts)."""
    arr = pc.fill_null(texts, "").cast(pa.large_string())
    _, where, data = arr.buffers()
    offsets = np.frombuffer(where, np.int64)[arr.offset : arr.offset + len(arr) + 1] if where else np.zeros(len(arr) + 1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return (np.frombuffer(data, np.uint8)[lo:hi] if data and hi > lo else np.empty(0, np.uint8)), offsets - lo


def np_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of n positions over the undirected edges a-b."""
    lab = np.arange(n)
    while True:
        la, lb = lab[a], lab[b]
        open_ = la != lb
        if not open_.any():
            return lab
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low = np.minimum(la, lb)
        np.minimum.at(lab, la, low)
        np.minimum.at(lab, lb, low)
        while not np.array_equal(nxt := lab[lab], lab):
            lab = nxt


def run_pairs(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of sorted keys, all pairs of positions with the same key, a distance at a time."""
    d, i = 1, np.flatnonzero(keys[:-1] == keys[1:])
    while i.size:
        yield i, i + d
        d += 1
        i = i[i + d < len(keys)]
        i = i[keys[i] == keys[i + d]]


def salted_runs(keyed: DataFrame, by: str, name: str, run_rows: int = RUN_ROWS, hot: DataFrame | None = None, buckets: int = 0, *, made: list[DataFrame] | None = None) -> DataFrame:
    """Deals rows of (key long, ...) out by key and sorts them. A key of more than run_rows rows is cut by a hash of column
    `by` into m cuts, and each row goes to the m groups that hold its cut and one other, so that every pair still meets
    and no task gets an unbounded group. Adds column run, the group.

    By default keys are counted, and those of one row dropped: they have no pair. With `hot`, the (bucket, n)
    of those buckets (lowest bits of key) that hold more than run_rows rows, a bucket's keys are cut alike. The table of counts that is
    written for it goes to `made`, to be discarded when the rows have been read."""
    if hot is None:
        counts = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), f"{name}-keys")
        if made is not None:
            made.append(counts)
        dealt = keyed.join(counts, "key")
    else:
        dealt = keyed.withColumn("bucket", F.col("key").bitwiseAND(F.lit(buckets - 1))).join(hot, "bucket", "left").drop("bucket")
    dealt = dealt.withColumn("cuts", F.coalesce(F.ceil(F.col("n") / F.lit(run_rows)), F.lit(1)).cast("int")).drop("n")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(by), F.col("cuts")).cast("int"))
    other = F.explode(F.when(F.col("cuts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("cuts") - 1)))
    dealt = dealt.withColumn("other", other)
    run = F.when(F.col("cuts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    return dealt.withColumn("run", run).drop("cuts", "own", "other").repartition("run").sortWithinPartitions("run", "key")


def whole_runs(batches: Iterable[pa.RecordBatch], rows: int = 1 << 19) -> Iterator[pa.Table]:
    """Joins batches sorted by run to tables of whole runs."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held)
            run = table.column("run").to_numpy()
            cut = int(np.searchsorted(run, run[-1], "left"))
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            n = table.num_rows - cut
    if n:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b) of sortable ids; root is the smallest
    reachable node. Alternates large-star and small-star steps, each written to the shared folder and deleted when the next one
    stands; a hub's edges are summed to a minimum before the shuffle and its join can be split. Self-loops and repeats are allowed."""
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), f"{name}-large")
        discard(edges, low)
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-low")
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        edges = materialize(small.where("a <> b").distinct(), f"{name}-small")
        discard(large, low)
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
        if ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or ups = 1 and least = 0").isEmpty():
            break  # every node points at one root, and no root points on
    roots = edges.select("b").distinct()
    out = materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select(F.col("b").alias("node"), F.col("b").alias("root"))), f"{name}-components")
    discard(edges)
    return out


def bit_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of `bits` bits over the column `hash` (long) of hashes, packed, the lowest bit first. Its size is fixed: with more hashes
    more rows pass that needn't, and none is missed. It is built in parts of 4 KB by the executors."""
    at = f"pmod(hash, {bits}) + 1"
    parts = hashes.groupBy(F.expr(f"bitmap_bucket_number({at})").alias("b")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({at}))").alias("part")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for x in parts:
        out[4096 * (x.b - 1) : 4096 * x.b] = np.frombuffer(x.part, np.uint8)
    return out


def bits_of(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the bitmap."""
    at = hashes % (8 * len(bitmap))
    return (bitmap[at >> 3] >> (at & 7) & 1).astype(bool)


def query_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
