"""Streams equal the batch over the same events, over files out of order, restarts and stops."""

import random
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from factlake.streaming import limiter, progress

SECOND = 1_000_000


def drained(stream, path, checkpoint):
    """Runs the stream over what is there, twice as long as it finds something, and stops it."""
    run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
    try:
        for _ in range(3):
            run.processAllAvailable()
    finally:
        run.stop()


def test_limiter_stream_is_the_batch(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), 1000 + r.randrange(600), n) for n in range(300)] + [("z", 10_000, 1000)]  # the last moves the watermark past all
    events = spark.createDataFrame(rows, "k string, sec long, n int").withColumn("at", F.timestamp_seconds("sec")).drop("sec")
    for k, own in enumerate((events.where("n < 1000 and n % 3 = 0"), events.where("n < 1000 and n % 3 = 1"), events.where("n < 1000 and n % 3 = 2"), events.where("n = 1000"))):
        own.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        time.sleep(0.05)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    drained(limiter.limit_stream(stream, "k", "at", "n", 2, 60 * SECOND, "1 hour"), f"{tmp_path}/out", f"{tmp_path}/c")
    got = {(x.k, x.n): x.allowed for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = limiter.limit_events(events.withColumn("at", F.unix_micros("at")), "k", "at", "n", 2, 60 * SECOND)
    want = {(x.k, x.n): x.allowed for x in batch.collect()}
    assert want.pop(("z", 1000)) and got == want and 0 < sum(want.values()) < 300


def test_limiter_of_one_large_client(spark):
    """A client of a million events, in batches of bounded size; the first two of each ten seconds pass."""
    events = spark.range(1_000_000).selectExpr("'one' as k", "id as at", "id as n")
    found = limiter.limit_events(events, "k", "at", "n", 2, 9)
    assert found.where("allowed").count() == 200_000 and found.where("allowed <> (n % 10 < 2)").count() == 0


def test_transitions_after_a_restart(spark, tmp_path):
    r = random.Random(5)
    rows = [(f"j{r.randrange(4)}", n, r.choice(["QUEUED", "RUNNING", None, "DONE"])) for n in range(400)]
    events = spark.createDataFrame(rows, "job string, n long, stage string")
    for k in range(2):
        events.where(f"n div 200 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in/*")
        drained(progress.transitions(stream, "job", ["n"], "stage", 50), f"{tmp_path}/out", f"{tmp_path}/c")  # the second run goes on from the first
    before = F.lag("stage").over(Window.partitionBy("job").orderBy("n"))
    first = F.row_number().over(Window.partitionBy("job").orderBy("n")) == 1
    want = events.withColumn("p", before).withColumn("f", first).where("f or not (p <=> stage)").select("job", "n", "stage")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert {tuple(x) for x in got.select("job", "n", "stage").collect()} == {tuple(x) for x in want.collect()}
    assert got.agg(F.max("n_kept")).first()[0] == 50 and got.count() == want.count()


def test_history_goes_with_its_time(spark, tmp_path):
    """A job that comes back after its time starts anew: its stage counts as a change though it is the same."""
    schema = "job string, n long, stage string"
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    spark.createDataFrame([("a", 0, "DONE")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    run = progress.transitions(stream, "job", ["n"], "stage", 50, 1500).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").start()
    out = []
    for k in range(2):
        end = time.time() + 40
        while time.time() < end and len(out) <= k:
            time.sleep(0.5)
            out = spark.read.schema(f"{schema}, n_kept long").parquet(f"{tmp_path}/out").collect() if any(tmp_path.glob("out/*.parquet")) else []
        if not k:
            time.sleep(4)
            spark.createDataFrame([("a", 1, "DONE")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    run.stop()
    assert sorted((x.n, x.n_kept) for x in out) == [(0, 1), (1, 1)]


def test_poll_stops_by_itself(spark, tmp_path):
    jobs = spark.createDataFrame([("a",), ("b",)], "job string")
    schema = "job string, stage string"
    spark.createDataFrame([("a", "RUNNING"), ("b", "SUCCEEDED")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    run = progress.poll_until_done(stream, jobs, "job", "stage", f"{tmp_path}/out", f"{tmp_path}/c", every="200 milliseconds")
    run.processAllAvailable()
    assert run.isActive
    spark.createDataFrame([("a", "FAILED")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    assert run.awaitTermination(40) and not run.isActive and run.exception() is None
    assert {tuple(x) for x in spark.read.schema(schema).parquet(f"{tmp_path}/out").select("job", "stage").collect()} == {("a", "FAILED"), ("b", "SUCCEEDED")}
