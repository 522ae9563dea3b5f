"""What Python workers keep between batches."""

import re
import sys
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from factlake.llm import common


def test_workers_give_memory_back(spark):
    """The pipeline's stages share workers: what one had freed stayed with it, beside the JVM, until an executor took more than its memory."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1000).alias("text")).coalesce(1)

    def run(ids, texts):
        mb = sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024
        held = [bytes(1000) for _ in range(100_000)]
        sys.pinned = [*getattr(sys, "pinned", []), bytes(1000)]  # stands above what is freed now
        del held
        return {"doc_id": ids, "mb": pa.array([mb] * len(ids))}

    mb = {r.doc_id: r.mb for r in common.map_texts(docs, run, "doc_id long, mb long").where("doc_id in (0, 9999, 10000)").collect()}
    assert mb[9999] > mb[0] + 80 and mb[10_000] < mb[0] + 40  # within a batch, and after it
