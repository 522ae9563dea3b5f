"""Joins of texts by containment and by prefix, without comparing every pair: an automaton for all items at once, and tries held as rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of items in one automaton; more items are searched in more parts. A character costs some 50 bytes there.
PART_BYTES = 2 << 20
#: Leading characters that decide an item's part.
LEAD = 4


def contains_join(texts: DataFrame, items: DataFrame, text_id: str, text: str, item_id: str, item: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(text_id, item_id) of each text and each item that it contains, once for each row of texts and of items.

    Distinct items are dealt into parts by a hash of their first characters, a part that is still too large by a hash of the whole
    item, so that no part holds more than some part_bytes. All texts pass each part's automaton once, in the tasks that read them; hits
    are (text_id, hash of the item) and meet the items' ids afterwards, so copies of an item cost no more search. Null texts and items
    contain nothing and are contained nowhere; an empty item is in every text."""
    spark = texts.sparkSession
    keyed = items.where(F.col(item).isNotNull()).select(F.col(item_id), F.col(item).cast("string").alias("__item")).withColumn("__key", F.unhex(F.md5(F.col("__item").cast("binary"))))
    distinct = keyed.select("__item", "__key").distinct()
    size = F.octet_length("__item") + 1
    n = max(1, -(-(distinct.agg(F.sum(size)).first()[0] or 0) // part_bytes))
    part = F.pmod(F.xxhash64(F.substring("__item", 1, LEAD)), F.lit(n))
    dealt = distinct.withColumn("__part", part).withColumn("__bytes", size)
    cuts = {r["__part"]: -(-r.n // part_bytes) for r in dealt.groupBy("__part").agg(F.sum("__bytes").alias("n")).collect()}  # n rows at most
    found = None
    for p, m in sorted(cuts.items()):
        for k in range(m):
            own = dealt.where(F.col("__part") == p)
            own = own.where(F.pmod(F.xxhash64("__item"), F.lit(m)) == k) if m > 1 else own
            sent = spark.sparkContext.broadcast([(r["__item"], bytes(r["__key"])) for r in own.select("__item", "__key").collect()])  # bounded by part_bytes
            hits = _hits(texts, text_id, text, sent)
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        return texts.select(text_id).crossJoin(items.select(item_id).limit(0)).limit(0)
    return found.join(keyed.select(item_id, "__key"), "__key").select(text_id, item_id)


def _hits(texts: DataFrame, text_id: str, text: str, sent) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, everywhere = ahocorasick.Automaton(), []
        for item, key in sent.value:
            if item:
                automaton.add_word(item, key)
            else:
                everywhere.append(key)
        automaton.make_automaton()
        for batch in batches:
            at, keys = [], []
            for i in range(batch.num_rows):
                own = batch.column(1)[i].as_py()
                if own is None:
                    continue
                hits = set(everywhere)
                if len(automaton):
                    hits.update(key for _, key in automaton.iter(own))
                at += [i] * len(hits)
                keys += hits
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.binary())], names=[text_id, "__key"])

    kind = texts.schema[text_id].dataType.simpleString()
    return texts.select(text_id, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{text_id}` {kind}, __key binary")


def trie(names: DataFrame, name: str, node: str = "node") -> DataFrame:
    """The trie of names as rows: one for each prefix of each name, the empty one and itself included. Names are short by nature; each
    costs its length in rows."""
    return names.withColumn(node, F.explode(F.transform(F.sequence(F.lit(0), F.length(name)), lambda n: F.substring(F.col(name), F.lit(1), n))))
