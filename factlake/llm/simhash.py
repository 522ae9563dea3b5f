"""SimHash near-duplicates by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bit_filter, bits_of, components, discard, lean, map_texts, materialize, np_components, run_pairs, salted_runs, slices, unlike, whole_runs

SEED, WORDS, BITS = 42, 4, 4
#: Bits of the filters that decide rows in place; their size doesn't grow.
FILTER_BITS = 1 << 26


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of one UTF-8 text, repeats included; 0 without words."""
    own = text.lower().split()  # of bytes: A-Z only, and at 20 09-0D only
    if not own:
        return 0
    line, h = b" ".join(own), xxhash.xxh64_intdigest
    if len(own) <= words:
        return h(line, seed)
    size = np.fromiter(map(len, own), np.int64, len(own)) + 1
    ends = np.cumsum(size) - 1
    begin, end = (ends - size + 1)[: 1 - words].tolist(), ends[words - 1 :].tolist()
    hashes = np.fromiter((h(line[i:j], seed) for i, j in zip(begin, end)), np.uint64, len(begin))
    votes = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) a row; null text counts as empty."""

    def run(ids, texts):
        return {"doc_id": ids, "fp": pa.array(np.array([fingerprint(x) for x in as_bytes(texts)], np.uint64).view(np.int64))}

    return map_texts(docs, run, "doc_id long, fp long", id_col=id_col, text_col=text_col)


def blocks(n: int, bits: int = BITS) -> list[list[tuple[int, int]]]:
    """Keys for n distinct fingerprints: of k blocks, `bits` at most hold a difference, so some k - bits
    blocks agree. Any k finds the same pairs; k grows with n so that chance meetings stay few for each
    fingerprint. Each key is a list of (shift, width)."""
    k = next(k for k in range(bits + 2, 33) if n * comb(k, bits) / 2 ** (64 * (k - bits) / k) <= 64 or k == 16)
    edges = [64 * i // k for i in range(k + 1)]
    parts = [(edges[i], edges[i + 1] - edges[i]) for i in range(k)]
    return [list(x) for x in combinations(parts, k - bits)]


def links(distinct: DataFrame, n: int, bits: int = BITS) -> DataFrame:
    """Edges (a, b) that join the distinct fingerprints (fp) within `bits` bits, fewer than all pairs: in
    each group of a shared key, those that are linked point at their smallest."""
    keys = [F.xxhash64(F.lit(i), *(F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in own)) for i, own in enumerate(blocks(n, bits))]
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    made: list[DataFrame] = []
    dealt = salted_runs(keyed, "fp", "simhash", made=made).select("run", "fp")

    def run(batches):
        for table in whole_runs(batches):
            runs, fps = table.column("run").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
            at, to, held = [], [], 0
            lab = np.arange(len(runs))
            for i, j in run_pairs(runs):
                near = np.bitwise_count(fps[i] ^ fps[j]) <= bits
                near &= lab[i] != lab[j]
                at.append(i[near])
                to.append(j[near])
                held += len(at[-1])
                if held > 1 << 16:
                    lab, at, to, held = joined(lab, at, to), [], [], 0
            lab = joined(lab, at, to)
            child = np.flatnonzero((lab != np.arange(len(lab))) & (fps != fps[lab]))
            yield pa.RecordBatch.from_arrays([pa.array(fps[child].view(np.int64)), pa.array(fps[lab[child]].view(np.int64))], names=["a", "b"])

    edges = materialize(dealt.mapInArrow(lean(run), "a long, b long"), "simhash-edges")
    discard(*made)
    return edges


def joined(lab: np.ndarray, at: list[np.ndarray], to: list[np.ndarray]) -> np.ndarray:
    if not at:
        return lab
    more = np.arange(len(lab))
    return np_components(len(lab), np.concatenate([more, *at]), np.concatenate([lab, *to]))


def roots(fps: DataFrame, least: Column, bits: int = BITS) -> DataFrame:
    """(fp, least, n, root) of the distinct fingerprints: an aggregate of each one's rows, their number, and the name of its component."""
    distinct = materialize(fps.groupBy("fp").agg(least.alias("least"), F.count("*").alias("n")), "simhash-distinct")
    edges = links(distinct.select("fp"), distinct.count(), bits)
    found = components(edges, "simhash")
    rooted = materialize(distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    discard(distinct, found, edges)
    return rooted


def _short(h: bytes) -> int:
    return int.from_bytes(h[:8], "little", signed=True)


def _row_key(i: int | None, h: bytes) -> int:
    """64 bits of a row's id and the hash of its text."""
    return xxhash.xxh3_64_intdigest(h + repr(i).encode()) - (1 << 63)


def keep_first(docs: DataFrame, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of near-duplicates: that of the smallest id (a whole number), null ids last, then of the
    smallest hash of the text (128 bits); of rows that have both alike the one whose other columns are the smallest as JSON. Null and empty texts
    have fingerprint zero and are one component; an empty table stays empty.

    Only ids and hashes are shuffled to decide. Two bitmaps of fixed size then tell a row in place: one of texts whose component has
    more than one row (a row of none of those stays), one of the rows that stay of such components (a row of none of those goes).
    The few rows that pass both meet the list itself, and that decides."""

    def prints(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for ids, texts in slices(batch.column(0), batch.column(1)):
                raw = as_bytes(texts)
                fps = np.array([fingerprint(x) for x in raw], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary()), pa.array(fps)], names=["id", "h", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    fps = materialize(narrow.mapInArrow(lean(prints), "id long, h binary, fp long"), "simhash-fps")
    rooted = roots(fps, F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h")), bits)
    groups = materialize(rooted.groupBy("root").agg(F.min("least").alias("first"), F.sum("n").alias("n")).where("n > 1"), "simhash-groups")
    crowded = rooted.join(groups.select("root"), "root", "left_semi").select("fp")

    def shorts(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_short(h) for h in batch.column(0).to_pylist()], pa.int64())], names=["hash"])

    def keys(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            both = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([_row_key(i, h) for i, h in both], pa.int64())], names=["hash"])

    many = bit_filter(fps.join(crowded, "fp", "left_semi").select("h").mapInArrow(shorts, "hash long"), FILTER_BITS)
    stay = bit_filter(groups.select("first.id", "first.h").mapInArrow(keys, "hash long"), FILTER_BITS)
    held = docs.sparkSession.sparkContext.broadcast((many, stay))
    discard(rooted, fps)

    own_id = unlike("__id", docs.columns)
    own_hash = unlike("__h", docs.columns)

    def told(open_: bool):
        def run(batches: Iterable[pa.RecordBatch]):
            many, stay = held.value
            for batch in batches:
                names = batch.schema.names
                raw = as_bytes(batch.column(names.index(text_col)))
                hashes = [xxhash.xxh3_128_digest(x) for x in raw]
                ids = batch.column(names.index(own_id)).to_pylist()
                crowd = bits_of(many, np.array([_short(h) for h in hashes], np.int64))
                if open_:
                    crowd &= bits_of(stay, np.array([_row_key(i, h) for i, h in zip(ids, hashes)], np.int64))
                own = pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.binary())], names=[*names, own_hash])
                yield own.filter(pa.array(crowd if open_ else ~crowd))

        return run

    rows = docs.withColumn(own_id, F.col(id_col).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{own_hash}` binary"
    alone, open_ = (rows.mapInArrow(told(x), schema) for x in (False, True))
    first = groups.select(F.col("first.id").alias("f"), F.col("first.h").alias("g"))
    row, other = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]), F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns if c != text_col]))
    open_ = open_.groupBy(F.col(own_id).alias("i"), F.col(own_hash).alias("h")).agg(F.min_by(row, other).alias("row"))
    open_ = open_.join(first, F.col("i").eqNullSafe(F.col("f")) & (F.col("h") == F.col("g")), "left_semi")
    return alone.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(open_.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def near_duplicates(docs: DataFrame, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id
    reachable over fingerprints that differ in at most `bits` bits, itself included).

    Null and empty texts have fingerprint zero. Repeated rows stay repeated; an empty table gives no rows; other columns aren't
    read. Null ids are never a component's name unless it has no other. Equal texts are one node, so a group of copies costs one;
    a very long text is a slice of its own, hashed in parts."""
    fps = materialize(fingerprints(docs, id_col, text_col), "simhash-fps")
    rooted = roots(fps, F.min("doc_id"), bits)
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    named = materialize(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "simhash-named")
    discard(rooted, least)
    out = fps.join(named, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
