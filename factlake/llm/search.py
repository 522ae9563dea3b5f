"""Ranked lexical search by inverted treaps: of each term a tree over its documents, ordered by document and heaped by impact."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, discard, map_texts, materialize

TOP = 20
#: Bytes of item texts that are searched for at once; more items take more passes over the documents.
BLOCK_BYTES = 16 << 20
#: Postings of one part of the documents, for which a task builds its treaps, and of a range that is scored without further cuts.
PART_POSTINGS, LEAF = 1 << 18, 1024
#: Bytes of one text that are cut into terms at once.
CHUNK = 1 << 20
#: Terms are runs of digits, letters and all that isn't ASCII; A-Z are folded.
_FOLD = bytes(b if b > 127 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def term_counts(raw: bytes) -> tuple[int, Counter]:
    """How many terms a UTF-8 text has, and how often each."""
    folded, lo, n, found = raw.translate(_FOLD), 0, 0, Counter()
    while lo < len(folded):
        hi = folded.find(b" ", lo + CHUNK)
        hi = len(folded) if hi < 0 else hi
        terms = folded[lo:hi].split()
        n += len(terms)
        found.update(terms)
        lo = hi
    return n, found


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """Of each term, by the documents that hold it."""
    return np.floor(1000.0 * np.log((2.0 * n_docs + 2.0) / (2.0 * df + 1.0))).astype(np.int64)


class Treaps:
    """The treaps of all terms over some documents, in arrays. Postings lie by term, then document, so a subtree is a run of them; left and
    right are its nodes' children. The root of a run has its largest impact; equal ones are heaped by a hash of their place, so
    that runs of equal impact make no long chains."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int):
        order = np.lexsort((doc, term))
        term, self.doc, self.impact = term[order], doc[order], impact[order]
        n = len(term)
        at = np.arange(n + 1)
        self.start, self.end = np.searchsorted(term, np.arange(n_terms), "left"), np.searchsorted(term, np.arange(n_terms), "right")
        heap = (self.impact << 20) | ((at[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64))
        first, last = self.start[term], self.end[term]
        # the nearest larger node on each side, by following those already found
        before, after = at[:-1] - 1, at[:-1] + 1
        open_ = np.arange(n)
        while len(open_ := open_[before[open_] >= first[open_]]) and len(open_ := open_[heap[before[open_]] < heap[open_]]):
            before[open_] = before[before[open_]]
        open_ = np.arange(n)
        while len(open_ := open_[after[open_] < last[open_]]) and len(open_ := open_[heap[after[open_]] <= heap[open_]]):
            after[open_] = after[after[open_]]
        has_before, has_after = before >= first, after < last
        low, high = heap[np.where(has_before, before, 0)] if n else heap, heap[np.where(has_after, after, 0)] if n else heap
        under_after = has_after & (~has_before | (high <= low))
        under_before = has_before & ~under_after
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self.left[after[under_after]], self.right[before[under_before]] = np.flatnonzero(under_after), np.flatnonzero(under_before)
        self.root = np.full(n_terms, -1)
        top = np.flatnonzero(~has_before & ~has_after)
        self.root[term[top]] = top

    def within(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The root of what each subtree holds in lo <= place < hi, which isn't empty: the first node on the way down that lies there."""
        node = node.copy()
        while len(off := np.flatnonzero((node < lo) | (node >= hi))):
            node[off] = np.where(node[off] < lo[off], self.right[node[off]], self.left[node[off]])
        return node

    def best(self, terms: np.ndarray, times: np.ndarray, k: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, int]:
        """The k documents of the highest score above 0, equal ones by document, with their scores, and how many postings were looked at.

        All terms' treaps are traversed together over ranges of documents, those of the highest bound first. A range's bound is the sum of
        its subtrees' largest impacts; below the k-th best score so far it is cut off. Otherwise the document of the largest
        impact is scored and splits the range; a range of few postings is scored whole."""
        times, terms = times[self.root[terms] >= 0], terms[self.root[terms] >= 0]
        docs, scores, least, looked, made = np.empty(0, np.int64), np.empty(0, np.int64), 0, 0, 0
        heap: list = []

        def put(t, x, lo, hi, node):
            nonlocal made
            if len(t) and (bound := int((x * self.impact[node]).sum())) >= max(least, 1):
                made += 1
                heapq.heappush(heap, (-bound, made, t, x, lo, hi, node))

        def keep(d, s):
            nonlocal docs, scores, least
            at = s >= max(least, 1)
            docs, scores = np.concatenate([docs, d[at]]), np.concatenate([scores, s[at]])
            if len(docs) >= k:
                order = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[order], scores[order]
                least = int(scores[-1])

        put(terms, times, self.start[terms], self.end[terms], self.root[terms])
        while heap and -heap[0][0] >= least:
            _, _, t, x, lo, hi, node = heapq.heappop(heap)
            size = hi - lo
            if (total := int(size.sum())) <= leaf:
                at = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
                d, s = self.doc[at], self.impact[at] * np.repeat(x, size)
                order = np.argsort(d, kind="stable")
                own, first = np.unique(d[order], return_index=True)
                looked += total
                keep(own, np.add.reduceat(s[order], first))
                continue
            pivot = self.doc[node[np.argmax(x * self.impact[node])]]
            cut = np.array([a + np.searchsorted(self.doc[a:b], pivot) for a, b in zip(lo.tolist(), hi.tolist())])
            hit = (cut < hi) & (self.doc[np.minimum(cut, hi - 1)] == pivot)
            looked += int(hit.sum())
            keep(np.array([pivot]), np.array([(x[hit] * self.impact[cut[hit]]).sum()]))
            for a, b in ((lo, cut), (cut + hit, hi)):
                some = a < b
                put(t[some], x[some], a[some], b[some], self.within(node[some], a[some], b[some]))
        order = np.lexsort((docs, -scores))[:k]
        return docs[order], scores[order], looked


def _postings(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of each row: its number of terms, and how often it holds those of the vocabulary."""

    def run(ids, texts):
        ns, sizes, terms, tfs = [], [0], [], []
        known = vocabulary.value
        for raw in as_bytes(texts):
            n, found = term_counts(raw)
            own = [(known[t], c) for t, c in found.items() if t in known]
            ns.append(n)
            terms += [t for t, _ in own]
            tfs += [c for _, c in own]
            sizes.append(len(terms))
        at = pa.array(sizes, pa.int32())
        return {"doc_id": ids, "n": pa.array(ns, pa.int64()), "terms": pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), "tfs": pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))}

    return map_texts(docs, run, "doc_id long, n long, terms array<int>, tfs array<long>", id_col=id_col, text_col=text_col)


def _search_block(docs: DataFrame, block: list[tuple[int | None, bytes]], k: int, id_col: str, text_col: str) -> DataFrame | None:
    """(item, item_id, doc_id, score) of the items of one block, at most k of each item from each part of the documents."""
    spark = docs.sparkSession
    asked = [(i, item_id, term_counts(raw)[1]) for i, (item_id, raw) in enumerate(block)]
    words = {t: j for j, t in enumerate(sorted({t for *_, own in asked for t in own}))}
    if not words:
        return None
    rows = materialize(_postings(docs, spark.sparkContext.broadcast(words), id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "search-postings")
    stats = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms"), F.sum(F.size("terms")).alias("postings")).first()
    df = np.zeros(len(words), np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row for each term of the block
        df[r.t] = r["count"]
    n_docs, n_terms = stats.docs, stats.terms or 0
    items = [(i, item_id, np.array([words[t] for t in own], np.int64), np.array(list(own.values()), np.int64)) for i, item_id, own in asked if own]
    sent = spark.sparkContext.broadcast((items, weights(df, n_docs)))
    parts = max(1, -(-(stats.postings or 0) // PART_POSTINGS))

    def run(table: pa.Table) -> pa.Table:
        items, w = sent.value
        ids, n = table.column("doc_id").combine_chunks(), table.column("n").to_numpy()
        missing = np.asarray(ids.is_null())
        order = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), missing))  # null ids last
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lists = table.column("terms").combine_chunks()
        row = np.repeat(np.arange(len(order)), np.asarray(lists.value_lengths()))
        term, tf = np.asarray(lists.flatten()).astype(np.int64), np.asarray(table.column("tfs").combine_chunks().flatten())
        m = 75 + (25 * n[row] * n_docs) // n_terms
        impact = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
        some = impact > 0
        treaps = Treaps(term[some], place[row[some]], impact[some], len(w))
        out = [(i, item_id, *treaps.best(terms, times, k)[:2]) for i, item_id, terms, times in items]
        size = [len(d) for *_, d, _ in out]
        found = np.concatenate([d for *_, d, _ in out]) if out else np.empty(0, np.int64)
        return pa.table({
            "item": pa.array(np.repeat([i for i, *_ in out], size), pa.int32()), "item_id": pa.array([x for (_, x, *_), s in zip(out, size) for _ in range(s)], pa.int64()),
            "doc_id": ids.take(pa.array(order[found])), "score": pa.array(np.concatenate([s for *_, s in out]) if out else found, pa.int64()),
        })

    dealt = rows.where(F.size("terms") > 0).withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int"))
    found = materialize(dealt.groupBy("part").applyInArrow(run, "item int, item_id long, doc_id long, score long"), "search-found")
    discard(rows)
    return found


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """The k documents of the highest score above 0 for each item: item_id, rank (from 1), doc_id, score; equal scores by doc_id, nulls last.

    Each row is a document or an item of its own, also where ids repeat or are null. Null and empty texts have no term: such items find
    nothing, and such documents aren't counted. Empty tables give no rows; other columns aren't read; a very long text is cut
    into terms in pieces.

    Items are searched in blocks of bounded text; what a block's terms are goes to all tasks. One pass over the texts keeps, of each
    document, its length and its postings of those terms. Documents are then dealt by a hash into parts of bounded postings, so a
    frequent term or a hot source is spread over all; each part has its own treaps and sends at most k documents an item."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(query_col).cast("string").alias("text")).where("text is not null")
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    found = []
    for b in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = _search_block(docs, [(r.item_id, r.text.encode()) for r in own.collect()], k, id_col, text_col)
        if rows is not None:
            found.append(rows.withColumn("block", F.lit(b)))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("block", "item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return reduce(DataFrame.unionByName, found).withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def oracle(k: int = TOP) -> str:
    """DuckDB SQL of search over documents and benchmark: every document that shares a term is scored."""
    split = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, {split} AS t FROM documents WHERE text IS NOT NULL), q AS (SELECT row_number() OVER () AS i, item_id, {split} AS t FROM benchmark WHERE text IS NOT NULL),
  qt AS (SELECT i, term, count(*) AS x FROM (SELECT i, unnest(t) AS term FROM q) GROUP BY i, term), n AS (SELECT u, doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0), s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM n),
  p AS (SELECT u, term, count(*) AS tf FROM (SELECT u, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY u, term),
  w AS (SELECT term, CAST(floor(1000::DOUBLE * ln((2::DOUBLE * n_docs + 2) / (2::DOUBLE * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
  r AS (SELECT i, u, CAST(sum(x * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM qt JOIN p USING (term) JOIN w USING (term) JOIN n USING (u), s GROUP BY i, u),
  o AS (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r JOIN n USING (u) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o JOIN q USING (i) WHERE rank <= {k}"""
