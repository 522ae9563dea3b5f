"""Mixing, ball k-means and ranked search against brute force, and all of them on odd rows; what operators leave in the shared folder."""

import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlake.llm import balls, language, lines, media, mixing, search, simhash
from factlake.llm.queries import oracle_sql, queries
from tests.llm.conftest import same_rows


@pytest.mark.parametrize("name", ("op11_mixing", "op12_balls", "op13_search"))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = queries()[name](spark, folder).toPandas()
    want = con.execute(oracle_sql()[name]).df()[list(got.columns)]
    assert sorted(map(repr, got.astype(object).values.tolist())) == sorted(map(repr, want.astype(object).values.tolist())) and len(got)


# ---- mixing ------------------------------------------------------------------------------------------------


def filled(sizes: dict, share: float, most: float) -> dict:
    """Targets by resharing what is over, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while left > 1e-9 and open_:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        left = 0.0
        for s, more in part.items():
            target[s] += more
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("share", (0.0, 0.4, 1.5, 1.99, 3.0))
def test_targets(spark, share):
    r = random.Random(6)
    sizes = {s: r.choice([0, 1, 10, 500, 3000]) for s in ["b", "a", "é", "Z", "", None, "zz", "c"]}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {x.source: x.target for x in mixing.targets(rows, share=share).collect()}
    assert got == pytest.approx(filled(sizes, share, 2.0)) and all(got[s] <= 2 * n for s, n in sizes.items())


def test_mix_comes_near_its_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 50 as int))").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source"), F.lit(1).alias("copy"))
    plan = mixing.mixing_plan(docs).collect()
    assert plan == mixing.mixing_plan(docs.repartition(7)).orderBy("doc_id").collect() or same_rows(plan, mixing.mixing_plan(docs.repartition(7)).collect())
    assert all(x.taken in (math.floor(x.rate) * x.size, (math.floor(x.rate) + 1) * x.size) and x.taken <= 2 * x.size for x in plan)
    own = {x.doc_id: x for x in plan}
    source = {x.doc_id: x.source for x in docs.collect()}
    taken = Counter()
    for i, x in own.items():
        taken[source[i]] += x.taken
    assert all(abs(taken[source[i]] / x.target - 1) < 0.06 for i, x in own.items())
    mixed = mixing.mix(docs)
    assert mixed.columns == ["doc_id", "text", "source", "copy"]
    assert Counter(x.doc_id for x in mixed.collect()) == Counter({i: x.copies for i, x in own.items() if x.copies})


def test_mixing_of_many_sources_is_dealt_by_source(spark, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), (F.col("id") % 7).cast("string").alias("source"))
    one = mixing.mixing_plan(docs).collect()
    monkeypatch.setattr(mixing, "SENT_ROWS", 1)
    assert same_rows(one, mixing.mixing_plan(docs).collect())


# ---- ball k-means ------------------------------------------------------------------------------------------


def lloyd(x: np.ndarray, ids: list, k: int, rounds: int):
    order = sorted((i for i, v in enumerate(ids) if v is not None), key=lambda i: (hashlib.sha256(f"2:{ids[i]}".encode()).hexdigest(), x[i].astype("<i4").tobytes()))
    c = x[order[:k]].copy()
    for r in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        if r < rounds:
            c = np.stack([np.array([int(v) // int((own == j).sum()) for v in x[own == j].sum(axis=0)]) if (own == j).any() else c[j] for j in range(len(c))])
    return own, d.min(axis=1), c


@pytest.mark.parametrize("spread", (0.01, 0.3, 100.0, 3e4))
def test_balls_are_lloyd(spark, spread):
    r = np.random.default_rng(7)
    centers = r.normal(size=(6, 5))
    v = np.concatenate([centers[r.integers(0, 6, 400)] + r.normal(size=(400, 5)) * spread, np.zeros((30, 5)), np.ones((30, 5)) / 256])  # ties and copies
    rows = spark.createDataFrame([(i if i % 50 else None, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    got = {tuple(np.frombuffer(x.vec, "<i4")) + (x.vec_id,): (x.cluster, x.distance) for x in balls.cluster(rows, k=12, dim=5)[0].collect()}
    q = np.floor(v * 256.0).astype(np.int64)
    own, dist, _ = lloyd(q, [i if i % 50 else None for i in range(len(v))], 12, 5)
    assert all(got[tuple(q[i]) + (i,)] == (own[i], dist[i]) for i in range(len(v)) if i % 50)


def test_few_neighbours_are_compared():
    r = np.random.default_rng(8)
    c = (r.normal(size=(40, 8)) * 5000).astype(np.int64)
    x = c[r.integers(0, 40, 4000)] + r.integers(-50, 50, (4000, 8))
    own, dist = balls.nearest(x, c)
    far = [int(dist[own == j].max()) if (own == j).any() else 0 for j in range(40)]
    best, d, took = balls.Balls(c, c, far).assign(x, own)
    assert np.array_equal(best, own) and np.array_equal(d, dist) and took < 1.1 * len(x)  # forty times fewer than all


def test_odd_vectors(spark):
    rows = [(1, [0.5] * 64), (1, [0.5] * 64), (2, None), (3, [0.1] * 63), (4, [float("nan")] * 64), (5, [None] + [0.1] * 63), (6, [float("inf")] + [0.0] * 63), (None, [1.0] * 64), (7, [1e30] * 64)]
    frame = spark.createDataFrame([(*r, 0, 1) for r in rows], "vec_id long, embedding array<double>, cluster int, label int")
    got = balls.cluster_vectors(frame).collect()
    assert sorted((x.vec_id or 0) for x in got) == [0, 1, 1, 7] and {x.distance for x in got if x.vec_id} == {0}
    assert balls.cluster_vectors(frame.limit(0)).collect() == [] and balls.cluster_vectors(frame.where("vec_id = 2")).collect() == []


# ---- ranked search -----------------------------------------------------------------------------------------


def ranked(docs, items, k=20):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(i, Counter(split(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in own if c), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in own:
            m = 75 + (25 * c.total() * n_docs) // total if total else 0
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, x in Counter(split(text)).items() if c[t])
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


@pytest.mark.parametrize("leaf,part", ((1, 1 << 18), (16, 200), (1024, 1 << 18)))
def test_search_against_brute_force(spark, monkeypatch, leaf, part):
    monkeypatch.setattr(search, "PART_POSTINGS", part)
    monkeypatch.setattr(search.Treaps.best, "__defaults__", (leaf,))
    r = random.Random(9)
    words = ["The", "the", "alpha", "β", "x1", "naïve", "日本", "rare", "Beta", "a"]
    docs = [(i, " ".join(r.choices(words, [30, 20, 5, 3, 3, 2, 1, 1, 9, 40], k=r.choice([0, 1, 5, 40])))) for i in range(400)]
    docs += [(400, None), (401, "---"), (None, "rare rare β"), (402, "rare"), (402, "rare"), (403, "the " * 3000 + "rare")]
    items = [(1, "the RARE, alpha; rare"), (2, "β x1"), (3, ""), (4, None), (5, "none-of-these"), (1, "日本 naïve"), (None, "a the beta")]
    a, b = spark.createDataFrame([(*d, 1, "q") for d in docs], "doc_id long, text string, rank int, term string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    got = search.search(a, b).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(ranked(docs, items), key=repr)


def test_blocks_of_items(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} z") for i in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"w{i} z") for i in range(9)], "item_id long, text string")
    one = search.search(docs, items).collect()
    monkeypatch.setattr(search, "BLOCK_BYTES", 8)
    assert same_rows(one, search.search(docs, items).collect()) and len(one) > 50


def test_treaps_cut_off():
    """Subtrees that can't enter the first k aren't looked at."""
    r = np.random.default_rng(10)
    n = 20_000
    term, doc = np.repeat([0, 1], n), np.tile(np.arange(n), 2)
    impact = r.integers(1, 100, 2 * n)
    impact[[5, n + 5]] = 10_000
    t = search.Treaps(term, doc, impact, 2)
    docs, scores, looked = t.best(np.array([0, 1]), np.array([1, 2]), 1, 16)
    assert docs.tolist() == [5] and scores.tolist() == [30_000] and looked <= 4
    assert all(impact[k] >= impact[c] for k in range(2 * n) for c in (t.left[k], t.right[k]) if c >= 0 for impact in (t.impact,))


def test_treap_of_equal_impacts_is_shallow():
    t = search.Treaps(np.zeros(5000, np.int64), np.arange(5000), np.ones(5000, np.int64), 1)
    depth, level = 0, [int(t.root[0])]
    while level:
        level = [int(c) for k in level for c in (t.left[k], t.right[k]) if c >= 0]
        depth += 1
    assert depth < 60


# ---- odd rows, and what is left ----------------------------------------------------------------------------


def test_odd_rows(odd_docs, empty_docs):
    plan = mixing.mixing_plan(odd_docs).collect()
    assert len(plan) == odd_docs.count() and {x.size for x in plan if x.doc_id in (3, 4, 5)} == {0}
    assert mixing.mixing_plan(empty_docs).count() == 0 and mixing.mix(empty_docs).count() == 0
    items = odd_docs.select(F.col("doc_id").alias("item_id"), "text")
    assert search.search(odd_docs, items).where("rank = 1").count() > 5
    assert search.search(empty_docs, items).count() == 0 and search.search(odd_docs, items.limit(0)).count() == 0


def test_clashing_names(spark):
    line = "a line that is long enough to take part in it"
    docs = spark.createDataFrame([(1, line, 7, {"k": 1}, "x", 1), (2, line + "!", 8, {"k": 2}, "y", 2), (1, line, 7, {"k": 1}, "x", 1)], "doc_id long, text string, `__near` int, `__id` map<string,int>, `__h` string, `lines` int")
    assert lines.drop_lines(docs).select("doc_id", "__id", "__h", "lines", "__dropped").count() == 3
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and [x.doc_id for x in kept.collect()] == [1, 2] or kept.count() in (1, 2)


def test_what_is_left(odd_docs, tmp_path, monkeypatch):
    """Of the tables that op6 and op10 write on the way only those that the result reads are left."""
    monkeypatch.setattr("factlake.llm.common.shared_dir", lambda spark: f"file://{tmp_path}")
    lines.line_dedup(odd_docs).collect()
    assert [x.split("-")[:2] for x in os.listdir(tmp_path)] == [["lines", "lost"]]
    simhash.near_duplicates(odd_docs).collect()
    assert sorted(x.rsplit("-", 1)[0] for x in os.listdir(tmp_path)) == ["lines-lost", "simhash-fps", "simhash-named"]


@pytest.mark.parametrize("part", ("64MB", "1m", "134217728b"))
def test_media_reads_sparks_sizes(spark, odd_docs, tmp_path, monkeypatch, part):
    monkeypatch.setattr(media, "HOT_ROWS", 1)  # every repeated text is hot
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", part)
    try:
        (tmp_path / "m").mkdir()
        rows = media.media_columns(odd_docs, f"file://{tmp_path}/m").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = sorted((x.doc_id or -1, len((x.text or "").encode())) for x in odd_docs.collect())
    assert sorted((x.doc_id or -1, x.n_bytes) for x in rows) == want


def test_letters_and_many_languages(spark):
    """Numbers that aren't decimal are no letters; of a thousand stray languages only so many are learned."""
    assert [language.has_letter(x) for x in ("½ ²", "12 _", "", "é", "日", "x²", "ª")] == [False, False, False, True, True, True, True]
    rows = [(i, f"text number {i} of this language", "en" if i % 2 else "de") for i in range(400)] + [(1000 + i, "stray text", f"l{i}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.sample(docs, F.lit(True), 16, 5)[1]
    assert set(got) >= {"en", "de"} and len(set(got)) <= 5
