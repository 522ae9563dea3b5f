"""Joins by containment, prefix and span, assignment in rounds, places in a whole table, and neighbourhoods, against brute force."""

import random

from pyspark.sql import functions as F

from factlake.operators import graph, intervals, joins, rank, theta


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contains_against_brute_force(spark):
    r = random.Random(1)
    texts = [(i, "".join(r.choice("abé ") for _ in range(r.choice([0, 3, 40])))) for i in range(120)] + [(200, None), (201, "")]
    items = [(i, "".join(r.choice("abé ") for _ in range(r.choice([1, 2, 3, 5])))) for i in range(60)] + [(70, ""), (71, None), (72, "ab"), (73, "ab")]
    want = sorted((t, i) for t, x in texts for i, y in items if x is not None and y is not None and y in x)
    a, b = spark.createDataFrame(texts, "t long, text string").repartition(3), spark.createDataFrame(items, "i long, item string")
    for part_bytes in (1 << 20, 16):  # one part, and many, of which some are cut again
        found = theta.contains_join(a, b, "t", "text", "i", "item", part_bytes)
        assert sorted(map(tuple, found.collect())) == want
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert theta.contains_join(a, b.limit(0), "t", "text", "i", "item").count() == 0


def test_prefixes_without_nested_loop(spark):
    left = spark.createDataFrame([("TakeAll",), ("Take",), ("Ta",), ("x",), (None,), ("",)], "k string")
    right = spark.createDataFrame([(1, "Take"), (2, "TakeAllOf"), (0, "Tak")], "ord int, name string")
    found = joins.prefix_fallback(left, right, "k", "name", "ord")
    assert {r.k: r.matched_name for r in found.collect()} == {"TakeAll": "Tak", "Take": "Take", "Ta": "Tak", "x": None, None: None, "": "Tak"}
    assert "NestedLoop" not in plan(found)


def test_spans_against_brute_force(spark):
    r = random.Random(2)
    spans = [(g, s, s + r.choice([-1, 0, 1, 7, 300]), n) for n, (g, s) in enumerate((r.choice("ab"), r.randrange(-200, 200)) for _ in range(150))] + [("a", -(1 << 40), 1 << 40, 900), ("b", 5, None, 901)]
    points = [(r.choice("abc"), r.randrange(-300, 300), n) for n in range(200)] + [("a", 3, 0), ("a", None, 1000)]
    a, b = spark.createDataFrame(points, "g string, at long, p int"), spark.createDataFrame(spans, "g string, s long, e long, n int")

    def around(g, at):
        return [x for x in spans if x[0] == g and at is not None and x[2] is not None and x[1] <= at <= x[2]]

    best = [(g, at, p, *(min(around(g, at), key=lambda x: (x[2] - x[1], x[3]))[1:] if around(g, at) else (None,) * 3)) for g, at, p in points]
    found = intervals.smallest_span(a, b, ["g"], "at", "s", "e", ["n"])
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(best, key=repr) and "NestedLoop" not in plan(found)
    pairs = intervals.enclosing(a, b, ["g"], "at", "s", "e").select("p", "at", "n")
    assert sorted(map(tuple, pairs.collect()), key=repr) == sorted(((p, at, x[3]) for g, at, p in points for x in around(g, at)), key=repr)


def test_cells_are_few(spark):
    spans = spark.createDataFrame([(1, 0, (1 << 50) + 12345)], "n int, s long, e long")
    assert intervals.celled(spans, "s", "e").count() <= 2 * 51


def test_assignment_in_rounds_is_the_sequence(spark):
    r = random.Random(3)
    pairs = [(g, e, a, r.choice([0.5, 0.7, 0.7, 0.9])) for g in "xy" for e in range(25) for a in r.sample(range(30), 8)]
    pairs += [("same", e, a, 1.0 - a / 100) for e in range(12) for a in range(12)]  # all want the same partner
    want = set()
    for g in ("x", "y", "same"):
        taken = set()
        for e in range(25):
            free = sorted((-s, a) for h, f, a, s in pairs if (h, f) == (g, e) and s > 0.6 and a not in taken)
            if free:
                taken.add(free[0][1])
                want.add((g, e, free[0][1], -free[0][0]))
    expected = spark.createDataFrame([(g, e) for g in ("x", "y", "same") for e in range(25)], "g string, e_ord int")
    scores = spark.createDataFrame(pairs, "g string, e_ord int, a_ord int, score double")
    for row_pairs in (4096, 20, 0):  # folds alone, rounds and folds, rounds alone
        assert {tuple(x) for x in joins.greedy_match(expected, scores, ["g"], 0.6, row_pairs).collect()} == want


def test_places_in_a_whole_table(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100).alias("v"), "id").repartition(5)  # a third is equal
    found = rank.numbered(rows, [F.col("v").desc(), "id"])
    got = [(x.v, x.id) for x in sorted(found.collect(), key=lambda x: x["rank"])]
    assert got == sorted(got, key=lambda x: (-x[0], x[1])) and sorted(x["rank"] for x in found.collect()) == list(range(1, 3001))
    assert "Window" not in plan(found) and rank.numbered(rows.limit(0), ["id"]).count() == 0


def test_pages_by_key(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (None, "z"), (2, None), (2, "c"), (None, None)], "n int, s string")
    pages, after = [], None
    while page := rank.next_page(rows, ["n", "s"], after, 2).collect():
        pages.append([tuple(x) for x in page])
        after = list(page[-1])
    assert pages == [[(1, "a"), (1, "b")], [(2, "c"), (2, None)], [(None, "z"), (None, None)]]


def test_neighbourhoods(spark):
    edges = spark.createDataFrame([("a", "b", "k"), ("c", "b", "k"), ("c", "d", "k"), ("d", "a", "k"), ("e", "d", "m"), ("a", "b", "m")], "src string, dst string, kind string")
    nodes, inner = graph.neighbourhoods(edges, spark.createDataFrame([("b",), ("e",)], "node string"), 1)
    assert {tuple(x) for x in nodes.collect()} == {("b", "b", 0), ("b", "a", 1), ("b", "c", 1), ("e", "e", 0), ("e", "d", 1)}
    assert {tuple(x) for x in inner.collect()} == {("b", "a", "b", "k"), ("b", "a", "b", "m"), ("b", "c", "b", "k"), ("e", "e", "d", "m")}
