"""What grows with the input: tasks with rows, scans and joins that don't repeat, and results that stay as they are."""

import pytest
from pyspark.sql import functions as F

from factlake.operators import intervals, joins, syntax, theta
from factlake.plans import fact_queries, packet_queries, queries
from factlake.sources.tables import spread


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Many parts in one file of one row group."""
    folder = str(tmp_path_factory.mktemp("parts"))
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    rows = spark.range(12_000).select(F.col("id").alias("p_partkey"), *[F.lit(part.first()[c]).alias(c) for c in part.columns if c != "p_partkey"])
    rows.coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


def test_spread_follows_rows(spark):
    rows = spark.range(1000).select((F.col("id") % 90).alias("k")).coalesce(1)
    dealt = spread(rows, "k", rows=100)
    assert dealt.rdd.getNumPartitions() == 10 and dealt.count() == 1000 and spread(rows.limit(0), "k").count() == 0
    assert dealt.select("k", F.spark_partition_id().alias("p")).distinct().count() == 90  # a key's rows stay together


def test_sources_of_one_file_are_parsed_in_many_tasks(spark, parts):
    """F4 to F7, F9 to F11: the scanner ran in the tasks that read part, one for a small file."""
    assert fact_queries._scan(spark, parts).rdd.getNumPartitions() == -(-12_000 // 2048)


def test_sources_are_parsed_once_for_dispatch(spark, parts):
    """each use of the functions parsed all sources again."""
    assert "MapInPandas" not in plan(fact_queries.facts_x28_dispatch(spark, parts))


def test_sources_are_parsed_once_for_derivations(spark, parts):
    """so did each form of an address."""
    assert "MapInPandas" not in plan(fact_queries.facts_x25_x26_derivations(spark, parts))


def test_parts_that_are_not_asked_are_empty(spark):
    files = spark.createDataFrame([("r", "lib.rs", fact_queries._PARSED)], "repo_id string, path string, content string")
    whole = syntax.parse(files).first()
    for part in syntax.PARTS:
        got = syntax.parse(files, part).first()
        assert all(got[x] == (whole[x] if x == part else []) for x in syntax.PARTS) and whole[part]
        assert (got.digest, got.framework, got.n_lines) == (whole.digest, whole.framework, whole.n_lines)
    with pytest.raises(ValueError):
        syntax.parse(files, "bodies")


def test_a_text_of_both_derivations_has_two_rows(spark):
    source = 'pub fn f() { g(Pubkey::find_program_address(&[b"a"], id), Pubkey::create_program_address(&[b"b"], id)); }'
    parsed = syntax.parse(spark.createDataFrame([("r", "lib.rs", source)], "repo_id string, path string, content string"))
    got = syntax.derivations(parsed).select("bump").collect()
    assert sorted(x.bump for x in got) == ["canonical", "canonical", "unchecked", "unchecked"]


def test_packets_broadcast_nothing(spark, parts):
    """texts of files, which the planner takes for small, were broadcast."""
    found = plan(packet_queries.finding_packets(spark, parts))
    assert "BroadcastHashJoin" not in found and "ShuffledHashJoin" in found and "SortMergeJoin" in found


def test_short_items_are_counted_before_they_meet_suppliers(spark, monkeypatch):
    """an item that a quarter of the suppliers share met every text once for each of them."""
    asked = []
    real = theta.contains_join

    def seen(texts, items, *names, **kw):
        asked.append(items)
        return real(texts, items, *names, **kw)

    monkeypatch.setattr(theta, "contains_join", seen)
    n = queries.substring_short(spark, "/root/testdata/sf0.001").count()
    assert len(asked) == 1 and asked[0].count() == asked[0].select("item").distinct().count() < n


def test_counts_around_make_no_pairs(spark):
    """F8: each point met each span around it, only to be counted."""
    spans = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") % 7).alias("s"), (F.col("id") % 7 + F.col("id") % 5 * 9 - 1).alias("e"))
    points = spark.range(900).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 100 != 0, F.col("id") % 50 - 5).alias("at"), "id")
    got = {r.id: r.n for r in intervals.count_around(points, spans, ["g"], "at", "s", "e").collect()}
    all_ = [tuple(r) for r in spans.collect()]
    assert got == {r.id: sum(g == r.g and r["at"] is not None and s <= r["at"] <= e for g, s, e in all_) for r in points.collect()}
    found = queries.spans_around(spark, "/root/testdata/sf0.001")
    assert plan(found).count("partial_count") == 1 and "partial_sum" in plan(found)  # counts of spans, then sums of counts


def test_equal_spans_are_one_before_they_are_cut(spark):
    """each span was cut into its cells, and all cells sorted; here 3,000 spans have 35 pairs of ends."""
    spans = spark.range(3000).select((F.col("id") % 7).alias("s"), (F.col("id") % 7 + F.col("id") % 5 * 9).alias("e"), F.col("id").alias("n"), F.lit(1).alias("g"))
    points = spark.createDataFrame([(1, 3), (1, 90)], "g int, at long")
    cut = []
    real, intervals.celled = intervals.celled, lambda x, s, e: (cut.append(x.count()), real(x, s, e))[1]
    try:
        got = sorted(map(tuple, intervals.smallest_span(points, spans, ["g"], "at", "s", "e", ["n"]).collect()))
    finally:
        intervals.celled = real
    assert cut == [35] and got == [(1, 3, 3, 3, 10), (1, 90, None, None, None)]


def test_cells_are_made_up_to_the_span_alone(spark):
    """places at both ends of the range, and cells that cover a span exactly."""
    spans = spark.createDataFrame([(0, -5, 9), (1, 7, 7), (2, 3, 2), (3, None, 4), (4, 0, (1 << 50) - 1)], "n int, s long, e long")
    cells = intervals.celled(spans, "s", "e").select("n", "__level", "__cell").collect()
    assert sorted(x for c in cells if c.n == 0 for x in range(c["__cell"] << c["__level"], (c["__cell"] + 1) << c["__level"])) == list(range(-5, 10))
    assert [(c["__level"], c["__cell"]) for c in cells if c.n in (1, 4)] == [(0, 7), (50, 0)] and {c.n for c in cells} == {0, 1, 4}


def test_overlaps_are_dealt_by_rows(spark, monkeypatch):
    """the shuffle setting decided how many rows a task held."""
    monkeypatch.setattr(queries, "_TASK_ROWS", 500)
    found = queries.overlap_semi(spark, "/root/testdata/sf0.001")
    n = -(-spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 500)
    assert found.rdd.getNumPartitions() == n and "ENSURE_REQUIREMENTS" not in plan(found)


def test_overlaps_are_of_all_orders(spark):
    """F2 of round 4: only orders divisible by ten were asked for."""
    got = {r.l_orderkey: r.n_others for r in queries.overlap_semi(spark, "/root/testdata/sf0.001").collect()}
    orders, parts = {}, {}
    for o, p in spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        orders.setdefault(o, set()).add(p)
        parts.setdefault(p, set()).add(o)
    wanted = {o: len(set().union(*(parts[p] for p in held)) - {o}) for o, held in orders.items()}
    assert got == {o: n for o, n in wanted.items() if n} and any(o % 10 for o in got)


@pytest.mark.parametrize("few", [1, 2, 5, 32])
def test_overlaps_of_keys_of_any_size(spark, few):
    """Nulls, repeated rows, equal keys, keys of more items than make pairs, and keys that share nothing."""
    held = {**{f"k{k}": {x for x in range(40) if (x * 7 + k * k) % (k % 9 + 2) == 0} for k in range(30)}, "one": {0}, "alone": {99}, "pair": {98, 97}, "same": {98, 97}, "all": set(range(100)), "none": set()}
    rows = [(k, x) for k, items in held.items() for x in [*items, *list(items)[:3]]] + [("null", None), ("none", None), (None, 5), (None, None)]
    found = joins.overlap_counts(spark.createDataFrame(rows, "k string, x int"), "k", "x", 3, few)
    wanted = {a: n for a in held if (n := sum(b != a and bool(held[a] & held[b]) for b in held))}
    assert {tuple(r) for r in found.collect()} == set(wanted.items()) and found.columns == ["k", "n_others"] and "BroadcastHashJoin" not in plan(found)


def test_lines_and_functions_are_dealt_by_files(spark, parts):
    """F14 to F19: windows and joins over texts ran in as many partitions as the shuffle setting, whatever the number of files."""
    dealt = f"{-(-12_000 // 2048)}), REPARTITION_BY_NUM"
    found = plan(fact_queries.facts_x12_derivations(spark, parts))
    assert dealt in found and "ENSURE_REQUIREMENTS" not in found
    found = plan(fact_queries.facts_x01_x04_functions(spark, parts))
    assert any("repo_id" in x and dealt in x for x in found.split("\n"))


def test_files_are_read_whole_and_parts_not_handed_over(spark, parts):
    """all that was found in the sources was made into columns, and dropped after that."""
    assert "instructions" not in plan(fact_queries.facts_s08_s09_files(spark, parts))
    names = "repo_id string, path string, content "
    good = spark.createDataFrame([("r", "a.rs", fact_queries._PARSED), ("r", "b.rs", None), ("r", "c.rs", "fn open( {")], names + "string")
    odd = spark.createDataFrame([("r", "d.rs", bytearray(b"fn f() {}"))], names + "binary")  # bytes are no text: its error
    for files in (good, odd):
        whole, got = syntax.parse(files).drop(*syntax.PARTS), syntax.read_files(files)
        assert got.schema == whole.schema and sorted(got.collect()) == sorted(whole.collect())
    assert syntax.read_files(odd).first().error and syntax.read_files(good).where("error is not null").isEmpty()
