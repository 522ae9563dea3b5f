"""Queries of repositories, rollups, plans and patches over the driver's tables, with the SQL that each must equal."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import repair_loosely
from ..operators import repos
from ..sources.tables import table
from . import audit_queries as audit
from . import reports, rollups, rules
from .audit_queries import _listed
from .queries import query

c = F.col
_AS_OF = date(1998, 9, 1)
_TOPICS = [[], ["solana", "nft"], ["games"], ["defi", "anchor-lang", "DEX"], ["dao-tools"]]
_KNOWN = [("owner1", "pool", "lending", "high", 0), ("owner3", "swap", "exchange", "medium", 1), ("owner9", "name7", "staking", "low", 2), ("owner1", "name4", "exchange", "low", 3)]
_REPOS = f"""(SELECT c_custkey AS id, 'owner' || c_custkey % 11 AS owner, 'name' || c_custkey % 13 AS name, CAST(c_custkey * 37 % 1500 AS BIGINT) AS stars, c_custkey % 150 AS forks, ({_listed(_TOPICS)}::VARCHAR[][])[1 + c_custkey % 5] AS topics, CASE c_custkey % 4 WHEN 0 THEN 'An Anchor program' WHEN 1 THEN 'tools' WHEN 2 THEN NULL ELSE 'for SOLANA' END AS description, last AS updated
  FROM customer JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)"""


def _repos(spark, d) -> DataFrame:
    k = c("c_custkey")
    last = table(spark, d, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("updated"))
    topics = F.get(F.array(*(F.array(*map(F.lit, t)).cast("array<string>") for t in _TOPICS)), (k % 5).cast("int"))
    told = F.when(k % 4 == 0, "An Anchor program").when(k % 4 == 1, "tools").when(k % 4 == 3, "for SOLANA")
    return table(spark, d, "customer").join(last, "c_custkey").select(k.alias("id"), F.concat(F.lit("owner"), (k % 11).cast("string")).alias("owner"), F.concat(F.lit("name"), (k % 13).cast("string")).alias("name"), (k * 37 % 1500).cast("long").alias("stars"), (k % 150).alias("forks"), topics.alias("topics"), told.alias("description"), "updated")


_TOLD = "(len(list_filter(topics, lambda t: contains(t, 'solana') OR contains(t, 'anchor'))) > 0 OR contains(lower(description), 'solana') OR contains(lower(description), 'anchor'))"


@query(f"SELECT id, stars FROM {_REPOS} WHERE stars >= 10 AND coalesce({_TOLD}, false)")
def repos_auditable(spark, d):
    return repos.auditable(_repos(spark, d)).select("id", "stars")


_OWN = " OR ".join(f"contains(lower(t), '{w}')" for w in repos.TOPICS)
_SCORED = f"""(SELECT *, CASE WHEN stars >= 1000 THEN 40 WHEN stars >= 500 THEN 30 WHEN stars >= 100 THEN 20 WHEN stars >= 50 THEN 10 ELSE 0 END + CASE WHEN category IS NULL THEN 0 WHEN value = 'high' THEN 25 WHEN value = 'medium' THEN 15 ELSE 5 END + CASE WHEN age < 30 THEN 15 WHEN age < 90 THEN 10 WHEN age < 365 THEN 5 ELSE 0 END + CASE WHEN forks >= 100 THEN 10 WHEN forks >= 50 THEN 5 ELSE 0 END + 3 * len(own) AS score,
  concat_ws('; ', CASE WHEN stars >= 1000 THEN '1K+ stars' WHEN stars >= 500 THEN '500+ stars' WHEN stars >= 100 THEN '100+ stars' WHEN stars >= 50 THEN '50+ stars' END, CASE WHEN category IS NOT NULL THEN 'known ' || category || ' protocol (' || value || ' TVL)' END, CASE WHEN age < 30 THEN 'updated <30 days' WHEN age < 90 THEN 'updated <90 days' END, CASE WHEN forks >= 100 THEN '100+ forks' END, CASE WHEN len(own) > 0 THEN 'topics: ' || array_to_string(own, ', ') END) AS reason
  FROM (SELECT *, known.c AS category, known.v AS value FROM (SELECT r.*, list_filter(topics, lambda t: {_OWN}) AS own, date_diff('day', updated::DATE, DATE '{_AS_OF}') AS age, (SELECT arg_min(struct_pack(c := k.category, v := k.value), k.ord) FROM (VALUES {', '.join(map(str, _KNOWN))}) k(owner, repo, category, value, ord) WHERE k.owner = r.owner OR k.repo = r.name) AS known FROM {_REPOS} r)))"""


def _scored(spark, d) -> DataFrame:
    known = spark.createDataFrame(_KNOWN, "owner string, repo string, category string, value string, ord int")
    return repos.scored(_repos(spark, d), known, _AS_OF)


@query(f"SELECT id, CAST(score AS BIGINT) AS score, reason FROM {_SCORED}")
def repos_scored(spark, d):
    return _scored(spark, d).select("id", "score", "reason")


@query(f"SELECT id, CAST(score AS BIGINT) AS score FROM {_SCORED} ORDER BY score DESC, id LIMIT 5")
def repos_best(spark, d):
    return repos.best(_scored(spark, d), "id").select("id", "score")


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' AND (contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') OR contains(lower(p_brand), 'ring')) UNION ALL SELECT p_partkey FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_type), 'a') OR contains(lower(p_brand), 'a')")
def searched_rows(spark, d):
    rows = table(spark, d, "part").select("p_partkey", c("p_name").alias("name"), c("p_type").alias("description"), c("p_brand").alias("category"))
    return repos.searched(rows, "Ring", "Brand#11").unionByName(repos.searched(rows, "A")).select("p_partkey")


# ---- rollups -----------------------------------------------------------------------------------------------


@query("SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts, coalesce(sum(n) FILTER (WHERE event_type = 'error'), 0)::BIGINT AS errors FROM (SELECT user_id, coalesce(event_type, 'UNKNOWN') AS event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def counts_map(spark, d):
    rows = rollups.counts_map(table(spark, d, "events"), ["user_id"], "event_type")
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return rows.select("user_id", shown.alias("counts"), rollups.get("counts", "error").alias("errors"))


@query("SELECT count(*) AS total_runs, sum(l_linenumber)::BIGINT AS total_findings, sum(l_quantity)::BIGINT AS total_enriched, sum(l_linenumber % 3)::BIGINT AS total_patches, sum(l_linenumber % 2)::BIGINT AS total_proofs, count(*) FILTER (WHERE l_linenumber = 1) AS total_requests FROM lineitem")
def run_totals(spark, d):
    n = c("l_linenumber")
    runs = table(spark, d, "lineitem").select(n.alias("n_findings"), c("l_quantity").cast("long").alias("n_enriched"), (n % 3).alias("n_patches"), (n % 2).alias("n_proofs"), F.when(n == 1, "url").alias("request_url"))
    return rollups.run_totals(runs).select(*[F.col(x).cast("long").alias(x) for x in ("total_runs", "total_findings", "total_enriched", "total_patches", "total_proofs", "total_requests")])


@query("SELECT (SELECT count(*) FROM orders) AS total, count(*) AS attempted, count(*) FILTER (WHERE o_orderstatus = 'F') AS validated, count(*) FILTER (WHERE o_orderstatus = 'P') AS needs_human, count(*) FILTER (WHERE o_orderstatus = 'O') AS failed, (SELECT count(*) FROM orders) - count(*) AS skipped FROM orders WHERE o_orderpriority <> '5-LOW'")
def patch_metrics(spark, d):
    s, orders = c("o_orderstatus"), table(spark, d, "orders")
    tried = orders.where("o_orderpriority <> '5-LOW'").select(F.when(s == "F", "validated").when(s == "P", "needs_human").when(s == "O", "failed").alias("status"))
    return rollups.patch_metrics(orders, tried)


@query("SELECT event_type, coalesce(round(avg(value)), 0)::BIGINT AS mean_latency FROM events GROUP BY event_type")
def mean_latency(spark, d):
    return rollups.mean_latency(table(spark, d, "events"), "value", "event_type")


@query("SELECT o_orderkey, o_orderstatus = 'F' AS ready, CASE WHEN o_orderstatus <> 'F' THEN 'job is ' || CASE o_orderstatus WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END || ', it must be SUCCEEDED' END AS error FROM orders")
def ready_jobs(spark, d):
    s = c("o_orderstatus")
    return rollups.ready(table(spark, d, "orders").select("o_orderkey", F.when(s == "F", "SUCCEEDED").when(s == "O", "RUNNING").otherwise("FAILED").alias("status"))).select("o_orderkey", "ready", "error")


@query("SELECT count(*)::BIGINT AS total_expected FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '2-HIGH'")
def total_expected(spark, d):
    items = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_partkey").alias("expected"))
    suite = table(spark, d, "orders").select("o_orderkey", c("o_orderpriority").alias("difficulty")).join(items, "o_orderkey", "left")
    return rollups.total_expected(rollups.of_difficulty(suite, "2-HIGH"))


# ---- plans and documents -----------------------------------------------------------------------------------

_FIXED = f"({' UNION ALL '.join(f'SELECT *, {n} AS class_id FROM ({sql})' for n, sql in sorted(audit._RULE_SQL.items()))})"
_FIXES = ", ".join(f"({n}, {'NULL' if f is None else repr(f)}, {audit._text(t)})" for n, f, t in reports.FIXES)
_PLANS = ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else audit._text(x) for x in row) + ")" for row in rollups.PLANS)


def _findings(spark, d) -> tuple[DataFrame, rules.Facts]:
    f = audit._facts(spark, d)
    return rules.detect(f), f


@query(f"""{audit._WITH}, x(class_id, framework, fix) AS (VALUES {_FIXES}) SELECT repo_id, class_id, coalesce(s.fix, g.fix) AS fix, count(*) AS n FROM {_FIXED} LEFT JOIN kinds USING (repo_id) LEFT JOIN (SELECT * FROM x WHERE framework IS NOT NULL) s USING (class_id, framework) LEFT JOIN (SELECT class_id, fix FROM x WHERE framework IS NULL) g USING (class_id) GROUP BY ALL""")
def plans_of_fixes(spark, d):
    found, f = _findings(spark, d)
    return reports.with_fixes(found, f.kinds).groupBy("repo_id", F.col("class_id").cast("int").alias("class_id"), "fix").agg(F.count("*").alias("n"))


@query(f"""{audit._WITH}, x(class_id, steps, delta, impact, exploitability) AS (VALUES {_PLANS}) SELECT class_id, steps, delta, impact, exploitability, count(*) AS n FROM {_FIXED} JOIN x USING (class_id) GROUP BY ALL""")
def plans_of_proofs(spark, d):
    found, _ = _findings(spark, d)
    return rollups.with_plans(found).groupBy(F.col("class_id").cast("int").alias("class_id"), "steps", "delta", "impact", "exploitability").agg(F.count("*").alias("n"))


@query(f"""{audit._WITH}, used AS (SELECT DISTINCT repo_id, name AS instruction, a.name AS account, a.is_mut FROM {audit._EACH}) SELECT u.repo_id, u.instruction, string_agg(DISTINCT u.account, ',' ORDER BY u.account) AS mutable, (SELECT string_agg(DISTINCT o.instruction, ',' ORDER BY o.instruction) FROM used o JOIN used m ON m.repo_id = o.repo_id AND m.account = o.account AND m.is_mut WHERE m.repo_id = u.repo_id AND m.instruction = u.instruction AND o.instruction <> u.instruction) AS shared_with FROM used u WHERE u.is_mut GROUP BY u.repo_id, u.instruction""")
def blast_radius(spark, d):
    f = audit._facts(spark, d)
    own = f.instructions.where(F.exists("accounts", lambda a: a["is_mut"])).select("repo_id", c("name").alias("instruction")).distinct()
    return reports.blast_radius(own, f.instructions).select("repo_id", "instruction", F.array_join("mutable", ",").alias("mutable"), F.array_join("shared_with", ",").alias("shared_with"))


@query("""SELECT event_id, props::JSON->>'$.k' AS title FROM events""")
def json_repair_loosely(spark, d):
    broken = table(spark, d, "events").select("event_id", F.concat(F.lit('note {"title": "'), F.get_json_object("props", "$.k"), F.lit('", "impact": [1, {"x')).alias("reply"))
    return broken.select("event_id", F.get_json_object(repair_loosely("reply"), "$.title").alias("title"))
