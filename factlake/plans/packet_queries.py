"""Queries of what is written about findings: packets, advice, advisories and texts of changes, over facts made from all rows of `part`
and over orders, with the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decide
from ..sources.tables import spread, table
from . import packets, reports, rules
from .audit_queries import _PER_REPO, _REPO
from .candidate_queries import _OF, _WITH, _parsed
from .queries import query

#: Of the two files of each repository every seventh can't be read.
_UNREAD = 7


def _repo() -> F.Column:
    return F.concat(F.lit("r"), F.floor(F.col("p_partkey") / _PER_REPO).cast("string")).alias("repo_id")


def _files(spark, d) -> DataFrame:
    """A file for each path, whose rows follow from the smallest key that it has."""
    path = F.concat(F.lit("f"), (F.col("p_partkey") % 2).cast("string"), F.lit(".rs")).alias("path")
    rows = spread(table(spark, d, "part").select(_repo(), path, "p_partkey"), "repo_id", "path").groupBy("repo_id", "path").agg(F.min("p_partkey").alias("k"))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.col("k") * 7 % 3000 + 1), lambda i: F.concat(F.lit("row "), i.cast("string"), F.repeat(F.lit("x"), (i % 120).cast("int")))), "\n")
    return rows.select("repo_id", "path", F.when(F.col("k") % _UNREAD != 0, text).alias("content"))


_FILES = f"""files AS (SELECT {_REPO}, 'f' || CAST(p_partkey % 2 AS VARCHAR) || '.rs' AS path, CASE WHEN min(p_partkey) % {_UNREAD} <> 0 THEN min(p_partkey) * 7 % 3000 + 1 END AS n_rows FROM part GROUP BY ALL)"""
_SHOWN = "substr(array_to_string(list_transform(range(greatest(0, line - 100), least(n_rows, end_line + 100)), lambda i: CAST(i + 1 AS VARCHAR) || '|row ' || CAST(i + 1 AS VARCHAR) || repeat('x', (i + 1) % 120)), chr(10)), 1, 10000)"
_MAP = """array_to_string(list_transform(fields, lambda f: '  ' || f.name || ': ' || f.type || ' [' || coalesce(nullif(array_to_string(list_transform(f.constraints, lambda x: CASE WHEN coalesce(x.expression, '') = '' THEN x.kind ELSE x.kind || '=' || x.expression END), ', '), ''), 'unconstrained') || ']'), chr(10))"""
_CALLS = "SELECT repo_id, instruction, 'CPI calls:' || chr(10) || string_agg('  ' || call_type || ' → ' || coalesce(nullif(target, ''), '?') || ' (validated: ' || CAST(validated AS VARCHAR) || ')', chr(10) ORDER BY ord) AS t FROM ca GROUP BY ALL"
_SEEDED = "SELECT repo_id, instruction, 'PDA derivations:' || chr(10) || string_agg('  seeds=[' || array_to_string(seeds, ', ') || '] bump=' || bump, chr(10) ORDER BY ord) AS t FROM pd GROUP BY ALL"


@query(f"""{_WITH}, {_FILES}, about AS (SELECT one.*, {_OF.format(x='s.fields', t='one')} AS fields FROM one), calls_ AS ({_CALLS}), seeded AS ({_SEEDED})
SELECT f.repo_id, f.path, f.ord, sha256(CASE WHEN n_rows IS NULL THEN coalesce(nullif(a.body, ''), '[source unavailable]') ELSE {_SHOWN} END) AS excerpt, coalesce({_MAP.replace('fields', 'a.fields')}, '') AS constraint_map,
  CASE WHEN f.line % 3 = 0 THEN 'step ' || CAST(f.line AS VARCHAR) || chr(10) || 'test' ELSE f.sink END AS fix_pattern, concat_ws(chr(10), calls_.t, seeded.t) AS related
FROM sk f LEFT JOIN files USING (repo_id, path) LEFT JOIN about a ON a.repo_id = f.repo_id AND a.instruction = f.instruction LEFT JOIN calls_ ON calls_.repo_id = f.repo_id AND calls_.instruction = f.instruction LEFT JOIN seeded ON seeded.repo_id = f.repo_id AND seeded.instruction = f.instruction""")
def finding_packets(spark, d):
    p = _parsed(spark, d)
    steps = F.when(F.col("line") % 3 == 0, F.array(F.concat(F.lit("step "), F.col("line").cast("string")), F.lit("test")))
    found = p.sinks.select("repo_id", "path", "ord", F.col("sink").alias("vuln_class"), "instruction", "line", "end_line", steps.alias("fix"))
    return packets.packets(found, p, _files(spark, d)).select("repo_id", "path", "ord", F.sha2("excerpt", 256).alias("excerpt"), "constraint_map", "fix_pattern", "related")


_URGENT = {"critical": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM"}


def _advice(generation: int) -> str:
    *said, none = decide.ADVICE[generation]
    return "CASE " + " ".join(f"WHEN {n} > 0 THEN replace('{t}', '%d', CAST({n} AS VARCHAR))" for n, t in zip(_URGENT, said)) + f" ELSE '{none}' END"


@query(f"""SELECT o_custkey, o_orderdate, {_advice(1)} AS first_advice, {_advice(2)} AS second_advice FROM (SELECT o_custkey, o_orderdate, {', '.join(f"count(*) FILTER (WHERE o_orderpriority = '{p}') AS {n}" for n, p in _URGENT.items())} FROM orders GROUP BY o_custkey, o_orderdate)""")
def ship_advice(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey", "o_orderdate").agg(*[F.count_if(F.col("o_orderpriority") == p).alias(n) for n, p in _URGENT.items()])
    counts = [F.col(n) for n in _URGENT]
    return rows.select("o_custkey", "o_orderdate", decide.recommendation(*counts, 1).alias("first_advice"), decide.recommendation(*counts, 2).alias("second_advice"))


# ---- documents: each part is a finding, its class, severity and place follow from its key, size and name --------------------

_LEVELS = ["LOW", "HIGH", "MEDIUM", "CRITICAL", "INFO"]


def _ranked(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    # every third repository has nothing critical or high
    level = F.when(F.floor(k / _PER_REPO) % 3 == 0, F.when(k % 2 == 0, "MEDIUM").otherwise("INFO")).otherwise(F.get(F.array(*map(F.lit, _LEVELS)), (F.col("p_size") % 5).cast("int")))
    return table(spark, d, "part").select(
        _repo(), (k % _PER_REPO).cast("int").alias("rank"), (k % 15 + 1).cast("int").alias("class_id"), F.col("p_brand").alias("class_name"), level.alias("severity"), ((k % 50 + 50) / 100.0).alias("confidence"), F.col("p_name").alias("title"),
        F.concat(F.lit("f"), (k % 4).cast("string"), F.lit(".rs")).alias("path"), (k % 97 + 1).cast("int").alias("line"), F.when(k % 3 != 0, F.col("p_brand")).alias("instruction"), F.when(k % 4 != 0, F.col("p_type")).alias("fix"),
    )


_FOUND = f"""found AS (SELECT {_REPO}, p_partkey % {_PER_REPO} AS rank, p_partkey % 15 + 1 AS class_id, p_brand AS class_name, CASE WHEN p_partkey // {_PER_REPO} % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'MEDIUM' ELSE 'INFO' END ELSE ({_LEVELS})[1 + p_size % 5] END AS severity,
  p_partkey % 50 + 50 AS sure, p_name AS title, '`f' || CAST(p_partkey % 4 AS VARCHAR) || '.rs:' || CAST(p_partkey % 97 + 1 AS VARCHAR) || '`' || CASE WHEN p_partkey % 3 <> 0 THEN ' @ `' || p_brand || '`' ELSE '' END AS place, 'f' || CAST(p_partkey % 4 AS VARCHAR) || '.rs' AS path, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS fix FROM part),
totals AS (SELECT repo_id, count(*) AS total, {', '.join(f"count(*) FILTER (WHERE severity = '{x}') AS {x.lower()}" for x in _LEVELS)} FROM found GROUP BY repo_id)"""


@query(f"""WITH {_FOUND}, numbered AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY rank) AS n FROM found WHERE severity IN ('CRITICAL', 'HIGH')),
listed AS (SELECT repo_id, string_agg(CAST(n AS VARCHAR) || '. **[' || severity || ']** ' || title || ' in ' || place, chr(10) ORDER BY n) AS list FROM numbered GROUP BY repo_id),
paths AS (SELECT repo_id, count(DISTINCT path) AS n, string_agg(DISTINCT '- `' || path || '`', chr(10) ORDER BY '- `' || path || '`') AS list FROM found WHERE fix IS NOT NULL AND severity = 'CRITICAL' GROUP BY repo_id)
SELECT repo_id, 'fix: ' || CAST(critical + high AS VARCHAR) || CASE WHEN critical + high = 1 THEN ' security issue' ELSE ' security issues' END AS title,
  '## Security fixes' || chr(10) || chr(10) || '- critical: ' || CAST(critical AS VARCHAR) || chr(10) || '- high: ' || CAST(high AS VARCHAR) || chr(10) || '- files changed: ' || CAST(coalesce(p.n, 0) AS VARCHAR) || chr(10) || chr(10) || '### Findings' || chr(10) || chr(10) || coalesce(l.list, 'none')
  || chr(10) || chr(10) || '### Files' || chr(10) || chr(10) || coalesce(p.list, 'none') || chr(10) || chr(10) || '### To verify' || chr(10) || chr(10) || 'Read each change, run the repository''s tests, and test that the finding is gone.' || chr(10) AS body
FROM totals LEFT JOIN listed l USING (repo_id) LEFT JOIN paths p USING (repo_id)""")
def change_texts(spark, d):
    found = _ranked(spark, d)
    return reports.change_texts(found, found.where("fix is not null and severity = 'CRITICAL'"))


@query(f"""WITH {_FOUND}, sections AS (SELECT repo_id, string_agg('### ' || CAST(n AS VARCHAR) || '. ' || title || chr(10) || chr(10) || '| field | value |' || chr(10) || '|---|---|' || chr(10) || '| severity | ' || severity || ' |' || chr(10) || '| class | ' || CAST(class_id AS VARCHAR) || ', ' || class_name || ' |' || chr(10)
    || '| place | ' || place || ' |' || chr(10) || '| confidence | ' || CAST(sure AS VARCHAR) || '% |' || coalesce(chr(10) || chr(10) || 'Fix: ' || fix, '') || chr(10), chr(10) ORDER BY n) AS t FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY severity = 'HIGH', rank) AS n FROM found WHERE severity IN ('CRITICAL', 'HIGH')) GROUP BY repo_id),
others AS (SELECT repo_id, string_agg('| ' || CAST(class_id AS VARCHAR) || ' | ' || severity || ' | ' || title || ' | ' || place || ' | ' || CAST(sure AS VARCHAR) || '% |', chr(10) ORDER BY rank) AS t FROM found WHERE severity NOT IN ('CRITICAL', 'HIGH') GROUP BY repo_id),
sizes AS (SELECT repo_id, string_agg('- ' || graph || ': ' || CAST(n_nodes AS VARCHAR) || ' nodes, ' || CAST(n_edges AS VARCHAR) || ' edges', chr(10) ORDER BY graph) AS t FROM (SELECT {_REPO}, p_type AS graph, count(DISTINCT p_brand) AS n_nodes, count(*) AS n_edges FROM part GROUP BY ALL) GROUP BY repo_id),
counted AS (SELECT {_REPO}, max(p_type) AS framework, count(*) AS functions, count(DISTINCT p_brand) AS structs, CAST(sum(p_size) AS BIGINT) AS calls, count(*) FILTER (WHERE p_size > 25) AS addresses FROM part GROUP BY ALL HAVING min(p_size) < 4)
SELECT repo_id, '# Advisory: ' || repo_id || chr(10) || chr(10) || 'Verdict: ' || CASE WHEN critical + high = 0 THEN 'SHIP READY' ELSE 'DO NOT SHIP' END || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || CAST(total AS VARCHAR) || ' finding(s).' || chr(10) || chr(10) || '| severity | count |' || chr(10) || '|---|---|' || chr(10)
  || '| critical | ' || critical || ' |' || chr(10) || '| high | ' || high || ' |' || chr(10) || '| medium | ' || medium || ' |' || chr(10) || '| low | ' || low || ' |' || chr(10) || '| info | ' || info || ' |' || chr(10) || chr(10) || 'Recommendation: ' || {_advice(1)} || chr(10) || chr(10) || '## Findings' || chr(10) || chr(10)
  || coalesce(s.t, 'None is critical or high.' || chr(10)) || coalesce(chr(10) || '## Other findings' || chr(10) || chr(10) || '| class | severity | title | place | confidence |' || chr(10) || '|---|---|---|---|---|' || chr(10) || o.t || chr(10), '') || coalesce(chr(10) || '## Graphs' || chr(10) || chr(10) || z.t || chr(10), '')
  || chr(10) || '## What was read' || chr(10) || chr(10) || 'Framework ' || coalesce(framework, 'unknown') || '; ' || coalesce(functions, 0) || ' functions, ' || coalesce(structs, 0) || ' structs, ' || coalesce(calls, 0) || ' calls, ' || coalesce(addresses, 0) || ' derived addresses.' || chr(10) AS document
FROM totals LEFT JOIN sections s USING (repo_id) LEFT JOIN others o USING (repo_id) LEFT JOIN sizes z USING (repo_id) LEFT JOIN counted USING (repo_id)""")
def advisories(spark, d):
    found, part = _ranked(spark, d), table(spark, d, "part")
    graphs = part.groupBy(_repo(), F.col("p_type").alias("graph")).agg(F.count_distinct("p_brand").alias("n_nodes"), F.count("*").alias("n_edges"))
    counts = part.groupBy(_repo()).agg(F.max("p_type").alias("framework"), F.count("*").alias("functions"), F.count_distinct("p_brand").alias("structs"), F.sum("p_size").alias("calls"), F.count_if(F.col("p_size") > 25).alias("addresses"), F.min("p_size").alias("least")).where("least < 4").drop("least")
    return reports.advisories(found, rules.summary(found), counts, graphs)
