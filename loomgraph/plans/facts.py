"""Code facts derived from the driver's tables, by the same SQL text in both engines.

Parts are functions, consecutive parts of an order are calls, and the same on suppliers gives module calls.
{part}, {lineitem} and {supplier} stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PATH = "'m' || CAST(p_size % 7 AS STRING) || '/' || lower(replace(p_brand, '#', '')) || '/f' || CAST(p_partkey AS STRING) || '.py'"
_GROUP = "'m' || CAST(p_size % 7 AS STRING) || '/' || lower(replace(p_brand, '#', ''))"
_LABEL = "CASE WHEN p_partkey % 97 = 0 THEN 'main' WHEN p_partkey % 89 = 0 THEN 'handle_' || replace(p_name, ' ', '_') WHEN p_partkey % 13 = 0 THEN 'get_' || replace(p_name, ' ', '_') WHEN p_partkey % 11 = 0 THEN 'check_' || replace(p_name, ' ', '_') ELSE replace(p_name, ' ', '_') END"

NODES = f"""
SELECT {_PATH} || '::' || {_LABEL} AS node_id, {_PATH} AS file, CAST(p_partkey % 400 + 1 AS BIGINT) AS line_start,
       CAST(p_partkey % 400 + 1 + p_size AS BIGINT) AS line_end, {_GROUP} AS module_group,
       CASE WHEN p_partkey % 10 = 0 THEN 'class' WHEN p_partkey % 3 = 0 THEN 'method' ELSE 'function' END AS node_type,
       {_LABEL} AS label, p_partkey AS ord
FROM {{part}}"""

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
#: Pairs of parts that follow each other in an order.
STEPS = f"""
SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS b, l_orderkey AS ord FROM {{lineitem}}"""
#: How often each part follows another.
COUNTED = f"SELECT a, b, count(*) AS call_count FROM ({STEPS}) s WHERE b IS NOT NULL GROUP BY a, b"
CALLS = f"""
SELECT s.node_id AS src, d.node_id AS dst, d.label AS callee_name, c.ord AS ord
FROM ({STEPS}) c JOIN ({NODES}) s ON c.a = s.ord JOIN ({NODES}) d ON c.b = d.ord"""
#: All steps as weighted calls, cycles included: each step calls as often as its item has units.
WEIGHTED = f"""
SELECT s.node_id AS src, d.node_id AS dst, CAST(sum(q) AS BIGINT) AS call_count
FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS b, CAST(l_quantity AS BIGINT) AS q FROM {{lineitem}}) c
JOIN ({NODES}) s ON c.a = s.ord JOIN ({NODES}) d ON c.b = d.ord WHERE c.a <> c.b GROUP BY s.node_id, d.node_id"""
#: The same between numbered nodes: {numbers} (number, ord).
NUMBERED = WEIGHTED.replace(f"({NODES})", "{numbers}").replace("node_id", "number")
#: How often each numbered node calls another one, in steps; cycles included.
NUMBERED_COUNTS = f"""
SELECT s.number AS src, d.number AS dst, call_count
FROM ({COUNTED}) c JOIN {{numbers}} s ON c.a = s.ord JOIN {{numbers}} d ON c.b = d.ord WHERE c.a <> c.b"""
#: A graph without cycles and with few ways on from each node, for enumerations of paths only, which are exponential:
#: of all forward steps from a part, those to its nearest and its farthest follower.
SPARSE = f"""
SELECT a, b, ord FROM (
  SELECT a, b, ord, min(b) OVER (PARTITION BY a) AS nearest, max(b) OVER (PARTITION BY a) AS farthest FROM ({STEPS}) x WHERE a < b) y
WHERE b = nearest OR b = farthest"""
SPARSE_CALLS = f"""
SELECT s.node_id AS src, d.node_id AS dst, d.label AS callee_name, c.ord AS ord
FROM ({SPARSE}) c JOIN ({NODES}) s ON c.a = s.ord JOIN ({NODES}) d ON c.b = d.ord"""

_MODULE = "'s' || CAST(s_suppkey % 6 AS STRING) || '/sup' || CAST(s_suppkey AS STRING)"
MODULES = f"SELECT {_MODULE} AS name, s_suppkey AS ord FROM {{supplier}}"
MODULE_EDGES = f"""
SELECT src, dst, CAST(count(*) AS BIGINT) AS call_count FROM (
  SELECT s.name AS src, d.name AS dst
  FROM (SELECT l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS b FROM {{lineitem}}) c
  JOIN ({MODULES}) s ON c.a = s.ord JOIN ({MODULES}) d ON c.b = d.ord WHERE c.a <> c.b) x GROUP BY src, dst"""


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem", "supplier")}


def facts(spark: SparkSession, sf_dir: str, text: str, **more: DataFrame) -> DataFrame:
    known = tables(spark, sf_dir) | more
    return spark.sql(text, **{k: v for k, v in known.items() if "{" + k + "}" in text})


def for_sql(text: str) -> str:
    return text.format(part="part", lineitem="lineitem", supplier="supplier")
