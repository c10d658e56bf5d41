"""Line dedup by site-relative frequency.

A line is boilerplate on its host when the share of the host's pages that hold it exceeds a ratio.
Lines are compared trimmed; blank lines are never counted nor dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

TRIMMED = " \t\r"
#: Above so many (host, line) rules, rules are joined by host instead of being broadcast: 24 bytes each, so 5 MB.
BROADCAST_RULES = 200_000
#: Ways in which a host's pages are dealt when rules are joined by host.
HOST_SALTS = 64


def line_hash(line: Column) -> Column:
    """96 bits that stand for a trimmed line."""
    s = F.btrim(line, F.lit(TRIMMED))
    return F.struct(F.xxhash64(s).alias("a"), F.hash(s).alias("b"))


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(TRIMMED)) == ""


def boilerplate_lines(docs: DataFrame, text: str = "text", host: str = "source", max_ratio: float = 0.2, min_pages: int = 5) -> DataFrame:
    """(host, line, pages, ratio): lines on more than max_ratio of a host's pages and on min_pages at least.

    Hosts that are null count as the host ''. A hot host does no harm: both counts are summed map-side,
    so a task sends one row per (host, line) it has met.
    """
    pages = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    lines = pages.filter(F.col("text").isNotNull()).select("host", F.explode(F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: ~_blank(x)), line_hash))).alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    return counts.join(totals, "host").filter(F.col("pages") > F.col("host_pages") * F.lit(max_ratio)).select("host", "line", "pages", (F.col("pages") / F.col("host_pages")).alias("ratio"))


def drop_boilerplate(docs: DataFrame, text: str = "text", host: str = "source", max_ratio: float = 0.2, min_pages: int = 5) -> DataFrame:
    """docs with boilerplate lines taken out of `text`, plus n_lines and n_dropped (lines, long), which replace columns
    of docs with these names; `__host`, `__rules`, `__salt` and `__left` are in use while it runs.

    All rows stay, also those left with an empty text. Null text: null, 0, 0. Empty text: one line, blank, so it stays.
    Repeated rows count as pages of their own. An empty table gives an empty result.
    A host needs min_pages pages with the line, so hosts of a few pages lose nothing.

    A host has at most (mean lines of a page / max_ratio) rules, so rules are few beside pages. They are
    written first and counted; up to BROADCAST_RULES they are sent to all executors and texts aren't
    shuffled; beyond, they are joined by host with pages dealt over HOST_SALTS parts of each host.
    """
    rules = materialize(boilerplate_lines(docs, text, host, max_ratio, min_pages).select("host", "line"), "line-rules")
    n_rules = rules.count()
    by_host = rules.groupBy("host").agg(F.collect_list("line").alias("__rules")).withColumnRenamed("host", "__host")
    keyed = docs.withColumn("__host", F.coalesce(F.col(host).cast("string"), F.lit("")))
    if n_rules <= BROADCAST_RULES:
        joined = keyed.join(F.broadcast(by_host), "__host", "left")
    else:
        salted = by_host.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(HOST_SALTS - 1))))
        joined = keyed.withColumn("__salt", F.pmod(F.xxhash64(F.col(text)), F.lit(HOST_SALTS)).cast("int")).join(salted, ["__host", "__salt"], "left").drop("__salt")
    lines = F.split(F.col(text), "\n")
    left = F.filter(lines, lambda x: _blank(x) | ~F.array_contains(F.col("__rules"), line_hash(x)))
    out = joined.withColumn("__left", F.when(F.col("__rules").isNull(), lines).otherwise(left))
    out = out.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long"))
    out = out.withColumn("n_dropped", F.col("n_lines") - F.when(F.col(text).isNull(), 0).otherwise(F.size("__left")))
    return out.withColumn(text, F.array_join("__left", "\n")).drop("__host", "__rules", "__left")


def query(spark, sf_dir: str) -> DataFrame:
    """All of documents, with its source as the host."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = drop_boilerplate(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("chars_left"), F.sha2("text", 256).alias("text_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS host, unnest(string_split(text, chr(10))) AS l,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
totals AS (SELECT coalesce(source, '') AS host, count(*) AS host_pages FROM documents GROUP BY 1),
rules AS (
  SELECT host, k FROM (
    SELECT host, trim(l, ' ' || chr(9) || chr(13)) AS k, count(DISTINCT doc_id) AS pages FROM lines GROUP BY 1, 2)
  JOIN totals USING (host) WHERE k <> '' AND pages >= 5 AND pages > host_pages * 0.2),
marked AS (
  SELECT doc_id, pos, l, r.k IS NOT NULL AS bad
  FROM lines LEFT JOIN rules r ON lines.host = r.host AND trim(l, ' ' || chr(9) || chr(13)) = r.k),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_dropped,
         coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (NOT bad), '') AS t
  FROM marked GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       length(t) AS chars_left, sha256(t) AS text_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
