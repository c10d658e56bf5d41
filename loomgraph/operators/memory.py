"""What was asked before: append-only logs and what they show.

interactions: module_name, kind (diagnosis or qa), query, summary, confidence, ts (and ord, the place in the log).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import topics

LEAST_QUERIES, TOPIC_SHARE, TYPICAL, UNSURE, KEPT_SESSIONS = 3, 0.5, 3, 0.7, 50


def record(module_name: Column, kind: str, query: Column, summary: Column, confidence: Column, ts: Column | None = None) -> list[Column]:
    """Columns of a log row."""
    return [module_name.alias("module_name"), F.lit(kind).alias("kind"), query.alias("query"), summary.alias("summary"), confidence.cast("double").alias("confidence"), (ts if ts is not None else F.current_timestamp()).alias("ts")]


def hotspots(log: DataFrame) -> DataFrame:
    """(module_name, topic, question_count): in modules asked about three times or more, words whose occurrences
    are half as many as the questions or more."""
    n = log.groupBy("module_name").agg(F.count("*").alias("queries")).filter(F.col("queries") >= LEAST_QUERIES)
    words = log.select("module_name", F.explode(topics(F.col("query"))).alias("topic")).groupBy("module_name", "topic").agg(F.count("*").alias("question_count"))
    return words.join(n, "module_name").filter(F.col("question_count") >= F.col("queries") * TOPIC_SHARE).select("module_name", "topic", "question_count")


def typical_questions(log: DataFrame, spots: DataFrame) -> DataFrame:
    """(module_name, topic, rank, query): up to three questions that hold the topic, longer ones first."""
    j = spots.select("module_name", "topic").join(log.select("module_name", "query", "ord"), "module_name").filter(F.lower("query").contains(F.lower("topic")))
    w = Window.partitionBy("module_name", "topic").orderBy(F.desc(F.length("query")), "ord")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= TYPICAL).select("module_name", "topic", "rank", "query")


def last_records(log: DataFrame, n: int, key: str = "module_name") -> DataFrame:
    """The last n records of each module."""
    return log.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ord")))).filter(F.col("back") <= n)


def session_summary(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, unresolved), five rows each at most: summaries of each module's last three diagnoses, modules in
    order of appearance; and questions answered without confidence."""
    first = log.groupBy("module_name").agg(F.min("ord").alias("first"))
    last = last_records(log.filter("kind = 'diagnosis'"), 3).join(first, "module_name")
    findings = last.filter("summary != ''").orderBy("first", "ord").limit(5).select("module_name", "summary")
    unsure = log.filter((F.col("kind") == "qa") & (F.coalesce("confidence", F.lit(0.0)) < UNSURE) & (F.col("query") != "")).join(first, "module_name")
    return findings, unsure.orderBy("first", "ord").limit(5).select("module_name", "query")


def understanding(log: DataFrame) -> DataFrame:
    """(module_name, view_count, diagnose_count, ask_count, last_accessed)."""
    return log.groupBy("module_name").agg(F.count_if(F.col("kind") == "view").alias("view_count"), F.count_if(F.col("kind") == "diagnosis").alias("diagnose_count"), F.count_if(F.col("kind") == "qa").alias("ask_count"), F.max("ts").alias("last_accessed"))


def focus_profile(log: DataFrame, key: str = "module_name") -> DataFrame:
    return log.groupBy(key).agg(F.count("*").alias("n"))


def keep_sessions(sessions: DataFrame, n: int = KEPT_SESSIONS) -> DataFrame:
    """The last n sessions."""
    return sessions.orderBy(F.desc("ts"), F.desc("session_id")).limit(n)
