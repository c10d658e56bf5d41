"""Ranked lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import keywords, module_score, node_score, numbered
from . import triples

SNIPPET = 20


def node_index(nodes: DataFrame, keep=None) -> triples.Index:
    """For match_nodes(): nodes by the letters of their names and paths."""
    return triples.index(nodes, "node_id", "label", "file", keep=keep)


def match_nodes(nodes: DataFrame, query: str | Column, scope: DataFrame | None = None, limit: int = 10, index: triples.Index | None = None) -> DataFrame:
    """The best nodes for a question with their score, earlier ones first among equals. scope: (file) of a module.
    index: node_index(nodes), by which only nodes that may hold a keyword are looked at; the result is the same."""
    words = keywords(F.lit(query) if isinstance(query, str) else query)
    known = nodes.filter("label != '<module>'")
    if index is not None:
        known = triples.holding(known, index, "node_id", words)
    inside = None
    if scope is not None:
        known = known.join(scope.select("file").distinct().withColumn("in_scope", F.lit(True)), "file", "left")
        inside = F.coalesce("in_scope", F.lit(False))
    scored = known.withColumn("score", node_score(F.col("label"), F.col("file"), words, inside)).filter("score > 0")
    return scored.orderBy(F.desc("score"), "ord").limit(limit).drop("in_scope")


def match_modules(modules: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """modules (name, body, title, ord) that fit a question best."""
    scored = modules.withColumn("score", module_score(F.lit(query), F.col("name"), F.col("body"), F.col("title"))).filter("score > 0")
    return scored.orderBy(F.desc("score"), "ord").limit(limit)


def locations(found: DataFrame, nodes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """found (node_id, direction, depth) as places: ref file:Lx-Ly, priority high for seeds, and the numbered text."""
    out = found.join(nodes.select("node_id", "file", "line_start", "line_end", "label", "ord"), "node_id").filter("label != '<module>'")
    out = out.withColumn("priority", F.when(F.col("direction") == "seed", "high").otherwise("medium"))
    out = out.withColumn("ref", F.concat("file", F.lit(":L"), "line_start", F.lit("-L"), "line_end"))
    if files is not None:
        # Files are sized by their rows, not by what they hold: they would be sent whole to all tasks. Only those asked for move.
        text = files.select(F.col("path").alias("file"), "content").join(out.select("file").distinct(), "file", "left_semi").hint("merge")
        last = F.when(F.col("line_end") > 0, F.col("line_end")).otherwise(F.col("line_start") + SNIPPET)
        first = F.greatest(F.col("line_start"), F.lit(1))
        lines = F.array_join(F.slice(F.split("content", "\n"), first, F.greatest(last - first + 1, F.lit(1))), "\n")
        out = out.join(text, "file", "left").withColumn("snippet", F.when(F.col("content").isNull(), "").otherwise(F.array_join(F.transform(F.split(lines, "\n"), lambda x, i: F.concat(F.lpad((i + first).cast("string"), 4, " "), F.lit(" | "), x)), "\n"))).drop("content")
    return out


def coalesce_ranges(ranges: DataFrame, gap: int = 2, limit: int | None = None) -> DataFrame:
    """(file, line_start, line_end): ranges of a file that touch or leave at most `gap` lines become one. One window
    by file: the running end before each range tells where a new one begins."""
    from pyspark.sql import Window

    by_file = Window.partitionBy("file").orderBy("line_start", "line_end")
    before = F.max("line_end").over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("new", F.when(before.isNull() | (F.col("line_start") > before + gap), 1).otherwise(0))
    island = F.sum("new").over(by_file.rowsBetween(Window.unboundedPreceding, 0))
    out = marked.withColumn("island", island).groupBy("file", "island").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end")).drop("island")
    return out if limit is None else out.orderBy("file", "line_start").limit(limit)


__all__ = ["coalesce_ranges", "locations", "match_modules", "match_nodes", "numbered"]
