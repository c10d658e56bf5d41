"""Layers of any graph: callees left of their callers, with cycles found and named.

Places that call each other in a circle are one component. Components are found by cutting off what stands on no circle,
sending the greatest name along the edges, and going back from each name's own place: what is met both ways is its
component. Components without circles among them are then placed from the callees on. Every step is a join and an
aggregate over what is left, written and read again; nothing of the graph reaches the driver but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled


def _among(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with both ends among names."""
    return edges.join(names.select(F.col("name").alias("src")), "src", "left_semi").join(names.select(F.col("name").alias("dst")), "dst", "left_semi").select("src", "dst")


def _trimmed(names: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(names and edges that may stand on circles, names cut off): again and again those that nothing leads to, or that
    lead to nothing."""
    off = None
    while True:
        inner = edges.select(F.col("src").alias("name")).intersect(edges.select(F.col("dst").alias("name")))
        alone = settled(names.join(inner, "name", "left_anti"), "layers-alone")
        if alone.isEmpty():
            return names, edges, off
        off = alone if off is None else off.unionByName(alone)
        names = settled(inner, "layers-names")
        edges = settled(_among(edges, names), "layers-edges")


def _greatest(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, color): the greatest name from which each can be reached, its own included."""
    color = names.select("name", F.col("name").alias("color"))
    while True:
        sent = edges.join(color.withColumnRenamed("name", "src"), "src").groupBy(F.col("dst").alias("name")).agg(F.max("color").alias("sent"))
        new = color.join(sent, "name", "left").select("name", F.greatest("color", "sent").alias("color"), (F.col("sent") > F.col("color")).alias("moved"))
        new = settled(new, "layers-color")
        color = new.select("name", "color")
        if new.filter("moved").isEmpty():
            return color


def _back(color: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, color) that lead back to their color's own place along places of that color."""
    to = edges.join(color.select(F.col("name").alias("src"), F.col("color").alias("c_src")), "src").join(color.select(F.col("name").alias("dst"), F.col("color").alias("c_dst")), "dst")
    inner = settled(to.filter("c_src = c_dst").select("src", "dst", F.col("c_src").alias("color")), "layers-inner")
    seen = front = settled(color.filter("name = color"), "layers-back")
    while True:
        found = inner.join(front.select(F.col("name").alias("dst")), "dst", "left_semi").select(F.col("src").alias("name"), "color").distinct()
        front = settled(found.join(seen.select("name"), "name", "left_anti"), "layers-back")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def components(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, component): the least name of those that each can reach and be reached from; alone: its own."""
    return _components(*_given(names, edges))


def _given(names: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names and the edges among them, each once, written: what they are made of isn't computed again."""
    names = settled(names.select("name").distinct(), "layers-names")
    return names, settled(_among(edges.filter("src != dst").select("src", "dst").distinct(), names), "layers-edges")


def _components(names: DataFrame, edges: DataFrame) -> DataFrame:
    out = None
    while True:
        names, edges, off = _trimmed(names, edges)
        if off is not None:
            off = off.select("name", F.col("name").alias("component"))
            out = off if out is None else out.unionByName(off)
        if names.isEmpty():
            return out if out is not None else names.select("name", F.col("name").alias("component"))
        met = _back(_greatest(names, edges), edges)
        least = met.groupBy("color").agg(F.min("name").alias("component"))
        whole = settled(met.join(least, "color").select("name", "component"), "layers-components")
        out = whole if out is None else out.unionByName(whole)
        names = settled(names.join(whole, "name", "left_anti"), "layers-names")
        edges = settled(_among(edges, names), "layers-edges")


def layers(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, level, cycle): level 0 calls nothing else; others stand one beyond the farthest of what they call. Those on
    a circle share a level, and cycle is the circle's least name; null: on none. Names are taken once; edges from or to
    other names, and to oneself, don't count. As many steps as there are levels."""
    names, edges = _given(names, edges)
    of = settled(_components(names, edges), "layers-of")
    a, b = of.select(F.col("name").alias("src"), F.col("component").alias("a")), of.select(F.col("name").alias("dst"), F.col("component").alias("b"))
    left = settled(edges.join(a, "src").join(b, "dst").filter("a != b").select("a", "b").distinct(), "layers-left")
    wait = settled(of.select("component").distinct(), "layers-wait")
    placed, level = None, 0
    while not wait.isEmpty():
        free = settled(wait.join(left.select(F.col("a").alias("component")), "component", "left_anti"), "layers-free")
        now = free.select("component", F.lit(level).alias("level"))
        placed = now if placed is None else placed.unionByName(now)
        left = settled(left.join(free.select(F.col("component").alias("b")), "b", "left_anti"), "layers-left")
        wait = settled(wait.join(free, "component", "left_anti"), "layers-wait")
        level += 1
    sizes = of.groupBy("component").agg((F.count("*") > 1).alias("circle"))
    if placed is None:
        return of.select("name", F.lit(0).alias("level"), F.lit(None).cast("string").alias("cycle"))
    return of.join(placed, "component").join(sizes, "component").select("name", "level", F.when(F.col("circle"), F.col("component")).alias("cycle"))
