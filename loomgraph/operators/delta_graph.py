"""A graph after edits, from the graph before them: only what the edits can have changed is resolved again.

How a call is resolved depends on its own file's facts, on the definitions that have its callee's name, and on where its
file's imports lead. So after edits these calls are looked at again: those of changed files, those of names that changed
files define or defined, and those of files with an import of a module that now leads elsewhere. Edges get the calls that
came and lose those that went; an edge's label is worked out again only where one of its calls came or went.

The order of files that stay mustn't change among them: scans order them by path.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled
from . import resolve
from .graph import CRITICAL_CALLS

#: Up to so many changed files, names or pairs are sent to all tasks; more are joined by shuffles.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Facts:
    """Extracted facts of a repository: the tables that resolution reads."""

    files: DataFrame
    functions: DataFrame
    classes: DataFrame
    imports: DataFrame
    calls: DataFrame

    def of(self, few: DataFrame) -> Facts:
        """Those of some files."""
        return replace(self, **{k: getattr(self, k).join(few, "file", "left_semi") for k in ("files", "functions", "classes", "imports", "calls")})

    def definitions(self) -> DataFrame:
        return resolve.definitions(self.functions, self.classes, self.files)


@dataclass(frozen=True)
class Graph:
    """nodes, edges, and each call with its ends, from which both follow."""

    nodes: DataFrame
    edges: DataFrame
    resolved: DataFrame


def build(facts: Facts) -> Graph:
    defs = facts.definitions()
    resolved = settled(resolve.resolved_calls(facts.files, defs, facts.classes, facts.imports, facts.calls), "resolved")
    return Graph(resolve.graph_nodes(facts.files, defs, resolved), resolve.edges_of(resolved, facts.files), resolved)


def build_nodes(facts: Facts) -> DataFrame:
    """Nodes of build() alone. They take no callees, and callers are looked for once for each name in a file."""
    return _graph_nodes(facts, facts.calls)


def _graph_nodes(facts: Facts, calls: DataFrame) -> DataFrame:
    defs = facts.definitions()
    callers = calls.select("file", "caller_func").distinct()
    return resolve.graph_nodes(facts.files, defs, resolve.resolve_callers(callers, defs, facts.classes))


def update_nodes(new: Facts, changed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of update() alone: new, changed as there; nodes: those before the edits."""
    few = _small(changed.select(F.col("path").alias("file")), "delta-files")
    after = new.of(few)
    return _merged_nodes(nodes, _graph_nodes(after, after.calls), few, new.files)


def _merged_nodes(nodes: DataFrame, own: DataFrame, few: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes are of one file each: own ones of the few files; others stay, with their file's new place."""
    place = files.select("file", F.col("ord").alias("file_ord"))
    within = F.col("ord").bitwiseAND(F.lit((1 << resolve.FILE_BITS) - 1))
    others = nodes.join(few, "file", "left_anti").join(place, "file").withColumn("ord", F.shiftleft(F.col("file_ord").cast("long"), resolve.FILE_BITS) + within)
    return others.select(*own.columns).unionByName(own)


def _small(df: DataFrame, tag: str) -> DataFrame:
    """df, written, to be sent to all tasks if it has few rows."""
    kept = settled(df, tag)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def moved_modules(old: DataFrame, new: DataFrame) -> DataFrame:
    """(module): what leads to another file, or to one where there was none, or to none, once files came and went."""
    was, now = resolve.module_index(old), resolve.module_index(new)
    both = was.withColumnRenamed("target", "was").join(now.withColumnRenamed("target", "now"), "module", "full")
    return both.filter(~F.col("was").eqNullSafe(F.col("now"))).select("module")


def update(old: Facts, new: Facts, changed: DataFrame, graph: Graph) -> tuple[Graph, DataFrame]:
    """(graph after the edits, report). old, new: all facts before and after; changed: (path, change) of
    incremental.changes(); graph: that of old.

    report, one row: n_calls (all calls), n_again (those that were resolved again), n_pairs (edges that calls came to or
    went from). Definitions are read by name and file, calls once; what didn't change isn't shuffled while what did is
    few rows.
    """
    paths = _small(changed.select(F.col("path").alias("file"), "change"), "delta-files")
    few = paths.select("file")
    before, after = old.of(few), new.of(few)
    names = _small(before.functions.select("name").union(before.classes.select("name")).union(after.functions.select("name")).union(after.classes.select("name")).distinct(), "delta-names")
    only_edits = changed.filter("change != 'modified'").isEmpty()
    touched = few
    if not only_edits:
        led = new.imports.join(moved_modules(old.files, new.files), "module", "left_semi").select("file").distinct()
        touched = _small(few.unionByName(led).distinct(), "delta-touched")

    last = F.element_at(F.split("callee_name", r"\\."), -1)

    def looked_at(calls: DataFrame) -> DataFrame:
        """Calls of touched files, and of others those of names that have changed."""
        own = calls.join(touched, "file", "left_semi")
        rest = calls.join(touched, "file", "left_anti").withColumn("name", last).join(names, "name", "left_semi").select(*calls.columns)
        return own.unionByName(rest)

    again = settled(looked_at(new.calls), "delta-calls")
    # Definitions that these calls can meet: by name, and those of their own files, from which they start.
    asked = _small(again.select(F.explode(F.array("callee_name", F.element_at(F.split("callee_name", r"\\."), -1))).alias("name")).distinct(), "delta-asked")
    home = _small(again.select("file").distinct(), "delta-home")
    defs = new.definitions()
    met = defs.join(asked, "name", "left_semi").select(*defs.columns).unionByName(defs.join(home, "file", "left_semi").join(asked, "name", "left_anti").select(*defs.columns))
    fresh = settled(resolve.resolved_calls(new.files, settled(met, "delta-defs"), new.classes.join(home, "file", "left_semi"), new.imports.join(home, "file", "left_semi"), again), "delta-fresh")
    gone = settled(looked_at(graph.resolved), "delta-gone")

    # By the same conditions: two calls of a file may stand at the same place.
    stays = graph.resolved.join(touched, "file", "left_anti").withColumn("name", last).join(names, "name", "left_anti").select(*graph.resolved.columns)
    resolved = settled(stays.unionByName(fresh), "resolved")
    ends = "src is not null and dst is not null and src != dst"
    ways = gone.filter(ends).select("src", "dst", F.lit(-1).alias("n")).unionByName(fresh.filter(ends).select("src", "dst", F.lit(1).alias("n")))
    # Calls that were resolved as before cancel out, each against one of the other side.
    call = ["file", "ord", "src", "dst", "callee_name"]
    both = gone.filter(ends).select(*call, F.lit(-1).alias("n")).unionByName(fresh.filter(ends).select(*call, F.lit(1).alias("n")))
    moved = both.groupBy(*call).agg(F.sum("n").alias("n")).filter("n != 0").select("src", "dst").distinct()
    pairs = _small(moved, "delta-pairs")
    counts = ways.groupBy("src", "dst").agg(F.sum("n").alias("more"))
    labels = resolve.edges_of(resolved.join(pairs, ["src", "dst"], "left_semi").select(*resolved.columns), new.files).select("src", "dst", F.col("data_label").alias("label"))
    kept = graph.edges.join(pairs, ["src", "dst"], "left_anti").select(*graph.edges.columns)
    turned = pairs.join(graph.edges.select("src", "dst", "call_count"), ["src", "dst"], "left").join(counts, ["src", "dst"], "left").join(labels, ["src", "dst"], "left")
    n = F.coalesce("call_count", F.lit(0)) + F.coalesce("more", F.lit(0))
    turned = turned.select("src", "dst", F.col("label").alias("data_label"), n.cast("long").alias("call_count"), (n >= CRITICAL_CALLS).alias("is_critical_path")).filter("call_count > 0")
    edges = kept.unionByName(turned)

    nodes = _merged_nodes(graph.nodes, resolve.graph_nodes(after.files, after.definitions(), resolved.join(few, "file", "left_semi")), few, new.files)
    report = new.calls.agg(F.count("*").alias("n_calls")).crossJoin(F.broadcast(again.agg(F.count("*").alias("n_again")))).crossJoin(F.broadcast(pairs.agg(F.count("*").alias("n_pairs"))))  # one row each
    return Graph(nodes, edges, resolved), report
