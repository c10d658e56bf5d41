"""Snapshots, their differences, and merges of what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..sources.shared import settled

#: Above this share of changed files everything is scanned anew.
FULL_SCAN_SHARE = 0.3


def snapshot(files: DataFrame) -> DataFrame:
    """(path, sha256) of files (path, content)."""
    return files.select("path", content_hash(F.col("content")).alias("sha256"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, modified or removed; unchanged paths aren't listed."""
    both = old.withColumnRenamed("sha256", "was").join(new.withColumnRenamed("sha256", "now"), "path", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    return both.withColumn("change", change).filter("change is not null").select("path", "change")


def hash_tree(files: DataFrame) -> DataFrame:
    """(dir, depth, n, a, b) of a snapshot (path, sha256): of each directory, '' being the top, how many files are below
    it and two 64-bit digests of their paths and hashes, which don't depend on their order. One aggregate, summed up
    before it is shuffled, so a directory with most of the files is no burden."""
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/").alias("dir")))
    each = files.select(F.explode(above).alias("d"), F.xxhash64("path", "sha256").alias("a"), F.xxhash64(F.lit(7), "sha256", "path").alias("b"))
    return each.groupBy("d.dir", "d.depth").agg(F.count("*").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))


def _parent(path):
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def changes_by_tree(old: DataFrame, new: DataFrame, old_tree: DataFrame, new_tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes() of two snapshots, (dir) of the directories that differ), by their trees: from the top down, a directory
    with equal digests is left alone with all that is below it, so only files that stand in directories that differ are
    compared. As many steps as directories are deep; each is written, as it says where the next one looks."""
    front, out = None, None
    depth = 0
    while True:
        was, now = (t.filter(F.col("depth") == depth).drop("depth") for t in (old_tree, new_tree))
        if front is not None:
            inside = front.withColumnRenamed("dir", "up")
            was, now = (t.withColumn("up", _parent(F.col("dir"))).join(inside, "up", "left_semi").drop("up") for t in (was, now))
        both = was.join(now.select("dir", F.struct("n", "a", "b").alias("now")), "dir", "full")
        front = settled(both.filter(~F.struct("n", "a", "b").eqNullSafe(F.col("now"))).select("dir"), "tree-front")
        if front.isEmpty():
            break
        out = front if out is None else out.unionByName(front)
        depth += 1
    if out is None:
        return changes(old.limit(0), new.limit(0)), front
    met = lambda t: t.withColumn("dir", _parent(F.col("path"))).join(out, "dir", "left_semi").select("path", "sha256")
    return changes(met(old), met(new)), out


def plan_scan(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: n_changed, n_files, mode: none (nothing changed), incremental, or full from FULL_SCAN_SHARE on."""
    n = changes(old, new).agg(F.count("*").alias("n_changed"))
    out = n.crossJoin(old.agg(F.count("*").alias("n_files")))
    share = F.col("n_changed") / F.greatest(F.col("n_files"), F.lit(1))
    return out.withColumn("mode", F.when(F.col("n_changed") == 0, "none").when((F.col("n_files") > 0) & (share < FULL_SCAN_SHARE), "incremental").otherwise("full"))


def merge(old: DataFrame, fresh: DataFrame, changed: DataFrame, key: str = "file_path") -> DataFrame:
    """old without what changed or was removed, with fresh rows of what was added or modified. Works for any fact
    table by path; statistics are to be taken from the result."""
    gone = changed.select(F.col("path").alias(key))
    added = fresh.join(changed.filter("change != 'removed'").select(F.col("path").alias(key)), key, "left_semi")
    return old.join(gone, key, "left_anti").unionByName(added)
