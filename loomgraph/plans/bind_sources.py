"""Scans, snapshots, extraction and diffs. Documents stand for files: their paths come from id and source."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import functions as F

from ..extract import router
from ..operators import incremental, stats
from ..sources import repository

ROOT = str(Path(__file__).resolve().parents[2])

#: Endings of the made-up paths, and what a scan makes of them.
_ENDS = (("src/{s}/a{i}.py", "python"), ("src/{s}/b{i}.TS", "typescript"), ("lib/{s}/c{i}.go", "go"), ("conf/d{i}.yaml", "yaml"), ("node_modules/{s}/e{i}.js", None), ("img/{s}/f{i}.png", None), ("docs/{s}/g{i}.xyz", None), ("{s}{i}.rs", "rust"))


def ship(spark) -> None:
    """Let Python workers import this package when the session was started elsewhere."""
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, ROOT])


_PATH = "CASE doc_id % 8 " + " ".join("WHEN {k} THEN {p}".format(k=k, p="'" + p.replace("{s}", "' || source || '").replace("{i}", "' || CAST(doc_id AS STRING) || '") + "'") for k, (p, _) in enumerate(_ENDS)) + " END"


def listing(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.expr(_PATH).alias("path"), F.col("text").alias("content"), "doc_id")


def scan_files(spark, d):
    files, _ = repository.scan(listing(spark, d), None)
    return files.select("path", "language", "is_config", "line_count", "size_bytes")


_LINES = "length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT text LIKE '%' || chr(10) THEN 1 ELSE 0 END"
_LANG = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{lang}'" for k, (_, lang) in enumerate(_ENDS) if lang) + " END"
_FILES = f"SELECT {_PATH} AS path, {_LANG} AS language, doc_id % 8 = 3 AS is_config, {_LINES} AS line_count, strlen(text) AS size_bytes FROM documents WHERE {_LANG} IS NOT NULL"


def scan_summary(spark, d):
    _, s = repository.scan(listing(spark, d), None)
    return s.select("files", "skipped", "total_lines", "total_bytes", F.array_join(F.transform(F.array_sort(F.map_entries("languages")), lambda e: F.concat(e.key, F.lit("="), e.value)), ",").alias("languages"))


SUMMARY = f"""WITH f AS ({_FILES}) SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM documents WHERE doc_id % 8 IN (5, 6)) AS skipped,
 (SELECT CAST(sum(line_count) AS BIGINT) FROM f WHERE NOT is_config) AS total_lines, (SELECT CAST(sum(size_bytes) AS BIGINT) FROM f) AS total_bytes,
 (SELECT string_agg(language || '=' || n, ',' ORDER BY language) FROM (SELECT language, count(*) AS n FROM f WHERE NOT is_config GROUP BY 1) q) AS languages"""


def language_stats(spark, d):
    files, _ = repository.scan(listing(spark, d), None)
    return stats.language_stats(files)


def architecture(spark, d):
    files, _ = repository.scan(listing(spark, d), None)
    return stats.architecture(files).select(F.array_join("hints", ",").alias("hints"))


def _old(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("text").alias("content"), "doc_id")


def _new(spark, d):
    """The second state: of ten files one is gone, one is edited and one has another name."""
    k = F.col("doc_id") % 10
    return _old(spark, d).filter(k != 0).select(F.when(k == 2, F.concat(F.lit("n"), "doc_id")).otherwise(F.col("path")).alias("path"), F.when(k == 1, F.concat("content", F.lit("x"))).otherwise(F.col("content")).alias("content"), "doc_id")


_OLD = "SELECT 'd' || doc_id AS path, text AS content FROM documents"
_NEW = "SELECT CASE WHEN doc_id % 10 = 2 THEN 'n' || doc_id ELSE 'd' || doc_id END AS path, CASE WHEN doc_id % 10 = 1 THEN text || 'x' ELSE text END AS content FROM documents WHERE doc_id % 10 <> 0"
_CHANGES = f"SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.content <> n.content"


def snapshot_hash(spark, d):
    return incremental.snapshot(_old(spark, d))


def snapshot_diff(spark, d):
    return incremental.changes(incremental.snapshot(_old(spark, d)), incremental.snapshot(_new(spark, d)))


def incremental_merge(spark, d):
    old, new = (x.withColumnRenamed("path", "file_path") for x in (_old(spark, d), _new(spark, d)))
    merged = incremental.merge(old, new, snapshot_diff(spark, d))
    return merged.select(F.col("file_path").alias("path"), F.sha2("content", 256).alias("sha256"))


def scan_plan(spark, d):
    return incremental.plan_scan(incremental.snapshot(_old(spark, d)), incremental.snapshot(_new(spark, d)))


#: Sources and diffs of our own making, for tests; the queries make theirs of tables' rows.
PYTHON = '''import os, sys as system
from .base import Base, helper as h


class Service(Base):
    """Serves."""

    async def fetch(self, key: str, *rest, limit=3, **more) -> dict:
        """Fetches.

        More."""
        def inner(x):
            return helper(x)
        return self.store.get(inner(key))(limit)


def main():
    Service().fetch("a")
'''
BROKEN = "import a, b\nfrom x.y import p, q\nclass K(Base):\n    def run(self, n: int = 2):\n        go(n)\n  def bad(:\n"
TYPESCRIPT = 'import { a } from "./a";\nexport class View extends Base {\n  render(x: number) {\n    return x;\n  }\n}\nexport const load = async (id) => {\n  return require("fs");\n};\nfunction plain() {\n}\n'
GO = 'package p\nimport (\n  "fmt"\n  "os"\n)\ntype S struct {\n  n int\n}\nfunc (s *S) Run(x int) error {\n  return nil\n}\nfunc main() {\n}\n'
RUST = "use std::io;\npub mod net;\npub struct P {\n}\nimpl P {\n    pub fn go(&self) {\n    }\n}\npub async fn start() {\n}\n"
JAVA = "import java.util.List;\npublic class A extends B {\n    public static void main(String[] a) {\n    }\n}\n"
OTHER = "module Shop\n  def buy(x)\n    pay(x)\n  end\nimport thing;\n"
SOURCES = (("svc.py", "python", PYTHON), ("broken.py", "python", BROKEN), ("view.ts", "typescript", TYPESCRIPT), ("m.go", "go", GO), ("l.rs", "rust", RUST), ("A.java", "java", JAVA), ("shop.zig", "zig", OTHER), ("empty.py", "python", ""), ("none.py", "python", None))


def extract_documents(spark, d):
    """Every document as a source file of its path's language: what a scan parses, by method."""
    files, _ = repository.scan(listing(spark, d), None)
    r = router.parse_files(files)
    return r.groupBy("language", "parse_method").agg(F.count("*").alias("files"), F.sum(F.size("functions")).alias("functions"), F.sum("line_count").alias("lines"))


FILE = "\n".join(f"line {k}" for k in range(1, 41)) + "\n"
DIFFS = (
    ("good", "--- a/f.txt\n+++ b/f.txt\n@@ -3,3 +3,4 @@\n line 3\n-line 4\n+line four\n+more\n line 5\n"),
    ("moved", "diff --git a/f.txt b/f.txt\nindex 1..2 100644\n--- a/f.txt\n+++ b/f.txt\n@@ -8,2 +8,2 @@\n line 20\n-line 21\n+line x\n"),
    ("wrong", "--- a/f.txt\n+++ b/f.txt\n@@ -1,2 +1,2 @@\n line 1\n-line nine\n+y\n"),
    ("new", "--- /dev/null\n+++ b/new.txt\n@@ -0,0 +1,2 @@\n+a\n+b\n"),
)


_DEEP = "'r' || doc_id % 5 || '/' || source || '/p' || doc_id % 7 || '/f' || doc_id || '.py'"
_OLD_DEEP = f"SELECT {_DEEP} AS path, text AS content FROM documents WHERE doc_id % 35 <> 4"
_NEW_DEEP = f"SELECT {_DEEP} AS path, CASE WHEN doc_id % 35 = 6 THEN text || 'x' ELSE text END AS content FROM documents WHERE doc_id % 70 <> 8"
TREE_DIFF = f"""SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM ({_OLD_DEEP}) o FULL JOIN ({_NEW_DEEP}) n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.content <> n.content"""


def _deep(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return [incremental.snapshot(spark.sql(q.replace("FROM documents", "FROM {documents}"), documents=docs)) for q in (_OLD_DEEP, _NEW_DEEP)]


def tree_diff(spark, d):
    """Snapshots compared by their trees: files come, go and change in some directories, the others are left alone."""
    old, new = _deep(spark, d)
    return incremental.changes_by_tree(old, new, incremental.hash_tree(old), incremental.hash_tree(new))[0]


def hash_tree(spark, d):
    """How many files each directory holds, with its digests' agreement between two snapshots."""
    old, new = (incremental.hash_tree(x) for x in _deep(spark, d))
    now = new.select("dir", F.struct("a", "b").alias("now"))
    return old.join(now, "dir", "left").select("dir", "depth", "n", F.struct("a", "b").eqNullSafe(F.col("now")).alias("same"))


HASH_TREE = f"""WITH f AS (SELECT 0 AS k, path, content FROM ({_OLD_DEEP}) o UNION ALL SELECT 1, path, content FROM ({_NEW_DEEP}) n),
u AS (SELECT k, path, content, CAST(unnest(range(0, len(string_split(path, '/')))) AS INT) AS depth FROM f),
e AS (SELECT k, depth, array_to_string(list_slice(string_split(path, '/'), 1, depth), '/') AS dir, path || chr(1) || content AS x FROM u),
g AS (SELECT k, depth, dir, count(*) AS n, string_agg(x, chr(2) ORDER BY x) AS all_x FROM e GROUP BY 1, 2, 3)
SELECT o.dir, o.depth, o.n, coalesce(o.all_x = n.all_x, false) AS same FROM g o LEFT JOIN g n ON n.k = 1 AND n.dir = o.dir WHERE o.k = 0"""

QUERIES = {
    "scan_files": (scan_files, _FILES),
    "scan_summary": (scan_summary, SUMMARY),
    "language_stats": (language_stats, f"SELECT language, count(*) AS files, CAST(sum(line_count) AS BIGINT) AS lines FROM ({_FILES}) f WHERE NOT is_config GROUP BY 1"),
    "tree_diff": (tree_diff, TREE_DIFF),
    "hash_tree": (hash_tree, HASH_TREE),
    "snapshot_hash": (snapshot_hash, f"SELECT path, sha256(content) AS sha256 FROM ({_OLD}) o"),
    "snapshot_diff": (snapshot_diff, _CHANGES),
    "incremental_merge": (incremental_merge, f"SELECT path, sha256(content) AS sha256 FROM ({_NEW}) n"),
    "scan_plan": (scan_plan, f"SELECT count(*) AS n_changed, (SELECT count(*) FROM documents) AS n_files, CASE WHEN count(*) = 0 THEN 'none' WHEN count(*) / (SELECT count(*) FROM documents) < 0.3 THEN 'incremental' ELSE 'full' END AS mode FROM ({_CHANGES}) c"),
    "extract_documents": (extract_documents, None),
}
