"""Grouping of files into modules, by path. files: file, ord, line_count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import triples

#: Fixed: path parts and file names that mark tests and configuration.
TEST_PARTS = ("test", "tests", "spec", "specs", "__tests__", "test_", "_test")
CONFIG_PARTS = ("config", "conf", "settings", "cfg")
CONFIG_FILES = ("setup.py", "setup.cfg", "pyproject.toml", "package.json", "tsconfig.json", "webpack.config.js", "vite.config.ts", "docker-compose.yml", ".env.example", "alembic.ini")
ROOT, TESTS, CONFIG = "<root>", "测试", "配置"
LARGE_FILE = 500


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.try_element_at(parts(path), F.lit(-1)), r"(?<=.)\.[^.]*$", "")


def is_test(path: Column) -> Column:
    name = F.lower(stem(path))
    return F.exists(parts(path), lambda p: F.lower(p).isin(*TEST_PARTS) | F.lower(p).startswith("test")) | name.startswith("test_") | name.endswith("_test") | name.startswith("spec_")


def is_config(path: Column) -> Column:
    return F.lower(F.try_element_at(parts(path), F.lit(-1))).isin(*CONFIG_FILES) | F.exists(parts(path), lambda p: F.lower(p).isin(*CONFIG_PARTS))


def top_dir(path: Column) -> Column:
    return F.when(F.size(parts(path)) > 1, F.element_at(parts(path), 1)).otherwise(ROOT)


def sub_dir(path: Column) -> Column:
    return F.when(F.size(parts(path)) > 2, F.element_at(parts(path), 2))


def module_files(files: DataFrame) -> DataFrame:
    """files with name, dir_path, kind (0 directory, 1 large root file, 2 tests, 3 configuration) of their module."""
    f = F.col("file")
    alone = (F.col("line_count") > LARGE_FILE) & (top_dir(f) == ROOT)
    kind = F.when(is_test(f), 2).when(is_config(f), 3).when(alone, 1).otherwise(0)
    out = files.withColumn("kind", kind)
    name = F.when(F.col("kind") == 2, TESTS).when(F.col("kind") == 3, CONFIG).when(F.col("kind") == 1, stem(f)).otherwise(F.concat_ws("/", top_dir(f), sub_dir(f)))
    # Large root files are modules of their own, also where stems agree.
    return out.withColumn("name", name).withColumn("dir_path", F.when(F.col("kind") == 2, "tests/").when(F.col("kind") == 3, "config/").otherwise(name)).withColumn("key", F.when(F.col("kind") == 1, f).otherwise(name))


def swift_files(files: DataFrame, targets: DataFrame) -> DataFrame:
    """(file, ord, line_count, name, type): files under each target's path, a file under two in both; the rest keep
    their directory. targets: name, path, type. A file meets targets by each of its own directories, so however many
    targets there are, this is an equi-join."""
    own = targets.select(F.col("name"), F.regexp_replace("path", "/+$", "").alias("path"), "type")
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("file", "/"))), lambda n: F.array_join(F.slice(F.split("file", "/"), 1, n), "/"))
    under = files.withColumn("path", F.explode(above)).join(own, "path")
    rest = files.join(under.select("file").distinct(), "file", "left_anti").withColumns({"name": top_dir(F.col("file")), "path": top_dir(F.col("file")), "type": F.lit("rest")})
    return under.unionByName(rest.select(under.columns))


def build_modules(placed: DataFrame, functions: DataFrame, classes: DataFrame, calls: DataFrame) -> DataFrame:
    """One row per module: name, dir_path, files, entry_functions (10 at most), public_interfaces (20 at most, in
    order of appearance), total_lines, is_special, rank (struct): directories by name, then large files, tests and
    configuration."""
    home = placed.select("file", "key", F.col("ord").alias("file_ord"), "kind")
    base = placed.groupBy("key", "kind", "name", "dir_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "file"))), lambda x: x.file).alias("files"), F.sum("line_count").cast("long").alias("total_lines"), F.min("ord").alias("ord"))
    plain = home.filter("kind < 2")
    f = functions.join(plain, "file").select("key", "file_ord", "ord", "name", "is_method")
    called = calls.join(plain, "file").select("key", F.col("callee_name").alias("name")).distinct()
    public = f.filter("not is_method and not startswith(name, '_')").withColumn("seq", F.struct("file_ord", F.lit(0).alias("k"), "ord"))
    entry = public.join(called, ["key", "name"], "left_anti")

    def first(df: DataFrame, n: int, column: str) -> DataFrame:
        ranked = df.withColumn("__k", F.row_number().over(Window.partitionBy("key").orderBy("seq"))).filter(F.col("__k") <= n)
        return ranked.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda x: x["name"]).alias(column))

    shown = classes.join(plain, "file").filter("not startswith(name, '_')").select("key", "name", F.struct("file_ord", F.lit(1).alias("k"), "ord").alias("seq"))
    faces = public.select("key", "name", "seq").unionByName(shown).groupBy("key", "name").agg(F.min("seq").alias("seq"))
    none = F.array().cast("array<string>")
    out = base.join(first(entry, 10, "entry_functions"), "key", "left").join(first(faces, 20, "public_interfaces"), "key", "left")
    return out.select("name", "dir_path", "files", F.coalesce("entry_functions", none).alias("entry_functions"), F.coalesce("public_interfaces", none).alias("public_interfaces"), "total_lines", (F.col("kind") >= 2).alias("is_special"), F.struct("kind", F.when(F.col("kind") == 0, F.col("name")).otherwise("").alias("by_name"), "ord").alias("rank"))


def module_index(modules: DataFrame, keep=None) -> triples.Index:
    """For find_module() and modules_in_scope(): modules by the letters of their names and directories."""
    return triples.index(modules, "name", "name", "dir_path", keep=keep)


def _holding(modules: DataFrame, wanted: str, index: triples.Index | None) -> DataFrame:
    """Modules that may hold what is wanted; by the index, which holds their exact names as well."""
    if index is None or len(wanted) < triples.LENGTHS[0]:
        return modules
    return triples.holding(modules, index, "name", F.array(F.lit(wanted.lower())))


def find_module(modules: DataFrame, wanted: str, index: triples.Index | None = None) -> DataFrame:
    """The module of that name or directory; else the only one that holds it, whatever its case; else none. index:
    module_index(modules); the result is the same."""
    modules = _holding(modules, wanted, index)
    exact = modules.filter((F.col("name") == wanted) | (F.col("dir_path") == wanted)).withColumn("how", F.lit("exact"))
    low = wanted.lower()
    loose = modules.filter((F.lower("name").contains(low) | F.lower("dir_path").contains(low)) & (F.col("name") != wanted) & (F.col("dir_path") != wanted)).withColumn("how", F.lit("part"))
    both = exact.unionByName(loose).withColumn("n_exact", F.count(F.when(F.col("how") == "exact", 1)).over(Window.partitionBy(F.lit(1)))).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    return both.filter((F.col("how") == "exact") | ((F.col("n_exact") == 0) & (F.col("n") == 1))).drop("n", "n_exact")


def modules_in_scope(modules: DataFrame, wanted: str, index: triples.Index | None = None) -> DataFrame:
    """All modules of that name or directory, or that hold it: several may. index: as in find_module()."""
    modules = _holding(modules, wanted, index)
    low = wanted.lower()
    return modules.filter((F.col("name") == wanted) | (F.col("dir_path") == wanted) | F.lower("name").contains(low) | F.lower("dir_path").contains(low))


def file_tree(files: DataFrame, depth: int = 2) -> DataFrame:
    """(path, level, files): directories to a depth, and files that stand above it."""
    p = parts(F.col("file"))
    each = files.select(F.explode(F.sequence(F.lit(1), F.least(F.size(p), F.lit(depth)))).alias("level"), p.alias("p"))
    return each.groupBy(F.array_join(F.slice("p", 1, F.col("level")), "/").alias("path"), "level").agg(F.count("*").alias("files"))
