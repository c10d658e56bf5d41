"""What a scan shows as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import size_health

#: Fixed: hints by words in directory names: (hint, groups of words, of each of which one is needed).
HINTS = (
    ("组件化前端", (("component",),)),
    ("页面路由架构", (("page",),)),
    ("有数据库迁移管理", (("migration", "alembic"),)),
    ("有自动化测试", (("test", "spec", "e2e"),)),
)
ROUTES, MODELS, VIEWS, CONTROLLERS = ("route", "router", "api"), ("model",), ("view", "template", "component"), ("controller", "handler")
DOCKER = ("dockerfile", "docker-compose")
LOOSE = 1.5


def _holds(column: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | column.contains(w)
    return F.coalesce(F.bool_or(hit), F.lit(False))


def architecture(files: DataFrame) -> DataFrame:
    """One row: hints (array), in order, from directories and file names."""
    low = F.lower("path")
    d = F.regexp_replace(low, "/?[^/]*$", "")
    seen = files.agg(*[_holds(d, w).alias(n) for n, w in (("r", ROUTES), ("m", MODELS), ("v", VIEWS), ("c", CONTROLLERS))], *[_holds(d, g[0]).alias(f"h{i}") for i, (_, g) in enumerate(HINTS)], _holds(low, DOCKER).alias("k"))
    layered = F.when(F.expr("r and m and (v or c)"), "MVC/分层架构").when(F.expr("r and m"), "REST API 架构")
    few = [F.when(F.col(f"h{i}"), name) for i, (name, _) in enumerate(HINTS)]
    return seen.select(F.array_compact(F.array(layered, *few[:3], F.when(F.col("k"), "Docker 容器化部署"), few[3])).alias("hints"))


def language_stats(files: DataFrame) -> DataFrame:
    return files.filter("not is_config").groupBy("language").agg(F.count("*").alias("files"), F.sum("line_count").cast("long").alias("lines"))


def overview(files: DataFrame, modules: DataFrame, module_edges: DataFrame) -> DataFrame:
    """One row: files, total_lines, top_languages (four), business_modules, special_modules, dependencies, coupling
    (loose under 1.5 dependencies a module), largest module and its health, hints."""
    langs = language_stats(files).withColumn("x", F.struct((-F.col("files")).alias("a"), "language", "files"))
    top = langs.agg(F.transform(F.slice(F.array_sort(F.collect_list("x")), 1, 4), lambda x: F.concat(x.language, F.lit("("), x.files, F.lit(" 文件)"))).alias("top_languages"), F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"))
    m = modules.agg(F.count_if(~F.col("is_special")).alias("business_modules"), F.count_if("is_special").alias("special_modules"), F.max_by(F.struct("name", "total_lines"), F.when(~F.col("is_special"), F.col("total_lines"))).alias("largest"))
    e = module_edges.agg(F.count("*").alias("dependencies"))
    out = top.crossJoin(m).crossJoin(e).crossJoin(architecture(files)).crossJoin(files.agg(F.count("*").alias("files")))
    nodes = F.greatest(F.col("business_modules") + F.col("special_modules"), F.lit(1))
    coupling = F.when(F.col("dependencies") / nodes < LOOSE, "低耦合").otherwise("中等耦合")
    return out.select("files", "total_lines", "top_languages", "business_modules", "special_modules", "dependencies", coupling.alias("coupling"), F.col("largest.name").alias("largest"), size_health(F.col("largest.total_lines")).alias("largest_health"), "hints")
