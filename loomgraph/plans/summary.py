"""Summaries by rules, prompts for a model, and a model's answer with the rules as its fallback."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import naming
from ..operators import graph

# Fixed: colors of languages.
LANGUAGE_COLORS = {
    "python": "#306998", "javascript": "#f7df1e", "typescript": "#3178c6", "java": "#b07219", "go": "#00add8", "rust": "#dea584", "bash": "#3e4451",
    "ruby": "#cc342d", "c": "#555555", "cpp": "#f34b7d", "csharp": "#178600", "php": "#4f5d95", "swift": "#ffac45", "kotlin": "#a97bff",
}
OTHER_COLOR = "#64748b"
REFS = 5


def language_color(language):
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_COLORS.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(language)), F.lit(OTHER_COLOR))


def source_refs(members: DataFrame, functions: DataFrame, n: int = REFS) -> DataFrame:
    """(name, rank, ref): each module's first public functions as places. members: name, file, ord."""
    f = functions.select("file", F.col("ord").alias("k"), F.col("name").alias("function"), "line_start", "line_end").filter("not startswith(function, '_')")
    j = members.select("name", "file", "ord").join(f, "file")
    ranked = j.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("ord", "k"))).filter(F.col("rank") <= n)
    return ranked.select("name", "rank", F.concat("file", F.lit(":L"), "line_start", F.lit("-L"), "line_end").alias("ref"))


def node_body(responsibility, entries, interfaces):
    """What a module does, where it is entered and what it offers."""
    more = F.when(F.size(interfaces) > 3, F.concat(F.lit(" 等 "), F.size(interfaces), F.lit(" 个"))).otherwise("")
    return F.concat_ws(
        "。",
        F.nullif(responsibility, F.lit("")),
        F.when(F.size(entries) > 0, F.concat(F.lit("入口: "), F.array_join(F.slice(entries, 1, 3), ", "))),
        F.when(F.size(interfaces) > 0, F.concat(F.lit("对外接口: "), F.array_join(F.slice(interfaces, 1, 3), ", "), more)),
    )


def function_summaries(results: DataFrame, members: DataFrame) -> DataFrame:
    """(module, code_name, business_name, explanation, file_path, line_start, params, return_type)."""
    f = results.select("file_path", F.explode("functions").alias("f")).join(members.select(F.col("name").alias("module"), F.col("file").alias("file_path")), "file_path")
    return f.select("module", F.col("f.name").alias("code_name"), naming.business_name(F.col("f.name")).alias("business_name"), naming.function_explanation(F.col("f.name"), F.col("f.params"), F.col("f.return_type"), F.col("f.docstring")).alias("explanation"), "file_path", F.col("f.line_start").alias("line_start"), F.col("f.params").alias("params"), F.col("f.return_type").alias("return_type"))


def module_summaries(modules: DataFrame, results: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, code_path, business_name, description, health, depends_on, used_by) of modules that aren't special.
    depends_on: what a module calls."""
    members = modules.filter("not is_special").select("name", F.posexplode("files").alias("k", "file_path"))
    facts = members.join(results.select("file_path", "functions", "classes"), "file_path", "left")
    agg = facts.groupBy("name").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", F.expr("transform(functions, f -> f.name)").alias("f")))), lambda x: F.coalesce(x.f, F.array().cast("array<string>")))).alias("f"), F.coalesce(F.sum(F.size("classes")), F.lit(0)).alias("c"))
    near = graph.adjacency(modules, edges)
    out = modules.filter("not is_special").join(agg, "name", "left").join(near, "name")
    return out.select("name", F.col("dir_path").alias("code_path"), naming.business_name(F.col("dir_path")).alias("business_name"), naming.module_description(F.col("name"), F.coalesce("f", F.array().cast("array<string>")), F.coalesce("c", F.lit(0)), F.size("files"), F.col("total_lines")).alias("description"), graph.size_health(F.col("total_lines")).alias("health"), F.col("downstream").alias("depends_on"), F.col("upstream").alias("used_by"))


def connections(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_module, to_module, verb, call_count) between modules that aren't special."""
    plain = modules.filter("not is_special").select("name")
    e = edges.join(plain.withColumnRenamed("name", "src"), "src", "left_semi").join(plain.withColumnRenamed("name", "dst"), "dst", "left_semi")
    return e.select(F.col("src").alias("from_module"), F.col("dst").alias("to_module"), naming.connection_verb(F.col("dst")).alias("verb"), "call_count")


def rule_summary(project: str, modules: DataFrame, results: DataFrame, edges: DataFrame, flows: list[dict] | None = None) -> dict:
    """The whole summary as one object: a report's size."""
    members = modules.filter("not is_special").select("name", F.explode("files").alias("file"))
    functions: dict[str, list[dict]] = {}
    for r in function_summaries(results, members).orderBy("module", "file_path", "line_start").toLocalIterator():
        functions.setdefault(r["module"], []).append({k: v for k, v in r.asDict().items() if k != "module"})
    mods = [{**{k: v for k, v in m.asDict().items() if k != "name"}, "functions": functions.get(m["name"], [])} for m in module_summaries(modules, results, edges).orderBy("name").collect()]
    return {"project_name": project, "project_description": f"{project} 项目蓝图（规则降级）", "modules": mods, "connections": [c.asDict() for c in connections(modules, edges).collect()], "flows": flows or []}


_FUNCTION = ("code_name", "business_name", "explanation", "file_path", "line_start")


def read_summary(answer: object, fallback) -> dict:
    """A model's summary with what may be missing filled in; fallback() where it isn't one."""
    try:
        out = {"project_name": answer["project_name"], "project_description": answer["project_description"], "modules": [], "connections": [], "flows": []}
        for m in answer["modules"]:
            own = [{**{k: f[k] for k in _FUNCTION}, "params": f.get("params", []), "return_type": f.get("return_type")} for f in m.get("functions", [])]
            out["modules"].append({**{k: m[k] for k in ("code_path", "business_name", "description")}, "health": m.get("health", "green"), "functions": own, "depends_on": m.get("depends_on", []), "used_by": m.get("used_by", [])})
        for c in answer.get("connections", []):
            out["connections"].append({"from_module": c.get("from", c.get("from_module", "")), "to_module": c.get("to", c.get("to_module", "")), "verb": c["verb"], "call_count": c.get("call_count", 0)})
        out["flows"] = [{"name": f.get("name", ""), "description": f.get("description", ""), "steps": f.get("steps", [])} for f in answer.get("flows", [])]
        return out
    except (KeyError, TypeError, AttributeError):
        return fallback()


def fill(template: str, **values: object) -> str:
    """Known names in braces are replaced; other braces stay."""
    for k, v in values.items():
        template = template.replace("{" + k + "}", str(v))
    return template


#: Templates of prompts by level, (system, user); a caller may pass its own, as read from a file.
TEMPLATES = {
    "L1": ("用一段话说明这个项目做什么、给谁用、由哪些部分组成。只依据给出的内容。\n{guidance}", "目录：\n{file_tree}\n\n语言：{language_stats}\n\n入口文件：\n{entry_file_content}"),
    "L2": ("逐个模块说明它负责什么、从哪里进入、和谁往来。\n{guidance}\n不要使用以下术语，改用右边的说法：\n{banned_terms}", "项目：{project_summary}\n\n模块：\n{module_groups}\n\n依赖：\n{dependency_edges}\n\n函数：\n{module_functions}"),
    "L3": ("说明这个模块：用途、流程、入口、风险，并给出代码位置。状态码第一次出现时附上说明：\n{http_status_annotations}\n{guidance}\n不要使用以下术语，改用右边的说法：\n{banned_terms}", "模块：{module_name}\n{module_info}\n\n源代码：\n{source_code}\n\n解析结果：\n{parse_result}\n\n上游：{upstream}\n下游：{downstream}"),
    "L4": ("说明这段函数做什么：输入、输出、步骤与边界条件。\n{guidance}", "{module_name}\n{source_code}"),
}
# Fixed: names of files where a program starts, the first that there is.
ENTRY_FILES = ("main.py", "app.py", "index.ts", "index.js", "server.py", "app/__init__.py")


def entry_file(files: DataFrame, lines: int = 100) -> DataFrame:
    """(path, content): the first of ENTRY_FILES, in order of these and then of files, cut to some lines; no row without."""
    place = F.lit(None).cast("int")
    for k, name in reversed(list(enumerate(ENTRY_FILES))):
        place = F.when(F.col("path").endswith(name), k).otherwise(place)
    cut = F.array_join(F.slice(F.split("content", "\n"), 1, lines), "\n")
    return files.withColumn("k", place).filter("k is not null").orderBy("k", "ord").limit(1).select("path", cut.alias("content"))


def module_lines(modules: DataFrame) -> DataFrame:
    """(ord, line): a module as a line of text, with up to five of its entries and interfaces."""
    def some(column: str, title: str):
        return F.when(F.size(column) > 0, F.concat(F.lit(f"\n  {title}: "), F.array_join(F.slice(column, 1, 5), ", "))).otherwise("")

    special = F.when(F.col("is_special"), " [特殊模块]").otherwise("")
    head = F.concat(F.lit("- "), "name", special, F.lit(": "), F.size("files").cast("string"), F.lit(" 文件, "), F.col("total_lines").cast("string"), F.lit(" 行"))
    return modules.select("ord", F.concat(head, some("entry_functions", "入口函数"), some("public_interfaces", "公开接口")).alias("line"))


def edge_lines(edges: DataFrame) -> DataFrame:
    """(src, dst, line): a link between modules as a line of text."""
    word = F.when(graph.strength(F.col("call_count")) == "strong", "强").otherwise("弱")
    return edges.select("src", "dst", F.concat(F.lit("- "), "src", F.lit(" → "), "dst", F.lit(" ("), F.col("call_count").cast("string"), F.lit(" 次, "), word, F.lit("依赖)")).alias("line"))


def prompt(level: str, templates: dict[str, tuple[str, str]] = TEMPLATES, **values: object) -> tuple[str, str]:
    system, user = templates[level]
    return fill(system, **values), fill(user, **values)


def load_config(paths: list[str], built_in: dict) -> dict:
    """The first of several configuration files that is an object; else the built-in one."""
    from ..sources.store import read_json

    return next((c for c in map(read_json, paths) if c), built_in)


def summary_prompt(rule: dict) -> str:
    """What a model needs to write the summary: the rules' one, to be improved on."""
    return "Improve names and descriptions; keep code_path, code_name and the structure; answer with JSON only.\n" + json.dumps(rule, ensure_ascii=False)
