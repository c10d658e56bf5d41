"""Name resolution: from extracted facts to nodes and edges, as equi-joins and minima over `ord`.

functions: file, ord, name, parent_class, is_method, line_start, line_end.  classes: file, ord, name, line_start,
line_end.  imports: file, ord, module, names.  calls: file, ord, caller_func, callee_name.  files: file, ord.
`ord` of a fact is its place within its file; that of a file, its place in the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import aggregate_calls, node_id

#: Fixed: what module paths are cut of.
SUFFIXES = (".py", ".js", ".ts", ".jsx", ".tsx", ".go", ".rs", ".java")
MODULE = "<module>"
#: A node's order: its file's place, then its own within so many bits.
FILE_BITS = 24


def _place(facts: DataFrame, files: DataFrame) -> DataFrame:
    return facts.join(files.select("file", F.col("ord").alias("file_ord")), "file")


def definitions(functions: DataFrame, classes: DataFrame, files: DataFrame) -> DataFrame:
    """(node_id, file, name, parent_class, node_type, line_start, line_end, seq): all definitions in order of scan;
    within a file functions come before classes."""
    f = _place(functions, files).select(node_id(F.col("file"), F.col("name"), F.col("parent_class")).alias("node_id"), "file", "name", "parent_class", F.when(F.col("is_method"), "method").otherwise("function").alias("node_type"), "line_start", "line_end", F.struct("file_ord", F.lit(0).alias("kind"), "ord").alias("seq"))
    c = _place(classes, files).select(node_id(F.col("file"), F.col("name")).alias("node_id"), "file", "name", F.lit(None).cast("string").alias("parent_class"), F.lit("class").alias("node_type"), "line_start", "line_end", F.struct("file_ord", F.lit(1).alias("kind"), "ord").alias("seq"))
    return f.unionByName(c)


def nodes_of(defs: DataFrame) -> DataFrame:
    """One node per id: it stands where it was first defined and is what it was last defined as."""
    last = F.max_by(F.struct("file", "line_start", "line_end", "node_type", F.col("name").alias("label")), "seq").alias("x")
    out = defs.groupBy("node_id").agg(F.min("seq").alias("seq"), last)
    return out.select("node_id", "x.*", "seq")


def method_index(defs: DataFrame) -> DataFrame:
    """(file, name, node_id): of classes in a file with a method of one name, that whose entry was made last."""
    entry = defs.filter("parent_class is not null").groupBy("file", "parent_class", "name", "node_id").agg(F.min("seq").alias("seq"))
    return entry.groupBy("file", "name").agg(F.max_by("node_id", "seq").alias("node_id"))


def module_index(files: DataFrame) -> DataFrame:
    """(module, target): a file's path and dotted path always count, the last one of either; its last segment only
    where nothing else has the name, the first one."""
    dotted = F.regexp_replace("file", r"[/\\]", ".")
    cut = dotted
    for suffix in reversed(SUFFIXES):
        cut = F.when(dotted.endswith(suffix), F.substring(dotted, F.lit(1), F.length(dotted) - len(suffix))).otherwise(cut)
    f = files.select("file", "ord", cut.alias("dotted"))
    full = f.select(F.explode(F.array("file", "dotted")).alias("module"), "file", "ord", F.lit(True).alias("full"))
    short = f.filter("instr(dotted, '.') > 0").select(F.element_at(F.split("dotted", r"\."), -1).alias("module"), "file", "ord", F.lit(False).alias("full"))
    agg = full.unionByName(short).groupBy("module").agg(F.max_by("file", F.when(F.col("full"), F.col("ord"))).alias("last_full"), F.min_by("file", F.when(~F.col("full"), F.col("ord"))).alias("first_short"))
    return agg.select("module", F.coalesce("last_full", "first_short").alias("target"))


def name_index(defs: DataFrame) -> DataFrame:
    """(name, first_file, first_id, other_id): the first definition of a name and the first in another file, so a
    caller of either file finds its own without meeting all candidates."""
    first = defs.groupBy("name").agg(F.min_by(F.struct(F.col("file").alias("first_file"), F.col("node_id").alias("first_id")), "seq").alias("a"))
    other = defs.join(first, "name").filter("file != a.first_file").groupBy("name").agg(F.min_by("node_id", "seq").alias("other_id"))
    return first.join(other, "name", "left").select("name", "a.*", "other_id")


def resolve_callers(calls: DataFrame, defs: DataFrame, classes: DataFrame) -> DataFrame:
    """calls with src: the module, a definition of the name, the first class's method of the name, or the module."""
    ids = defs.select("node_id").distinct()
    direct = calls.withColumn("want", node_id(F.col("file"), F.col("caller_func"))).join(ids.withColumnRenamed("node_id", "want"), "want", "left_semi").select("file", "caller_func", F.col("want").alias("direct")).distinct()
    # the order of classes is that of their own definitions
    methods = defs.filter("parent_class is not null").select("file", F.col("parent_class").alias("cls"), F.col("name").alias("caller_func"), "node_id").distinct()
    rank = classes.groupBy("file", F.col("name").alias("cls")).agg(F.min("ord").alias("cls_ord"))
    by_class = methods.join(rank, ["file", "cls"]).groupBy("file", "caller_func").agg(F.min_by("node_id", "cls_ord").alias("by_class"))
    out = calls.join(direct, ["file", "caller_func"], "left").join(by_class, ["file", "caller_func"], "left")
    module = node_id(F.col("file"), F.lit(MODULE))
    return out.withColumn("src", F.when(F.col("caller_func") == MODULE, module).otherwise(F.coalesce("direct", "by_class", module))).drop("direct", "by_class")


def resolve_callees(calls: DataFrame, defs: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """calls with dst and tier: 1 this file's definition, 2 this file's method, 3 what an import leads to, in order
    of imports, 4 the first definition of the name in another file."""
    ids = defs.select(F.col("file"), F.col("node_id")).distinct().select("node_id", F.lit(True).alias("known"))
    methods = method_index(defs)
    c = calls.withColumn("want", node_id(F.col("file"), F.col("callee_name")))
    c = c.join(ids.select(F.col("node_id").alias("want"), F.col("known").alias("t1")), "want", "left")
    c = c.join(methods.select("file", F.col("name").alias("callee_name"), F.col("node_id").alias("t2")), ["file", "callee_name"], "left")
    # What each import offers is worked out once per file and name, not once per call.
    offers = imports.select("file", "ord", "module", F.explode(F.array_distinct(F.concat("names", F.array(F.element_at(F.split("module", r"\."), -1))))).alias("callee_name"))
    offers = offers.join(calls.select("file", "callee_name").distinct(), ["file", "callee_name"], "left_semi").join(module_index(files), "module")
    offers = offers.withColumn("goal", node_id(F.col("target"), F.col("callee_name"))).join(ids.select(F.col("node_id").alias("goal"), "known"), "goal", "left")
    offers = offers.join(methods.select(F.col("file").alias("target"), F.col("name").alias("callee_name"), F.col("node_id").alias("method")), ["target", "callee_name"], "left")
    hit = F.when(F.col("known"), F.col("goal")).otherwise(F.col("method"))
    by_import = offers.withColumn("hit", hit).filter("hit is not null").groupBy("file", "callee_name").agg(F.min_by("hit", "ord").alias("t3"))
    c = c.join(by_import, ["file", "callee_name"], "left")
    c = c.join(name_index(defs).withColumnRenamed("name", "callee_name"), "callee_name", "left")
    t4 = F.when(F.col("first_file") != F.col("file"), F.col("first_id")).otherwise(F.col("other_id"))
    found = [F.when(F.col("t1"), F.col("want")), F.col("t2"), F.col("t3"), t4]
    tier = F.when(found[0].isNotNull(), 1).when(found[1].isNotNull(), 2).when(found[2].isNotNull(), 3).when(found[3].isNotNull(), 4)
    return c.withColumn("dst", F.coalesce(*found)).withColumn("tier", tier).drop("want", "t1", "t2", "t3", "first_file", "first_id", "other_id")


def resolved_calls(files: DataFrame, defs: DataFrame, classes: DataFrame, imports: DataFrame, calls: DataFrame) -> DataFrame:
    """(file, ord, caller_func, callee_name, src, dst, tier): calls with both ends, dst null where nothing has the name."""
    return resolve_callees(resolve_callers(calls, defs, classes), defs, imports, files).select("file", "ord", "caller_func", "callee_name", "src", "dst", "tier")


def edges_of(resolved: DataFrame, files: DataFrame) -> DataFrame:
    placed = resolved.join(files.select("file", F.col("ord").alias("file_ord")), "file")
    return aggregate_calls(placed.select("src", "dst", "callee_name", F.struct("file_ord", "ord").alias("ord")))


def graph_nodes(files: DataFrame, defs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Nodes of definitions, and files' own nodes where a call starts from them."""
    kind = defs.schema["seq"].dataType["ord"].dataType
    starts = resolved.filter(F.col("src") == node_id(F.col("file"), F.lit(MODULE))).select("src", "file").distinct().join(files.select("file", F.col("ord").alias("file_ord")), "file")
    from_module = starts.select(F.col("src").alias("node_id"), "file", F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), F.lit("module").alias("node_type"), F.lit(MODULE).alias("label"), F.struct("file_ord", F.lit(2).alias("kind"), F.lit(0).cast(kind).alias("ord")).alias("seq"))
    nodes = nodes_of(defs).unionByName(from_module)
    # A dense order would need all nodes in one task; seq orders them as well, packed into one number.
    return nodes.withColumn("ord", F.shiftleft(F.col("seq.file_ord").cast("long"), FILE_BITS) + F.shiftleft(F.col("seq.kind").cast("long"), 22) + F.col("seq.ord")).drop("seq")


def build_graph(files: DataFrame, functions: DataFrame, classes: DataFrame, imports: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of extracted facts."""
    defs = definitions(functions, classes, files)
    resolved = resolved_calls(files, defs, classes, imports, calls)
    return graph_nodes(files, defs, resolved), edges_of(resolved, files)


def assign_modules(nodes: DataFrame, module_files: DataFrame) -> DataFrame:
    """nodes with module_group from (name, file); of modules that share a file, the last in order counts."""
    bridge = module_files.groupBy("file").agg(F.max_by("name", "ord").alias("module_group"))
    return nodes.drop("module_group").join(bridge, "file", "left").fillna("", ["module_group"])

