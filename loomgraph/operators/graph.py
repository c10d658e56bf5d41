"""Call-graph operators on DataFrames.

nodes: node_id, file, line_start, line_end, module_group, node_type, label, ord.  edges: src, dst, data_label,
call_count, is_critical_path.  module edges: src, dst, call_count.  `ord` carries every "first one wins" rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled

#: Fixed: what a call does by its name; the first that the name holds.
DATA_LABELS = (
    ("查询数据", ("get",)),
    ("创建数据", ("create", "add")),
    ("更新数据", ("update", "set")),
    ("删除数据", ("delete", "remove")),
    ("校验", ("check", "verify", "validate")),
    ("发送", ("send", "emit")),
)
CRITICAL_CALLS, HEAVY_CALLS, OVERVIEW_NODES, OTHERS = 3, 5, 30, "其他"


def node_id(file: Column, name: Column, parent: Column | None = None) -> Column:
    """file::name, or file::Parent.name for a method."""
    full = name if parent is None else F.when(parent.isNull(), name).otherwise(F.concat_ws(".", parent, name))
    return F.concat_ws("::", file, full)


def data_label(name: Column) -> Column:
    low, out = F.lower(name), None
    for label, marks in DATA_LABELS:
        hit = F.lit(False)
        for m in marks:
            hit = hit | low.contains(m)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("")


def aggregate_calls(calls: DataFrame) -> DataFrame:
    """calls (src, dst, callee_name, ord) -> edges. Self-calls and unresolved ends go; the first call gives the label."""
    kept = calls.filter("src is not null and dst is not null and src != dst")
    out = kept.groupBy("src", "dst").agg(F.count("*").alias("call_count"), F.min_by(data_label(F.col("callee_name")), "ord").alias("data_label"))
    return out.select("src", "dst", "data_label", "call_count", (F.col("call_count") >= CRITICAL_CALLS).alias("is_critical_path"))


def module_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls between modules, summed."""
    group = nodes.filter("module_group != ''").select("node_id", "module_group")
    joined = edges.join(group.select(F.col("node_id").alias("src"), F.col("module_group").alias("m_src")), "src").join(group.select(F.col("node_id").alias("dst"), F.col("module_group").alias("m_dst")), "dst")
    return joined.filter("m_src != m_dst").groupBy(F.col("m_src").alias("src"), F.col("m_dst").alias("dst")).agg(F.sum("call_count").alias("call_count"))


def modules_of(nodes: DataFrame) -> DataFrame:
    """(name, ord): modules with a node, isolated ones too, in order of first appearance."""
    return nodes.filter("module_group != ''").groupBy(F.col("module_group").alias("name")).agg(F.min("ord").alias("ord"))


def top_of(name: Column) -> Column:
    return F.split_part(name, F.lit("/"), F.lit(1))


def super_groups(modules: DataFrame) -> DataFrame:
    """(group, modules (sorted array), n, ord) by top directory."""
    return modules.groupBy(top_of(F.col("name")).alias("group")).agg(F.array_sort(F.collect_list("name")).alias("modules"), F.count("*").alias("n"), F.min("ord").alias("ord"))


def expandable_groups(nodes: DataFrame) -> DataFrame:
    """Groups of several modules: their number, files, and lines over all nodes."""
    grouped = nodes.filter("module_group != ''").withColumn("group", top_of(F.col("module_group")))
    out = grouped.groupBy("group").agg(F.countDistinct("module_group").alias("sub_modules"), F.countDistinct(F.when(F.col("file") != "", F.col("file"))).alias("total_files"), F.sum(F.col("line_end") - F.col("line_start")).cast("long").alias("total_lines"))
    return out.filter("sub_modules > 1")


def overview_groups(modules: DataFrame, max_nodes: int = OVERVIEW_NODES) -> DataFrame:
    """(name, group): the module itself while they are few; else its top directory, the smallest ones merged."""
    max_nodes = max(1, max_nodes)
    tops = super_groups(modules).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "ord")))  # a row per top directory
    counts = tops.agg(F.sum("n").alias("all_modules"), F.count("*").alias("all_tops"))
    named = modules.withColumn("group", top_of(F.col("name"))).join(tops.select("group", "rank"), "group").crossJoin(F.broadcast(counts))
    over = (F.col("all_tops") > max_nodes) & (F.col("rank") > max_nodes - 1)
    return named.select("name", F.when(F.col("all_modules") <= max_nodes, F.col("name")).when(over, OTHERS).otherwise(F.col("group")).alias("group"), "ord")


def overview_edges(modules: DataFrame, edges: DataFrame, max_nodes: int = OVERVIEW_NODES) -> DataFrame:
    """(src, dst, call_count, heavy) between what overview_groups() shows."""
    group = overview_groups(modules, max_nodes).select("name", "group")
    j = edges.join(group.withColumnsRenamed({"name": "src", "group": "g_src"}), "src").join(group.withColumnsRenamed({"name": "dst", "group": "g_dst"}), "dst")
    out = j.filter("g_src != g_dst").groupBy(F.col("g_src").alias("src"), F.col("g_dst").alias("dst")).agg(F.sum("call_count").alias("call_count"))
    return out.withColumn("heavy", F.col("call_count") >= HEAVY_CALLS)


def focus_edges(edges: DataFrame, focus: str) -> DataFrame:
    """(src, dst, call_count, kind): edges inside a group as they are, others with their outer end's top directory."""
    s, d = top_of(F.col("src")) == focus, top_of(F.col("dst")) == focus
    kept = edges.filter(s | d).select(F.when(s, F.col("src")).otherwise(top_of(F.col("src"))).alias("src"), F.when(d, F.col("dst")).otherwise(top_of(F.col("dst"))).alias("dst"), "call_count", F.when(s & d, "inner").otherwise("outer").alias("kind"))
    return kept.groupBy("src", "dst", "kind").agg(F.sum("call_count").alias("call_count"))


def upstream(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter(F.col("dst") == node).select(F.col("src").alias("node_id")).distinct()


def downstream(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter(F.col("src") == node).select(F.col("dst").alias("node_id")).distinct()


def adjacency(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, upstream, downstream): sorted arrays, empty for isolated modules."""
    up = edges.groupBy(F.col("dst").alias("name")).agg(F.array_sort(F.collect_set("src")).alias("upstream"))
    down = edges.groupBy(F.col("src").alias("name")).agg(F.array_sort(F.collect_set("dst")).alias("downstream"))
    none = F.array().cast("array<string>")
    return modules.select("name").join(up, "name", "left").join(down, "name", "left").select("name", F.coalesce("upstream", none).alias("upstream"), F.coalesce("downstream", none).alias("downstream"))


def _steps(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(root, node_id, depth) over walks: a node may come again at another depth; each depth lists it once."""
    out, front = None, start.select(F.col("node_id").alias("root"), "node_id")
    for d in range(1, depth + 1):
        front = front.join(edges.select(F.col("src").alias("node_id"), F.col("dst").alias("next")), "node_id").select("root", F.col("next").alias("node_id")).distinct()
        found = front.withColumn("depth", F.lit(d))
        out = found if out is None else out.unionByName(found)
    return out


def call_chains(nodes: DataFrame, edges: DataFrame, module: str, depth: int = 2) -> DataFrame:
    """Functions of a module with callers and callees up to `depth` steps, as module/label, nearest first, then by
    name. Walks aren't pruned: in a cycle a function lists itself."""
    own = nodes.filter((F.col("module_group") == module) & (F.col("node_type") != "module"))
    shown = nodes.select("node_id", F.when(F.col("module_group") != "", F.concat_ws("/", "module_group", "label")).otherwise(F.col("label")).alias("display"))

    def names(e: DataFrame, column: str) -> DataFrame:
        found = _steps(e, own, depth).join(shown, "node_id").groupBy("root", "display").agg(F.min("depth").alias("depth"))
        ordered = found.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("depth", "display"))).alias("x"))
        return ordered.select(F.col("root").alias("node_id"), F.expr("transform(x, y -> y.display)").alias(column))

    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    none = F.array().cast("array<string>")
    out = own.join(names(back, "callers"), "node_id", "left").join(names(edges, "callees"), "node_id", "left")
    return out.select("node_id", F.col("label").alias("function"), "file", "line_start", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"))


#: Up to so many rows a frontier, or all that was seen, is sent to where the edges lie; more are met by shuffles.
BROADCAST_FRONT = 50_000


def _walk(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(direction, node_id, ord, depth, parent): each node once for each direction, at its least depth, under the parent
    that comes first in order. edges: src, dst, src_ord, dst_ord; seeds: node_id, ord.

    A step takes both directions at once. What it finds is written and counted, so no step is computed again, the next
    one knows whether to send it or to shuffle, and the walk ends where nothing new is found.
    """
    ways = F.explode(F.array(F.lit("upstream"), F.lit("downstream"))).alias("direction")
    front = seen = settled(seeds.select(ways, "node_id", "ord").distinct(), "walk")
    n = n_seen = front.count()
    out = seeds.select(F.lit("").alias("direction"), "node_id", "ord", F.lit(0).alias("depth"), F.lit("").alias("parent")).limit(0)
    for d in range(1, depth + 1):
        if not n:
            break
        at = F.broadcast(front) if n <= BROADCAST_FRONT else front
        known = F.broadcast(seen) if n_seen <= BROADCAST_FRONT else seen
        steps = None
        for way, here, there in (("upstream", "dst", "src"), ("downstream", "src", "dst")):
            own = at.filter(F.col("direction") == way).select("direction", F.col("node_id").alias(here), F.col("ord").alias("parent_ord"))
            step = edges.join(own, here).select("direction", F.col(there).alias("node_id"), F.col(f"{there}_ord").alias("ord"), F.col(here).alias("parent"), "parent_ord")
            steps = step if steps is None else steps.unionByName(step)
        new = steps.join(known.select("direction", "node_id"), ["direction", "node_id"], "left_anti")
        found = new.groupBy("direction", "node_id").agg(F.min("ord").alias("ord"), F.min_by("parent", F.struct("parent_ord", "parent")).alias("parent"))
        front = settled(found.select("direction", "node_id", "ord", F.lit(d).alias("depth"), "parent"), "walk")
        out = out.unionByName(front)
        n = front.count()
        seen, n_seen = seen.unionByName(front.select("direction", "node_id", "ord")), n_seen + n
    return out


def trace(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 3, cap: int = 30) -> tuple[DataFrame, DataFrame]:
    """(found, links). found: node_id, direction (seed, upstream, downstream), depth; links: src, dst.

    Callers are followed first, so a node reached both ways is upstream. Of all found, seeds stay and others by
    direction, depth and ord as far as `cap` goes (a fixed rule, where a queue would overshoot by chance). Links are
    those by which nodes were found and those between seeds. Edges, with the order of their ends, are written once.
    """
    order = nodes.select("node_id", F.coalesce("ord", F.lit(0)).alias("ord"))
    placed = edges.select("src", "dst")
    for end in ("src", "dst"):
        placed = placed.join(order.withColumnsRenamed({"node_id": end, "ord": f"{end}_ord"}), end, "left").fillna(0, [f"{end}_ord"])
    placed = settled(placed.select("src", "dst", "src_ord", "dst_ord"), "trace-edges")
    seeds = settled(seeds.select("node_id").join(order, "node_id", "left").select("node_id", F.coalesce("ord", F.lit(0)).alias("ord")), "trace-seeds")
    root = seeds.select(F.lit("seed").alias("direction"), "node_id", "ord", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"))
    rank = F.when(F.col("direction") == "seed", 0).when(F.col("direction") == "upstream", 1).otherwise(2)
    first = F.min_by(F.struct("direction", "depth", "parent", "ord"), rank).alias("x")
    every = root.unionByName(_walk(placed, seeds, depth)).groupBy("node_id").agg(first).select("node_id", "x.*")
    # TakeOrderedAndProject: each task sends `cap` rows at most
    kept = every.orderBy(rank, "depth", "ord", "node_id").limit(cap)
    kept = settled(root.select("node_id", "direction", "depth", "parent").unionByName(kept.select("node_id", "direction", "depth", "parent")).dropDuplicates(["node_id"]), "trace-found")
    by_tree = kept.filter("parent is not null").select(F.when(F.col("direction") == "upstream", F.col("node_id")).otherwise(F.col("parent")).alias("src"), F.when(F.col("direction") == "upstream", F.col("parent")).otherwise(F.col("node_id")).alias("dst"))
    s = seeds.select("node_id").distinct()
    between = placed.select("src", "dst").join(s.withColumnRenamed("node_id", "src"), "src", "left_semi").join(s.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select("src", "dst")
    return kept.select("node_id", "direction", "depth"), by_tree.unionByName(between).distinct()


def neighbours(edges: DataFrame, start: str, hops: int = 1) -> DataFrame:
    """(name, direction, depth): modules up to `hops` steps away, the start itself left out; least depth of each."""
    s = edges.select(F.lit(start).alias("node_id")).limit(1)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = _steps(back, s, hops).withColumn("direction", F.lit("upstream")).unionByName(_steps(edges, s, hops).withColumn("direction", F.lit("downstream")))
    return both.filter(F.col("node_id") != start).groupBy(F.col("node_id").alias("name"), "direction").agg(F.min("depth").alias("depth"))


def hub_scores(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, n_in, n_out, score): twice the modules that call it and those that it calls."""
    i = edges.groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("n_in"))
    o = edges.groupBy(F.col("src").alias("name")).agg(F.count("*").alias("n_out"))
    out = modules.select("name", "ord").join(i, "name", "left").join(o, "name", "left").fillna(0, ["n_in", "n_out"])
    return out.withColumn("score", F.col("n_in") * 2 + F.col("n_out"))


def core_and_rest(modules: DataFrame, edges: DataFrame, top: int = 8) -> tuple[DataFrame, DataFrame]:
    """(places, links). With more than `top` modules the best hubs stay and others fall to their top directory's
    group; a core and a group are linked once, groups with each other never."""
    ranked = hub_scores(modules, edges).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ord", "name")))  # a row per module
    few = modules.agg((F.count("*") <= top).alias("few"))
    places = ranked.crossJoin(F.broadcast(few)).select("name", (F.col("few") | (F.col("rank") <= top)).alias("core")).withColumn("place", F.when(F.col("core"), F.col("name")).otherwise(F.concat(F.lit("group:"), top_of(F.col("name")))))
    j = edges.join(places.select(F.col("name").alias("src"), F.col("place").alias("p_src"), F.col("core").alias("c_src")), "src").join(places.select(F.col("name").alias("dst"), F.col("place").alias("p_dst"), F.col("core").alias("c_dst")), "dst")
    links = j.filter("c_src or c_dst").groupBy(F.col("p_src").alias("src"), F.col("p_dst").alias("dst")).agg(F.when(F.bool_and(F.col("c_src") & F.col("c_dst")), F.sum("call_count")).otherwise(F.lit(1).cast("long")).alias("call_count"))
    return places, links


def cross_module_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, calls_out, calls_in): call edges of each module's functions that leave or enter it."""
    g = nodes.select("node_id", "module_group")
    j = edges.join(g.select(F.col("node_id").alias("src"), F.col("module_group").alias("a")), "src").join(g.select(F.col("node_id").alias("dst"), F.col("module_group").alias("b")), "dst").filter("a != b")
    both = j.select(F.col("a").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(j.select(F.col("b").alias("name"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.filter("name != ''").groupBy("name").agg(F.sum("o").alias("calls_out"), F.sum("i").alias("calls_in"))


def strength(count: Column) -> Column:
    return F.when(count >= HEAVY_CALLS, "strong").otherwise("weak")


def call_label(count: Column) -> Column:
    return F.concat(F.lit("调用 "), count.cast("string"), F.lit(" 次"))


def size_health(lines: Column) -> Column:
    return F.when(lines > 3000, "red").when(lines > 1000, "yellow").otherwise("green")


def score_health(score: Column) -> Column:
    return F.when(score >= 0.7, "green").when(score >= 0.4, "yellow").otherwise("red")


def layers(names: list[str], links: list[tuple[str, str]]) -> dict[str, int]:
    """Topological layers with callees left: for the few places of a picture, so on the driver. What stands on a
    cycle shares the last layer."""
    waits = {n: {b for a, b in links if a == n and b != n and b in set(names)} for n in names}
    out, level = {}, 0
    while waits:
        free = [n for n, w in waits.items() if not (w - out.keys())]
        if not free:
            out |= dict.fromkeys(waits, level)
            break
        out |= dict.fromkeys(free, level)
        for n in free:
            del waits[n]
        level += 1
    return out


def grid(names: list[str], links: list[tuple[str, str]], width: int = 220, height: int = 80) -> dict[str, tuple[float, float]]:
    at, seen = layers(names, links), {}
    return {n: (float(at[n] * width), float((seen.__setitem__(at[n], seen.get(at[n], -1) + 1) or seen[at[n]]) * height)) for n in names}
