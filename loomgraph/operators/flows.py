"""Business flows: entries, simple paths from them, their scores, and the few that show most."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import naming
from ..sources.shared import settled

#: Fixed: names and beginnings of names of entry points.
ENTRY_NAMES = ("main", "app", "run", "start", "serve", "execute", "cli", "entrypoint", "entry_point", "bootstrap", "launch", "init", "initialize", "setup")
ENTRY_PREFIXES = ("handle", "process", "dispatch", "on_", "route")
MAX_DEPTH, MAX_FLOWS, LEAST_NODES, MOST_OVERLAP = 15, 5, 3, 0.7

def _by_name(label):
    low = F.lower(label)
    hit = low.isin(*ENTRY_NAMES)
    for p in ENTRY_PREFIXES:
        hit = hit | low.startswith(p)
    return hit


def entry_nodes(nodes: DataFrame, edges: DataFrame, entry_names: DataFrame | None = None) -> DataFrame:
    """(node_id): those with a module's entry name (whatever file), functions and methods that nothing calls, and
    those named like an entry; files' own nodes aside."""
    plain = nodes.filter("node_id not like '%<module>%'")
    funcs = plain.filter(F.col("node_type").isin("function", "method"))
    free = funcs.join(edges.select(F.col("dst").alias("node_id")).distinct(), "node_id", "left_anti").select("node_id")
    out = free.unionByName(funcs.filter(_by_name(F.col("label"))).select("node_id"))
    if entry_names is not None:
        out = out.unionByName(plain.join(entry_names.select(F.col("name").alias("label")), "label", "left_semi").select("node_id"))
    return out.distinct()


def simple_paths(entries: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH, most: int | None = None) -> DataFrame:
    """(path (array)): cycle-free paths from entries that can't go on or are max_depth steps long, two nodes at least.

    One join per step; each step is written, so none is computed again, and it ends when no path goes on. Enumeration
    is exponential: `most` bounds the paths of one length, and beyond it this raises instead of leaving any out.
    """
    steps = settled(edges.select(F.col("src").alias("last"), F.col("dst").alias("next")), "path-steps")
    live = entries.select(F.array("node_id").alias("path"), F.col("node_id").alias("last"))
    done = None
    for d in range(max_depth):
        on = live.join(steps, "last").filter(~F.array_contains("path", F.col("next")))
        longer = settled(on.select(F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("last")), "path-longer")
        n = longer.count()
        if most is not None and n > most:
            raise ValueError(f"{n} paths of {d + 1} steps: more than {most}; lower the depth or thin the graph")
        if d:
            began = longer.select(F.expr("slice(path, 1, size(path) - 1)").alias("path")).distinct()
            ended = live.join(began, "path", "left_anti").select("path")
            done = ended if done is None else done.unionByName(ended)
        live = longer
        if not n:
            break
    last = live.select("path")
    return last if done is None else done.unionByName(last)


def _steps_to(ends: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(node_id, steps): the fewest steps in which each node comes to one of ends (node_id), up to `most`."""
    calls = edges.select("src", "dst")
    front = settled(ends.select("node_id", F.lit(0).alias("steps")).distinct(), "path-near")
    out = front
    for k in range(1, most + 1):
        to = calls.join(front.select(F.col("node_id").alias("dst")), "dst").select(F.col("src").alias("node_id")).distinct()
        front = settled(to.join(out, "node_id", "left_anti").withColumn("steps", F.lit(k)), "path-near")
        out = out.unionByName(front)
    return settled(out, "path-near")


def paths_through(entries: DataFrame, edges: DataFrame, through: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(path (array)): of simple_paths() all that have one of the nodes in through (node_id), and no others are listed.

    A partial path without such a node goes on only while one is in reach of the steps that are left; with one it goes on
    whatever follows. So what is written grows with the result, not with all paths.
    """
    calls = settled(edges.select(F.col("src").alias("last"), F.col("dst").alias("next")), "path-steps")
    near = _steps_to(through, edges, max_depth)
    live = entries.select("node_id").distinct().join(near, "node_id").select(F.array("node_id").alias("path"), F.col("node_id").alias("last"), (F.col("steps") == 0).alias("met"))
    done = None
    for d in range(1, max_depth + 1):
        on = live.join(calls, "last").filter(~F.array_contains("path", F.col("next"))).select("path", "next", "met")
        on = on.join(near.withColumnRenamed("node_id", "next"), "next", "left").filter(F.col("met") | (F.col("steps") <= max_depth - d))
        longer = settled(on.select(F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("last"), (F.col("met") | F.coalesce(F.col("steps") == 0, F.lit(False))).alias("met")), "path-longer")
        if d > 1:
            began = longer.select(F.expr("slice(path, 1, size(path) - 1)").alias("path")).distinct()
            ended = live.filter("met").select("path").join(began, "path", "left_anti")
            done = ended if done is None else done.unionByName(ended)
        live = longer
        if not longer.limit(1).count():
            break
    last = live.filter("met").select("path")
    return last if done is None else done.unionByName(last)


def path_scores(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """paths with score: length times mean calls times the entry's bonus (2 by name, 1.5 by beginning)."""
    keyed = paths.withColumn("path_id", F.xxhash64("path"))
    pairs = keyed.select("path_id", "path", F.explode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] as src, path[i] as dst))")).alias("e"))
    calls = pairs.select("path_id", "e.*").join(edges.select("src", "dst", "call_count"), ["src", "dst"]).groupBy("path_id").agg((F.sum("call_count") / F.count("*")).alias("mean_calls"))
    bonus = nodes.select(F.col("node_id").alias("entry"), _bonus(F.col("label")).alias("bonus"))
    out = keyed.withColumn("entry", F.col("path")[0]).join(calls, "path_id", "left").join(bonus, "entry", "left")
    return out.select("path_id", "path", (F.size("path") * F.coalesce("mean_calls", F.lit(1.0)) * F.coalesce("bonus", F.lit(1.0))).alias("score"))


#: Partial paths that go on at once, and tables of partial paths after which they are written as one.
FRONT, TABLES = 512, 12


def _ahead_type(kind: str) -> str:
    """What a node has ahead: of the walks of each length from it, the most calls; where the node has a caller among its
    callees also its first node and the most with another first node."""
    return f"array<struct<r:int,most:long,first:{kind},other:long>>"


def calls_ahead(steps: DataFrame, depth: int) -> DataFrame:
    """(node_id, ahead): for each number r of steps (src, dst, call_count), up to `depth`, the most calls that r steps on
    from the node can have, where no step goes straight back. A step may meet a node again, so it is a bound of what paths
    have.

    Calls are dealt and sorted by callee once, on disk; in each round only the nodes' bounds and a caller and a number for
    each call move. First steps are told apart only for nodes of which a call is answered by another.
    """
    ends = steps.groupBy(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).agg((F.min("src") != F.max("src")).alias("both")).filter("both")
    answered = settled(ends.select(F.explode(F.array("x", "y")).alias("src")).distinct(), "flow-answered")
    n = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = [steps.join(answered, "src", how).repartition(n, "dst").sortWithinPartitions("dst").persist(StorageLevel.DISK_ONLY) for how in ("left_anti", "left_semi")]
    two = Window.partitionBy("src").orderBy(F.desc("calls"), "dst")
    kind = steps.schema["src"].dataType
    out, last = None, None
    for r in range(1, depth + 1):
        on = []
        for part in split:
            if last is None:
                on.append(part.select("src", "dst", F.col("call_count").alias("calls")))
            else:
                rest = F.when(F.col("first") == F.col("src"), F.col("other")).otherwise(F.col("most"))
                on.append(part.join(last.withColumnRenamed("node_id", "dst"), "dst").select("src", "dst", (F.col("call_count") + rest).alias("calls")).filter("calls is not null"))
        plain = on[0].groupBy(F.col("src").alias("node_id")).agg(F.max("calls").alias("most")).select("node_id", "most", F.lit(None).cast(kind).alias("first"), F.lit(None).cast("long").alias("other"))
        best = on[1].withColumn("k", F.row_number().over(two)).filter("k <= 2").groupBy(F.col("src").alias("node_id")).agg(F.max(F.when(F.col("k") == 1, F.col("calls"))).alias("most"), F.max(F.when(F.col("k") == 1, F.col("dst"))).alias("first"), F.max(F.when(F.col("k") == 2, F.col("calls"))).alias("other"))
        last = settled(plain.unionByName(best), "flow-ahead")
        step = last.withColumn("r", F.lit(r))
        out = step if out is None else out.unionByName(step)
    for part in split:
        part.unpersist()
    return out.groupBy("node_id").agg(F.collect_list(F.struct("r", "most", "first", "other")).cast(_ahead_type(kind.simpleString())).alias("ahead"))  # `depth` entries each


def _bound(depth: int):
    """The highest score of what a partial path (path, calls, bonus, before: the node before its last, ahead: of its
    last node) can become; null where it can't come to LEAST_NODES nodes."""
    rest = "if(x.first = before, x.other, x.most)"
    on = f"filter(ahead, x -> size(path) + x.r between {LEAST_NODES} and {depth + 1} and {rest} is not null)"
    whole = f"(size(path) + x.r) * ((calls + {rest}) / (size(path) + x.r - 1)) * bonus"
    here = f"if(size(path) >= {LEAST_NODES}, size(path) * (calls / (size(path) - 1)) * bonus, null)"
    return F.expr(f"greatest(array_max(transform({on}, x -> {whole})), {here})")


def _bonus(label):
    low, prefix = F.lower(label), F.lit(False)
    for p in ENTRY_PREFIXES:
        prefix = prefix | low.startswith(p)
    return F.when(low.isin(*ENTRY_NAMES), 2.0).when(prefix, 1.5).otherwise(1.0)


def main_flows(nodes: DataFrame, entries: DataFrame, edges: DataFrame, max_flows: int = MAX_FLOWS, max_depth: int = MAX_DEPTH, front: int = FRONT) -> list[dict]:
    """[{path, score, importance}]: the best paths that overlap little with those before them, as if all paths were
    listed by score (ties: the lesser path first) and gone through; none is left out and few are looked at.

    Node ids may be of any type that has an order; numbers move less. Calls and what nodes have ahead are kept apart, each
    written once. Paths are those of simple_paths(), of LEAST_NODES nodes at least. The search is best first: of all partial paths
    those that can become most go on, `front` at once, by one join with the calls; a path is a flow as soon as no partial
    path can become better. Partial paths are written where they are made, and stay there: what has gone on is known by
    its place in the order. The driver has `front` rows at once, finished paths that may still be chosen, and the flows.
    """
    kind = edges.schema["src"].dataType.simpleString()
    calls = settled(edges.select("src", "dst", "call_count").filter("src != dst"), "flow-steps")
    ahead = settled(calls_ahead(calls, max_depth), "flow-ahead")
    steps, met = calls.withColumnRenamed("src", "last"), ahead.withColumnRenamed("node_id", "dst")
    begin = entries.select("node_id").distinct().join(nodes.select("node_id", _bonus(F.col("label")).alias("bonus")), "node_id").join(ahead, "node_id")
    begin = begin.select(F.array("node_id").alias("path"), F.lit(0).cast("long").alias("calls"), "bonus", F.lit(None).cast(kind).alias("before"), "ahead")
    shape = ["path", "calls", "bonus", "bound"]
    live = [(settled(begin.withColumn("bound", _bound(max_depth)).filter("bound is not null").select(*shape), "flow-front"), None)]
    out, covered, done = [], set(), []

    def low(path) -> bool:
        return not out or len(set(path) & covered) / len(path) < MOST_OVERLAP

    def left() -> DataFrame:
        """Partial paths that haven't gone on and may still overlap little."""
        rest = None
        for table, cut in live:
            if cut:
                table = table.filter((F.col("bound") < cut[0]) | (F.col("bound") == cut[0]) & (F.col("path") > F.array(*map(F.lit, cut[1]))))
            rest = table if rest is None else rest.unionByName(table)
        if covered:
            same = F.size(F.array_intersect("path", F.array(*map(F.lit, sorted(covered)))))
            rest = rest.filter(same / F.lit(max_depth + 1) < MOST_OVERLAP)
        return rest

    while len(out) < max_flows:
        head = left().orderBy(F.desc("bound"), "path").limit(front).collect()
        first = (-head[0]["bound"], head[0]["path"]) if head else None
        done = sorted(x for x in done if low(x[1]))
        if done and (first is None or done[0] <= first):
            score, path = done.pop(0)
            out.append({"path": path, "score": -score})
            covered |= set(path)
            continue
        if not head:
            break
        cut = (head[-1]["bound"], head[-1]["path"])
        live = [(t, c if c and (-c[0], c[1]) > (-cut[0], cut[1]) else cut) for t, c in live]
        sent = nodes.sparkSession.createDataFrame([(k, r["path"], r["path"][-1], r["calls"], r["bonus"]) for k, r in enumerate(head) if len(r["path"]) <= max_depth], f"k int, path array<{kind}>, last {kind}, calls long, bonus double")
        on = steps.join(F.broadcast(sent), "last").filter(~F.array_contains("path", F.col("dst")))  # `front` rows
        on = on.select("k", F.array_append("path", F.col("dst")).alias("path"), (F.col("calls") + F.col("call_count")).alias("calls"), "bonus", F.col("last").alias("before"), "dst")
        on = settled(on, "flow-next").join(met, "dst", "left")  # by its size: it's sent to the nodes' bounds while it is small
        new = settled(on.withColumn("bound", _bound(max_depth)).select("k", *shape), "flow-front")
        goes_on = {r["k"] for r in new.select("k").distinct().collect()}
        for k, r in enumerate(head):
            n = len(r["path"])
            if k not in goes_on and n >= LEAST_NODES:
                done.append((-(n * (r["calls"] / (n - 1)) * r["bonus"]), r["path"]))
        live.append((new.filter("bound is not null").select(*shape), None))
        if len(live) > TABLES:
            live = [(settled(left(), "flow-front"), None)]
    top = max((f["score"] for f in out), default=0)
    return [f | {"importance": f["score"] / top if top else 0.0} for f in out]


def side_calls(mains: list[dict], edges: DataFrame) -> DataFrame:
    """(main, src, dst, call_count): calls by which others branch off a main flow: from one of its nodes to a node that no
    main flow has. The flows' nodes are MAX_FLOWS * (MAX_DEPTH + 1) at most."""
    on, kind = [(k, n) for k, m in enumerate(mains) for n in m["path"]], edges.schema["src"].dataType.simpleString()
    steps = F.broadcast(edges.sparkSession.createDataFrame(on, f"main int, src {kind}"))
    known = F.broadcast(edges.sparkSession.createDataFrame(sorted({(n,) for _, n in on}), f"dst {kind}"))
    return edges.join(steps, "src").join(known, "dst", "left_anti").select("main", "src", "dst", "call_count")


def branch_flows(paths: DataFrame, mains: list[dict]) -> DataFrame:
    """(path, main): other paths under the main flow that they share most nodes with, the first of several; at least
    one node. The mains are at most MAX_FLOWS literals."""
    shared = [F.size(F.array_intersect("path", F.array(*map(F.lit, m["path"])))) for m in mains]
    same = [F.col("path") == F.array(*map(F.lit, m["path"])) for m in mains]
    if not mains:
        return paths.select("path", F.lit(None).cast("int").alias("main")).limit(0)
    most = F.greatest(*shared) if len(shared) > 1 else shared[0]
    which = F.array_position(F.array(*shared), most) - 1
    other = ~F.array_contains(F.array(*same), True)
    return paths.filter(other & (most > 0)).select("path", which.cast("int").alias("main"))


def coverage(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """One row: n_core, n_covered, coverage: the share of functions and classes on the paths."""
    core = nodes.filter("node_type != 'module'").select("node_id")
    on = paths.select(F.explode("path").alias("node_id")).distinct().withColumn("on", F.lit(1))
    out = core.join(on, "node_id", "left").agg(F.count("*").alias("n_core"), F.count("on").alias("n_covered"))
    return out.withColumn("coverage", F.when(F.col("n_core") > 0, F.col("n_covered") / F.col("n_core")).otherwise(0.0))


def named_flows(mains: list[dict], branches: DataFrame, nodes: DataFrame) -> DataFrame:
    """(flow, name, importance, entry, step, node_id, label, file, text, n_branches): the main flows as they are told:
    named by their entry, each step with what it does, and with how many branches hang on it. The flows are few and so
    are their nodes, which are joined to the whole table of nodes."""
    spark = nodes.sparkSession
    rows = [(k, float(m["importance"]), i, n) for k, m in enumerate(mains) for i, n in enumerate(m["path"])]
    steps = spark.createDataFrame(rows, "flow int, importance double, step int, node_id string")
    shown = F.broadcast(steps).join(nodes.select("node_id", "label", "file", "node_type"), "node_id")
    entry = shown.filter("step = 0").select("flow", F.col("label").alias("entry"), naming.flow_name(F.col("label")).alias("name"))
    count = branches.groupBy(F.col("main").alias("flow")).agg(F.count("*").alias("n_branches"))
    none = F.lit(None).cast("string")
    text = naming.plain_description(naming.function_explanation(F.col("label"), F.array().cast("array<string>"), none, none))
    return shown.withColumn("text", text).join(entry, "flow").join(count, "flow", "left").select("flow", "name", "importance", "entry", "step", "node_id", "label", "file", "text", F.coalesce("n_branches", F.lit(0)).alias("n_branches"))
