"""Faults of the third review: what failed on larger tables or odd rows."""

import re

from pyspark.sql import Row
from pyspark.sql import functions as F

from loomgraph.extract import patterns
from loomgraph.functions import naming
from loomgraph.operators import delta_graph, diffs, flows, layers, render, search, triples
from loomgraph.operators.delta_graph import Facts
from loomgraph.plans import bind_graph, bind_more
from loomgraph.streaming import edits


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contents_of_files_are_not_broadcast(spark):
    """tables of files are small by their statistics, whatever they hold."""
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select(F.concat(F.lit("f"), "p_partkey").alias("path"), F.expr("repeat('line\n', 400)").alias("content"))
    nodes = part.select(F.col("path").alias("node_id"), F.col("path").alias("file"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"), F.lit("x").alias("label"), F.lit(0).alias("ord"))
    found = nodes.select("node_id", F.lit("seed").alias("direction"))
    assert "SortMergeJoin [file" in plan_of(search.locations(found, nodes, part))
    lines = part.select(F.col("path").alias("diff_id"), "path", F.lit(0).alias("hunk"), F.lit(3).alias("old_start"), F.lit(3).alias("new_start"), F.lit(0).alias("pos"), F.lit(" ").alias("tag"), F.lit("line").alias("text"))
    places = diffs.hunk_places(lines, part)
    assert "Broadcast" not in plan_of(places) and {r.place for r in places.collect()} == {1}  # the first one nearby


def test_windows_of_many_and_of_few_hunks(spark):
    """beyond FEW hashes of a file all its windows move; the places are the same."""
    content = "".join(f"r{k % 90}\n" for k in range(300))
    files = spark.createDataFrame([("a", content), ("b", content)], "path string, content string")
    rows = [(f"d{p}{k}", p, 0, k + 1, k + 1, j, " ", f"r{(k + j) % 90}") for p, n in (("a", 200), ("b", 5)) for k in range(n) for j in range(2)]
    lines = spark.createDataFrame(rows, diffs.LINES)
    got = {(r.diff_id, r.place) for r in diffs.hunk_places(lines, files).collect()}
    want = {(f"d{p}{k}", 1 + diffs.place_of(content.splitlines(), [f"r{(k + j) % 90}" for j in range(2)], k)) for p, n in (("a", 200), ("b", 5)) for k in range(n)}
    assert got == want


def test_only_lines_asked_for_move(spark):
    """a file of many lines gives a row for each line that a diff asks for, and lines beyond its end are null."""
    files = spark.createDataFrame([("a", "x\ny\nz\n"), ("b", "")], "path string, content string")
    lines = spark.createDataFrame([("d", "a", 0, 3, 3, 0, " ", "z"), ("d", "a", 0, 3, 3, 1, "-", "w"), ("d", "b", 0, 1, 1, 0, " ", " "), ("d", "c", 0, 1, 1, 0, " ", "q")], diffs.LINES)
    got = diffs.context_mismatches(lines, files)
    assert "posexplode" not in plan_of(got)
    assert sorted(map(tuple, got.collect()), key=str) == [("d", "a", 4, "w", None), ("d", "c", 1, "q", None)]


def test_texts_are_held_against_words_once(spark):
    """many questions with the same words look at a text once; the answers are those of each question."""
    docs = spark.createDataFrame([(1, "No Way"), (2, "way out"), (3, None), (4, "nothing")], "doc_id long, text string")
    asked = spark.createDataFrame([(q, ["no", "out"] if q % 2 else ["way"]) for q in range(6)], "question long, words array<string>")
    got = triples.matches(triples.index(docs, "doc_id", "text"), docs, "doc_id", "text", asked)
    assert sorted(map(tuple, got.collect())) == sorted([(q, d) for q in range(6) for d in ((1, 2, 4) if q % 2 else (1, 2))])


def test_a_picture_is_put_together_in_two_steps(spark):
    """the task that has all of it holds texts of sources, not lines."""
    rows = spark.createDataFrame([(p, k, f"t{j}", f"  {p}{k}{j}") for p in (1, 0) for k in "cab" for j in (2, 1)], "part int, k1 string, k2 string, line string")
    picture = render.joined(rows)
    assert picture.first()[0] == "graph TD\n" + "\n".join(f"  {p}{k}{j}" for p in (0, 1) for k in "abc" for j in (1, 2))
    assert "keys=[part" in plan_of(picture) and render.joined(rows.limit(0)).first()[0] == "graph TD"


def test_calls_at_the_same_place(spark):
    """F8: of the calls at one place of a file one leads elsewhere, one as before, and one isn't looked at again."""
    kinds = {"files": "file string, ord long", "functions": "file string, ord long, name string, parent_class string, is_method boolean, line_start int, line_end int", "classes": "file string, ord long, name string, line_start int, line_end int", "imports": "file string, ord long, module string, names array<string>", "calls": "file string, ord long, caller_func string, callee_name string"}

    def facts(functions):
        t = {"files": [("a.py", 0), ("b.py", 1)], "functions": [(f, k, n, None, False, k, k) for f, k, n in functions], "classes": [], "imports": [], "calls": [("a.py", 0, "top", "one"), ("a.py", 0, "top", "three"), ("a.py", 0, "top", "two"), ("a.py", 1, "top", "two")]}
        return Facts(**{k: spark.createDataFrame(t[k], v) for k, v in kinds.items()})

    old, new = facts([("a.py", 0, "top"), ("a.py", 1, "two"), ("b.py", 0, "one"), ("b.py", 1, "three")]), facts([("a.py", 0, "top"), ("a.py", 1, "two"), ("b.py", 0, "other"), ("b.py", 1, "three")])
    changed = spark.createDataFrame([("b.py", "modified")], "path string, change string")
    got, want = delta_graph.update(old, new, changed, delta_graph.build(old))[0], delta_graph.build(new)
    assert sorted(map(str, got.edges.collect())) == sorted(map(str, want.edges.collect())) and got.edges.count() == 2
    assert got.resolved.count() == want.resolved.count() == 4


def test_flows_between_numbers(spark):
    """the search takes numbers as nodes, has what nodes have ahead once for each node, and leaves nothing cached;
    calls that are answered, and calls of oneself, count as before."""
    calls = [(1, 2, 50), (2, 1, 50), (1, 3, 4), (3, 4, 4), (4, 4, 90), (2, 5, 7), (5, 6, 7), (6, 2, 9)]
    nodes = spark.createDataFrame([(k, "main" if k == 1 else f"n{k}", "function") for k in range(1, 7)], "node_id long, label string, node_type string")
    edges = spark.createDataFrame(calls, "src long, dst long, call_count long")
    names = nodes.withColumn("node_id", F.concat(F.lit("n"), "node_id"))
    named = edges.select(*[F.concat(F.lit("n"), c).alias(c) for c in ("src", "dst")], "call_count")
    entries = nodes.filter("node_id = 1").select("node_id")
    got = flows.main_flows(nodes, entries, edges)
    want = flows.main_flows(names, entries.select(F.concat(F.lit("n"), "node_id").alias("node_id")), named)
    assert [(x["path"], x["score"]) for x in got] == [([1, 2, 5, 6], 4 * (64 / 3) * 2.0), ([1, 3, 4], 3 * (8 / 2) * 2.0)]
    assert [[f"n{k}" for k in x["path"]] for x in got] == [x["path"] for x in want]
    ahead = {r["node_id"]: {x["r"]: x for x in r["ahead"]} for r in flows.calls_ahead(edges.filter("src != dst"), 3).collect()}
    assert ahead[1][2]["most"] == 57 and ahead[3][1]["first"] is None and ahead[2][1]["other"] == 7
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_lists_of_letters_are_dealt(spark):
    """rows are dealt before their letters are taken, repeated keys meet without another shuffle, and the list of a
    triple that all rows hold is in several parts."""
    rows = spark.range(3000).select(F.concat(F.lit("k"), F.col("id") % 2500).alias("id"), F.concat(F.lit("abc"), "id").alias("text")).coalesce(1)
    kept = []
    known = triples.index(rows, "id", "text", keep=lambda x: kept.append(x) or x)
    lists = triples.lists_of(rows, "id", "text")
    lists.collect()
    assert plan_of(lists).split("Initial Plan")[0].count("Exchange hashpartitioning(id") == 1 and "hashpartitioning(gram" not in plan_of(lists)
    assert re.search(r"rangepartitioning\(gram#\d+ ASC NULLS FIRST, key#", plan_of(kept[0]))
    assert {r.key for r in known.lists.filter("gram = 'abc'").collect()} == {f"k{k}" for k in range(2500)} and known.lists.filter("gram = 'abc'").count() == 2500


def test_paths_of_a_bucket_share_their_state():
    """however many paths a bucket has, a batch reads and writes their state as often; what is told stays."""
    accesses, timers, held = [], set(), {}

    class Value:
        def __init__(self, name):
            self.name = name

        def get(self):
            accesses.append(self.name)
            return held.get(self.name)

        def update(self, value):
            accesses.append(self.name)
            held[self.name] = value

        def clear(self):
            accesses.append(self.name)
            held.pop(self.name, None)

    class Handle:
        def getValueState(self, name, schema):
            return Value(name)

        def registerTimer(self, at):
            timers.add(at)

    class Expired:
        def __init__(self, at):
            self.at = at

        def getExpiryTimeInMs(self):
            return self.at

    row = lambda path, sha, ms: Row(path=path, sha256=sha, content=sha, ms=ms)
    told = lambda rows: sorted((r.path, r.change, r.sha256) for r in rows)
    p = edits.SettledEdits(500)
    p.init(Handle())
    p.handleInitialState((0,), Row(bucket=0, paths=["p0", "p1"], hashes=["a", "a"]), None)
    accesses.clear()
    first = [row(f"p{k}", "a", 1000) for k in range(300)] + [row("p2", "b", 1400), row("p1", None, 1600), row("p2", "c", 2000)]
    assert told(p.handleInputRows((0,), first, None)) == [("p2", "added", "b")] and len(accesses) <= 4 and timers == {1500, 2100, 2500}
    accesses.clear()
    assert told(p.handleExpiredTimer((0,), None, Expired(1500))) == sorted((f"p{k}", "added", "a") for k in range(3, 300)) and len(accesses) <= 4
    assert told(p.handleExpiredTimer((0,), None, Expired(2100))) == [("p1", "removed", None)]
    assert told(p.handleExpiredTimer((0,), None, Expired(2500))) == [("p2", "modified", "c")] and "waiting" not in held
    assert told(p.handleInputRows((0,), [row("p3", "z", 100)], None)) == [] and told(p.handleExpiredTimer((0,), None, Expired(600))) == [("p3", "modified", "z")]


def test_names_are_worked_out_once_for_each_segment(spark, monkeypatch):
    """rows meet the names of their segments, by either join; null and empty paths keep theirs."""
    paths = ["src/auth", "a/user_cache//", "b/zzqx", None, "", "/", "x/Config"]
    rows = spark.range(70).select("id", F.element_at(F.array(*map(F.lit, paths)), (F.col("id") % len(paths) + 1).cast("int")).alias("path"))
    want = {p: (n, v) for p, n, v in rows.select("path", naming.business_name(F.col("path")), naming.connection_verb(F.element_at(F.split(F.regexp_replace("path", "/+$", ""), "/"), -1))).collect()}
    for most in (naming.BROADCAST_SEGMENTS, 0):
        monkeypatch.setattr(naming, "BROADCAST_SEGMENTS", most)
        got = naming.business_names(rows)
        assert "filter(" not in plan_of(got) and sorted(r.id for r in got.collect()) == list(range(70))
        assert all(want[r.path] == (r.name, r.verb) for r in got.collect())


def test_nodes_need_no_callees(spark, monkeypatch):
    """F16: nodes after edits are found without resolving what is called, and are those of a graph that is built anew."""
    old, new = bind_more._edited_facts(spark, "/root/testdata/sf0.001")
    want = sorted(map(str, delta_graph.build(new).nodes.collect()))
    assert sorted(map(str, delta_graph.update_nodes(new, bind_more._edited_files(spark, old, new), delta_graph.build_nodes(old)).select(*delta_graph.build_nodes(new).columns).collect())) == want
    monkeypatch.setattr(delta_graph.resolve, "resolve_callees", None)
    assert bind_more.incremental_nodes(spark, "/root/testdata/sf0.001").count() == len(want)


def test_sources_without_a_mark_arent_cut(monkeypatch):
    """what has no word or sign that a fact needs has no facts, whatever its length; others are cut as before."""
    whole = {lang: patterns.extract("func type x\nimport 'a'\nclass b: f(1)\n", lang) for lang in patterns.MARKS}
    assert whole["go"][0]["calls"] and whole["python"][0]["classes"]
    made = []
    monkeypatch.setattr(patterns, "Source", lambda *x: made.append(x))
    for lang in patterns.READERS:
        facts, confidence = patterns.extract("plain words; \"more\" 'of' them.\n" * 9, lang)
        assert facts == {"functions": [], "classes": [], "imports": [], "calls": []} and confidence == patterns.CONFIDENCE[lang]
    assert not made


def test_modules_meet_by_numbers(spark):
    """names of nodes are neither sorted nor shuffled for calls between modules."""
    got = plan_of(bind_graph.module_graph(spark, "/root/testdata/sf0.001"))
    assert "p_name" not in got and "SortMergeJoin [src" in got


def test_nodes_of_a_chain_stay_off_the_driver(spark, monkeypatch):
    """neither the calls nor the walk send the table of nodes to all tasks."""
    met, real_calls, real_trace = [], bind_graph.graph.aggregate_calls, bind_graph.graph.trace
    monkeypatch.setattr(bind_graph.graph, "aggregate_calls", lambda calls: met.append(calls) or real_calls(calls))
    monkeypatch.setattr(bind_graph.graph, "trace", lambda n, e, s: met.append(e.join(n.select(F.col("node_id").alias("src"), "ord"), "src", "left")) or real_trace(n, e, s))
    bind_graph.mermaid_chain(spark, "/root/testdata/sf0.001")
    assert len(met) == 2 and not any("Broadcast" in plan_of(x) for x in met)


def test_given_edges_are_computed_once(spark):
    """layers() reads the table of edges that it is given once."""
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: read.add(1) or x).asNondeterministic()
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "a")], "src string, dst string").repartition(1).select(seen("src").alias("src"), "dst")
    names = spark.createDataFrame([(x,) for x in "abcde"], "name string")
    got = {r["name"]: (r["level"], r["cycle"]) for r in layers.layers(names, edges).collect()}
    assert got == {"a": (1, None), "b": (0, "b"), "c": (0, "b"), "d": (2, None), "e": (0, None)} and read.value == 4


def test_branches_use_written_calls(spark, monkeypatch):
    """the slice of calls is worked out once, for the main flows and for the paths."""
    made, real = [], bind_graph.sparse_edges
    monkeypatch.setattr(bind_graph, "sparse_edges", lambda *x: made.append(x) or real(*x))
    monkeypatch.setattr(bind_more.flows, "main_flows", lambda *_, **__: [])
    assert bind_more.branch_flows(spark, "/root/testdata/sf0.001").count() == 0 and len(made) == 1
