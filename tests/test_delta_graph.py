"""A graph after edits equals the graph built anew."""

import random

import pytest

from loomgraph.operators import delta_graph
from loomgraph.operators.delta_graph import Facts
from loomgraph.plans.bind_more import _updated
from loomgraph.plans.tools import Engine

NAMES = [f"get_{k}" if k % 3 else f"add_{k}" for k in range(14)]


def source(rng, k):
    """A file with functions, a class, imports and calls."""
    lines = [f"from m{rng.randrange(24)} import {rng.choice(NAMES)}", f"import m{rng.randrange(24)}"]
    for n in rng.sample(NAMES, 3):
        lines += [f"def {n}(x):", f"    {rng.choice(NAMES)}(x)", f"    return {rng.choice(NAMES)}(x)"]
    lines += [f"class C{k % 5}:", f"    def {rng.choice(NAMES)}(self):", f"        self.{rng.choice(NAMES)}()", f"{rng.choice(NAMES)}(1)"]
    return "\n".join(lines) + "\n"


def rows(df, *drop):
    return sorted(map(str, df.drop(*drop).collect()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scans_after_edits(spark, tmp_path, seed):
    rng = random.Random(seed)
    files = {f"m{k}.py": source(rng, k) for k in range(20)}
    listing = lambda: spark.createDataFrame(list(files.items()), "path string, content string").repartition(3)
    e = Engine(spark, str(tmp_path / "a"))
    e.scan("u", listing())
    for step in range(2):
        for p in rng.sample(sorted(files), 2):
            files[p] = source(rng, step)
        del files[rng.choice(sorted(files))]
        files[f"m{20 + step}.py"] = source(rng, step)
        if step:  # a new first file: others move on
            files["a.py"] = source(rng, step)
        got = e.scan("u", listing())
        whole = Engine(spark, str(tmp_path / f"b{step}")).scan("u", listing())
        assert rows(got.edges) == rows(whole.edges) and got.edges.count() > 20
        assert rows(got.nodes.select(*sorted(got.nodes.columns))) == rows(whole.nodes.select(*sorted(got.nodes.columns)))
        assert rows(got.modules.select("name", "total_lines")) == rows(whole.modules.select("name", "total_lines"))


def test_few_calls_are_resolved_again(spark):
    _, report = _updated(spark, "/root/testdata/sf0.01")
    n = report.first()
    assert 0 < n["n_again"] < 0.2 * n["n_calls"] and 0 < n["n_pairs"]


def test_one_renamed_function(spark):
    """Callers elsewhere, by import and by name alone, follow; labels do, too; a file that has only lost a call keeps its
    other edges."""
    kinds = {"files": "file string, ord long", "functions": "file string, ord long, name string, parent_class string, is_method boolean, line_start int, line_end int", "classes": "file string, ord long, name string, line_start int, line_end int", "imports": "file string, ord long, module string, names array<string>", "calls": "file string, ord long, caller_func string, callee_name string"}

    def facts(functions, calls, files="abc"):
        t = {"files": [(f"{x}.py", k) for k, x in enumerate(files)], "functions": [(f"{f}.py", k, n, None, False, k, k) for f, k, n in functions], "classes": [], "imports": [("c.py", 0, "b", ["get_x"])], "calls": [(f"{f}.py", k, c, n) for f, k, c, n in calls]}
        return Facts(**{k: spark.createDataFrame(t[k], v) for k, v in kinds.items()})

    calls = [("a", 0, "top", "get_x"), ("a", 1, "top", "add_y"), ("c", 0, "low", "get_x"), ("c", 1, "low", "add_y")]
    old = facts([("a", 0, "top"), ("b", 0, "get_x"), ("b", 1, "add_y"), ("c", 0, "low")], calls)
    new = facts([("a", 0, "top"), ("b", 0, "get_z"), ("b", 1, "add_y"), ("c", 0, "low"), ("c", 1, "get_x")], calls[:3])
    changed = spark.createDataFrame([("b.py", "modified"), ("c.py", "modified")], "path string, change string")
    graph, report = delta_graph.update(old, new, changed, delta_graph.build(old))
    assert {(r.src, r.dst, r.call_count, r.data_label) for r in graph.edges.collect()} == {("a.py::top", "c.py::get_x", 1, "查询数据"), ("a.py::top", "b.py::add_y", 1, "创建数据"), ("c.py::low", "c.py::get_x", 1, "查询数据")}
    assert rows(graph.edges) == rows(delta_graph.build(new).edges) and rows(graph.nodes) == rows(delta_graph.build(new).nodes)
    nothing, report = delta_graph.update(new, new, changed.limit(0), graph)
    assert rows(nothing.edges) == rows(graph.edges) and report.first()["n_again"] == 0
