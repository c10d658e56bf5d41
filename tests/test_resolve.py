from pyspark.sql import functions as F

from loomgraph.extract.router import facts, parse_files
from loomgraph.operators import graph, modules, resolve

FILES = [
    ("a/one.py", "import b.two\nfrom b.two import helper\ndef run():\n    helper()\n    local()\n    thing()\n    run()\ndef local():\n    pass\nclass C:\n    def m(self):\n        run()\n"),
    ("b/two.py", "def helper():\n    pass\nclass K:\n    def thing(self):\n        self.thing2()\n    def thing2(self):\n        pass\nclass L:\n    def thing(self):\n        pass\n"),
    ("b/three.py", "def helper():\n    pass\nhelper()\nhelper()\nhelper()\nunknown()\n"),
    ("tests/test_x.py", "def test_a():\n    helper()\n"),
    ("setup.py", "x()\n"),
]


def build(spark):
    files = spark.createDataFrame([(p, "python", c, False, 0, k) for k, (p, c) in enumerate(FILES)], "path string, language string, content string, is_config boolean, line_count long, ord long")
    r = parse_files(files)
    f = facts(r)
    place = files.select(F.col("path").alias("file"), "ord").join(r.select(F.col("file_path").alias("file"), "line_count"), "file")
    return place, f


def test_tiers(spark):
    place, f = build(spark)
    nodes, edges = resolve.build_graph(place, f["functions"], f["classes"], f["imports"], f["calls"])
    e = {(r["src"], r["dst"]): r for r in edges.collect()}
    assert ("a/one.py::run", "b/two.py::helper") in e  # by import
    assert ("a/one.py::run", "a/one.py::local") in e  # in the file
    assert ("a/one.py::run", "a/one.py::run") not in e  # calls of itself go
    assert ("a/one.py::C.m", "a/one.py::run") in e  # a method as caller
    assert ("b/two.py::K.thing", "b/two.py::K.thing2") in e
    third = e[("b/three.py::<module>", "b/three.py::helper")]
    assert third["call_count"] == 3 and third["is_critical_path"]
    assert ("tests/test_x.py::test_a", "b/two.py::helper") in e  # the first of that name elsewhere
    assert not [k for k in e if "unknown" in k[1]]
    ids = {r["node_id"]: r for r in nodes.collect()}
    assert ids["b/three.py::<module>"]["node_type"] == "module" and ids["b/two.py::K.thing"]["node_type"] == "method"


def test_last_class_wins_for_methods(spark):
    place, f = build(spark)
    defs = resolve.definitions(f["functions"], f["classes"], place)
    m = {(r["file"], r["name"]): r["node_id"] for r in resolve.method_index(defs).collect()}
    assert m[("b/two.py", "thing")] == "b/two.py::L.thing"
    index = {r["module"]: r["target"] for r in resolve.module_index(place).collect()}
    assert index["b.two"] == "b/two.py" and index["two"] == "b/two.py" and index["a/one.py"] == "a/one.py"


def test_modules(spark):
    place, f = build(spark)
    got = {r["name"]: r for r in modules.build_modules(modules.module_files(place), f["functions"], f["classes"], f["calls"]).collect()}
    assert set(got) == {"a", "b", "测试", "配置"}
    assert got["a"]["entry_functions"] == [] and got["a"]["public_interfaces"] == ["run", "local", "C"]
    assert got["b"]["files"] == ["b/two.py", "b/three.py"] and got["测试"]["is_special"]
    assert modules.find_module(spark.createDataFrame([("api", "api"), ("apix", "apix")], "name string, dir_path string"), "API").count() == 0


def test_layers_and_cycles():
    at = graph.layers(["a", "b", "c", "x", "y"], [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")])
    assert at == {"c": 0, "b": 1, "a": 2, "x": 3, "y": 3}
    assert graph.layers([], []) == {}


def small(spark):
    nodes = spark.createDataFrame([(n, f"f/{n}.py", 1, 5, "g", "function", n, k) for k, n in enumerate("abcdef")], "node_id string, file string, line_start int, line_end int, module_group string, node_type string, label string, ord long")
    edges = spark.createDataFrame([(s, d, "", 1, False) for s, d in ("ab", "bc", "ca", "cd", "de", "ef")], "src string, dst string, data_label string, call_count long, is_critical_path boolean")
    return nodes, edges


def test_trace_cycle_from_both_sides(spark):
    nodes, edges = small(spark)
    found, links = graph.trace(nodes, edges, nodes.filter("node_id = 'c'").select("node_id"))
    got = {r["node_id"]: (r["direction"], r["depth"]) for r in found.collect()}
    assert got == {"c": ("seed", 0), "b": ("upstream", 1), "a": ("upstream", 2), "d": ("downstream", 1), "e": ("downstream", 2), "f": ("downstream", 3)}
    assert ("b", "c") in {tuple(r) for r in links.collect()}
    capped, _ = graph.trace(nodes, edges, nodes.filter("node_id = 'c'").select("node_id"), cap=3)
    assert {r["node_id"] for r in capped.collect()} == {"c", "b", "a"}


def test_chain_lists_itself_in_a_cycle(spark):
    nodes, edges = small(spark)
    got = {r["function"]: r for r in graph.call_chains(nodes, edges, "g", 3).collect()}
    assert "g/a" in got["a"]["callees"] and got["a"]["callees"][0] == "g/b"


def test_overview_threshold(spark):
    for n, expect in ((30, 30), (31, 2)):
        mods = spark.createDataFrame([(f"t{k % 2}/m{k}", k) for k in range(n)], "name string, ord long")
        assert graph.overview_groups(mods).select("group").distinct().count() == expect
