from loomgraph.extract import grammar, patterns
from loomgraph.extract.patterns import swift_targets
from loomgraph.extract.router import facts, parse, parse_files, quality, warning
from loomgraph.operators import diffs
from loomgraph.plans import bind_sources as b


def names(r, kind):
    return [x["name"] for x in r[kind]]


def test_native_keeps_order_and_parents():
    r = parse("svc.py", "python", b.PYTHON)
    assert r["parse_method"] == "native" and r["parse_confidence"] == 0.99
    assert [(f["name"], f["parent_class"], f["is_method"]) for f in r["functions"]] == [("fetch", "Service", True), ("inner", "Service", True), ("main", None, False)]
    fetch = r["functions"][0]
    assert fetch["params"] == ["key", "limit", "*rest", "**more"] and fetch["return_type"] == "dict" and fetch["docstring"].startswith("Fetches.")
    assert [(i["module"], i["names"], i["is_relative"]) for i in r["imports"]] == [("os", [], False), ("sys", [], False), ("base", ["Base", "helper"], True)]
    assert [(c["caller_func"], c["callee_name"]) for c in r["calls"]] == [("inner", "helper"), ("fetch", "<complex_call>"), ("fetch", "get"), ("fetch", "inner"), ("main", "fetch"), ("main", "Service")]
    assert r["classes"][0]["methods"] == ["fetch"] and r["classes"][0]["parent_class"] == "Base"


def test_broken_python_falls_back():
    r = parse("broken.py", "python", b.BROKEN)
    assert r["parse_method"] == "partial" and r["parse_confidence"] == 0.8 and r["fallback_reason"]
    assert names(r, "functions") == ["run", "bad"] and r["functions"][0]["params"] == ["n"] and r["functions"][0]["parent_class"] is None
    assert [(i["module"], i["names"]) for i in r["imports"]] == [("a", []), ("b", []), ("x.y", ["p", "q"])] and r["classes"][0]["methods"] == ["run", "bad"]
    assert ("<module>", "go") in [(c["caller_func"], c["callee_name"]) for c in r["calls"]]


def test_patterns_by_language():
    ts = parse("v.ts", "typescript", b.TYPESCRIPT)
    assert names(ts, "functions") == ["load", "plain"] and ts["classes"][0]["methods"] == ["render"] and [i["module"] for i in ts["imports"]] == ["./a", "fs"]
    go = parse("m.go", "go", b.GO)
    assert [(f["name"], f["parent_class"], f["line_end"]) for f in go["functions"]] == [("Run", "S", 11), ("main", None, 13)] and [i["module"] for i in go["imports"]] == ["fmt", "os"]
    rust = parse("l.rs", "rust", b.RUST)
    assert [(f["name"], f["is_method"]) for f in rust["functions"]] == [("go", True), ("start", False)] and names(rust, "classes") == ["P"]
    assert names(parse("A.java", "java", b.JAVA), "classes") == ["A"]
    other = parse("s.zig", "zig", b.OTHER)
    assert other["parse_confidence"] == 0.5 and names(other, "functions") == ["buy"] and other["functions"][0]["line_end"] == 3 and [i["module"] for i in other["imports"]] == ["thing"]


def test_edges_of_the_router():
    assert parse("c.yaml", "yaml", "a: 1", is_config=True)["parse_method"] == "full"
    assert parse("n.py", "python", None)["parse_method"] == "failed"
    assert parse("e.py", "python", "")["line_count"] == 0
    assert parse("f.py", "python", "x = 1\x0cy = 2\n")["parse_method"] in ("native", "partial")
    assert parse("u.py", "python", "def größe():\n    pass\n")["functions"][0]["name"] == "größe"
    assert parse("z.py", "python", "\x00")["parse_method"] == "partial"


def test_swift_targets():
    t = swift_targets('.target(name: "A"), // .target(name: "No")\n.testTarget(name: "B", dependencies: ["A", .product(name: "Z", package: "z")]), .executableTarget(name: "C", path: "X/C")')
    assert [(x["name"], x["path"], x["type"]) for x in t] == [("A", "Sources/A", "regular"), ("B", "Tests/B", "test"), ("C", "X/C", "regular")]
    assert swift_targets("") == [] and swift_targets('.target(name: "open"') == [{"name": "open", "path": "Sources/open", "type": "regular"}]


def test_strings_and_comments_are_no_code():
    py, _ = patterns.extract('class A:\n    """def no(): {"""\n    def f(self, a, *b, c: int = g(1, 2), **k):\n        # def z()\n        x = "def q():"\n        return f(a)\nfrom . import z\nfrom ..k import (a as b,\n  c)\nasync def go(\n    a,\n    b\n):\n    return 1\nx = 2 (', "python")
    assert [(f["name"], f["params"], f["line_start"], f["line_end"]) for f in py["functions"]] == [("f", ["a", "*b", "c", "**k"], 3, 6), ("go", ["a", "b"], 10, 14)]
    assert [(i["module"], i["names"], i["is_relative"]) for i in py["imports"]] == [("", ["z"], True), ("k", ["a", "c"], True)]
    ts, _ = patterns.extract('export default function go<T>(a: string = "}") { if (a) { f(a.b(1)) } }\nconst x = y => 2;\nlet z: (a: number) => void = async (a) => { k() }\nconst r = /[}]/.test(go());\nclass Q extends P { static async m(a): Promise<{a: 1}> { n() } }\n', "typescript")
    assert [(f["name"], f["line_end"]) for f in ts["functions"]] == [("go", 1), ("x", 2), ("z", 3)] and ts["classes"][0]["methods"] == ["m"] and ts["classes"][0]["parent_class"] == "P"
    assert [(c["caller_func"], c["callee_name"]) for c in ts["calls"]] == [("go", "f"), ("go", "b"), ("z", "k"), ("<module>", "test"), ("<module>", "go"), ("<module>", "n")]
    go, _ = patterns.extract('package x\nimport f "fmt"\nfunc (s *S[T]) A() {}\nfunc G[T any](x T) T {\n s := "}"\n G(s)\n return x\n}\n', "go")
    assert [(f["name"], f["parent_class"], f["line_end"]) for f in go["functions"]] == [("A", "S", 3), ("G", None, 8)] and [i["module"] for i in go["imports"]] == ["fmt"]
    rust, _ = patterns.extract("fn a<'a>(x: &'a str) -> char { let c = '}'; b(c) }\npub(crate) use x::{a, b};\ntrait T { fn m(&self); }\n", "rust")
    assert [(f["name"], f["is_method"]) for f in rust["functions"]] == [("a", False), ("m", True)] and rust["imports"][0]["module"] == "x::{a, b}" and [c["callee_name"] for c in rust["calls"]] == ["b"]
    java, _ = patterns.extract('class A<T> extends B<T> implements C {\n @Override\n public List<String> go(int a) throws E { return new X().run("}"); }\n abstract int k();\n interface D {}\n}\n', "java")
    assert names(java, "functions") == ["go", "k"] and names(java, "classes") == ["A", "D"] and java["classes"][0]["parent_class"] == "B" and java["classes"][0]["line_end"] == 6


def test_a_file_has_its_time():
    assert parse("slow.py", "python", "x = [" + "(" * 90 + "1" + ")" * 90 + ",]\n" + "y = 1\n" * 300_000, seconds=0.01)["parse_method"] == "basic"
    assert parse("fast.py", "python", "y = 1\n")["parse_method"] == "native"


class Node:
    """A tree as grammars' bindings give it."""

    def __init__(self, type, text="", children=(), line=0, last=None, **fields):
        self.type, self.text, self.fields = type, text.encode(), fields
        self.children = [*children, *fields.values()]
        self.start_point, self.end_point = (line, 0), (last if last is not None else line, 0)

    def child_by_field_name(self, name):
        return self.fields.get(name)


def test_grammar_visitor(monkeypatch):
    call = Node("call", "self.store.get(x)", function=Node("attribute", "self.store.get"), line=3)
    doc = Node("block", children=[Node("expression_statement", children=[Node("string", '"""Says."""')]), call])
    run = Node("function_definition", line=2, last=4, name=Node("identifier", "run"), parameters=Node("parameters", children=[Node("identifier", "self"), Node("typed_parameter", "n: int")]), body=doc)
    tree = Node("module", children=[
        Node("import_from_statement", children=[Node("relative_import", ".base"), Node("dotted_name", "helper")]),
        Node("class_definition", line=1, last=4, name=Node("identifier", "K"), superclasses=Node("argument_list", "(Base)"), body=Node("block", children=[run])),
    ])

    class Parser:
        def parse(self, source):
            return type("Tree", (), {"root_node": tree})

    got = grammar.extract(Parser(), "", "python")
    assert got["functions"] == [{"name": "run", "params": ["n"], "return_type": None, "line_start": 3, "line_end": 5, "docstring": "Says.", "is_method": True, "parent_class": "K"}]
    assert got["classes"][0]["methods"] == ["run"] and got["classes"][0]["parent_class"] == "Base" and got["calls"] == [{"caller_func": "run", "callee_name": "get", "line": 4}]
    assert got["imports"] == [{"module": "base", "names": ["helper"], "is_relative": True, "line": 1}] and got["parse_confidence"] == 1.0
    ruby = grammar.visit(Node("program", children=[Node("call", 'require "set"', method=Node("identifier", "require")), Node("call", "go(1)", method=Node("identifier", "go"))]), "ruby")
    assert [i["module"] for i in ruby["imports"]] == ["set"] and [c["callee_name"] for c in ruby["calls"]] == ["go"]
    elixir = grammar.visit(Node("source", children=[Node("call", "defmodule Shop do", children=[Node("call", "def buy(x) do", line=1)])]), "elixir")
    assert names(elixir, "classes") == ["Shop"] and names(elixir, "functions") == ["buy"]
    monkeypatch.setattr(grammar, "HEALTH", type("H", (), {"parser": lambda self, name: Parser()})())
    assert parse("x.go", "go", "package x\n")["parse_method"] == "full"
    monkeypatch.undo()
    assert parse("x.go", "go", "package x\n")["fallback_reason"] == "tree-sitter unavailable"


def test_parse_files_and_facts(spark):
    rows = spark.createDataFrame([(p, lang, c, False, 0) for p, lang, c in b.SOURCES], "path string, language string, content string, is_config boolean, line_count long")
    r = parse_files(rows)
    f = facts(r)
    assert f["functions"].filter("file = 'svc.py'").count() == 3
    q = quality(r).first().asDict()
    assert q["files"] == len(b.SOURCES) and q["failed"] == 1
    assert warning({"files": 4, "partial": 3, "basic": 0}).startswith("⚠️") and warning({"files": 4, "partial": 0, "basic": 0}) == ""


def test_sources_and_diffs_by_hand(spark):
    rows = spark.createDataFrame([(p, lang, c, False, 0) for p, lang, c in b.SOURCES], "path string, language string, content string, is_config boolean, line_count long")
    got = {r.file_path: r for r in parse_files(rows).collect()}
    assert {k: r.parse_method for k, r in got.items()} == {"svc.py": "native", "broken.py": "partial", "view.ts": "partial", "m.go": "partial", "l.rs": "partial", "A.java": "partial", "shop.zig": "partial", "empty.py": "native", "none.py": "failed"}
    texts = spark.createDataFrame(b.DIFFS, "diff_id string, text string")
    files = spark.createDataFrame([("f.txt", b.FILE)], "path string, content string")
    done = {r.diff_id: r for r in diffs.check_diffs(texts, files).collect()}
    assert {k: (r.valid, r.message) for k, r in done.items()} == {"good": (True, "ok"), "moved": (True, "repaired"), "wrong": (False, "context"), "new": (True, "ok")}
    assert done["good"].applied.split("\n")[2:6] == ["line 3", "line four", "more", "line 5"] and done["moved"].applied.split("\n")[20] == "line x" and done["new"].applied == "a\nb"
    lines = diffs.diff_lines(texts)
    assert lines.count() == 13 and {(r.diff_id, r.line) for r in diffs.context_mismatches(lines, files).collect()} >= {("wrong", 2), ("moved", 8)}
