import random

import pytest
from pyspark.sql import functions as F

from loomgraph.extract import health
from loomgraph.functions import answers
from loomgraph.operators import diffs, flows, glossary, incremental, memory, render, search
from loomgraph.plans import bind_sources as b
from loomgraph.plans import codegen, roles, summary
from loomgraph.plans.tools import Engine, role_of
from loomgraph.sources import repository
from loomgraph.sources.store import migrate, read_json, write_json
from loomgraph.streaming.watch import Watch

PROJECT = {
    "api/views.py": "from services.orders import create_order\ndef handle_order(request):\n    return create_order(request)\n",
    "services/orders.py": "from db.store import save\ndef create_order(data):\n    check(data)\n    return save(data)\ndef check(data):\n    return True\n",
    "db/store.py": "def save(row):\n    return row\n",
    "tests/test_orders.py": "def test_it():\n    pass\n",
    "pyproject.toml": "[x]\n",
    "db/__init__.py": "",
    "node_modules/x.js": "function no() {}\n",
    "logo.png": "x",
    "tool": "#!/usr/bin/env python3\nprint(1)\n",
    "Cargo.lock": "x",
}


def listing(spark, files=PROJECT):
    return spark.createDataFrame(list(files.items()), "path string, content string")


def test_scan(spark):
    files, summary = repository.scan(listing(spark))
    got = {r["path"]: r["language"] for r in files.collect()}
    assert got == {"api/views.py": "python", "services/orders.py": "python", "db/store.py": "python", "tests/test_orders.py": "python", "pyproject.toml": "toml", "db/__init__.py": "python", "tool": "python"}
    s = summary.first()
    assert s["skipped"] == 2 and s["languages"] == {"python": 6} and s["total_lines"] == 15
    assert repository.scan(listing(spark), 2)[0].count() == 2


def test_list_folder(spark, tmp_path):
    for p, c in PROJECT.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(c)
    (tmp_path / "bad.py").write_bytes(b"x = '\xff'\n")
    files, _ = repository.clone_repository(spark, str(tmp_path), str(tmp_path))
    assert {"api/views.py", "db/store.py", "bad.py"} <= {r["path"] for r in files.collect()}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    return e, e.scan("https://host/team/shop.git", listing(spark))


def test_report_and_chapter(engine):
    e, r = engine
    report = e.scan_report(r, "ceo")
    assert report["role"] == "pm" and {m["name"] for m in report["modules"]} >= {"api", "services", "db", "测试"} and "api --> services" in report["mermaid"]
    assert [(x["src"], x["dst"]) for x in report["links"]] and report["parse_quality"]["native"] == 6
    c = e.chapter(r, "Serv")
    assert c["name"] == "services" and c["cards"][0]["functions"][0]["name"] == "create_order"
    assert e.chapter(r, "nothing")["status"] == "not_found" and role_of("dev") == "dev" and role_of("?") == "pm" and role_of("qa") == "dev"


def test_diagnose_and_memory(engine):
    e, r = engine
    found = e.diagnose(r, "where to create", "services")
    by = {x["label"]: x for x in found["locations"]}
    assert by["create_order"]["priority"] == "high" and by["handle_order"]["direction"] == "upstream" and by["save"]["direction"] == "downstream"
    assert "   2 | def create_order" in by["create_order"]["snippet"] and "classDef seed" in found["mermaid"] and found["context"]
    for _ in range(2):
        e.remember(r.url, "services", "qa", "why order fails?", "x", 0.1)
    assert {x["topic"] for x in memory.hotspots(e.log(r.url)).collect()} >= {"order"}
    assert e.diagnose(r, "zzz")["status"] == "no_exact_match"


def test_ask_explore_blueprint_terms(engine, tmp_path):
    e, r = engine
    a = e.ask_context(r, "why?", "services")
    assert "create_order" in a["context"] and "neighbour1:api" in a["used"] and e.ask_context(r, "why?", "services", budget=10)["used"] == []
    x = e.explore(r, "create order")
    assert x["chapters"] and x["mermaid"] and x["locations"]
    assert e.explore(r)["chapters"]
    page = open(e.blueprint(r, str(tmp_path / "b.html"), {"summary": "<hi>"}, version=1)).read()
    assert "&lt;hi&gt;" in page and "services" in page
    told = e.summarize(r) | {"flows": [{"name": "主流程", "description": "</script>", "steps": ["一", "二"]}]}
    page = open(e.blueprint(r, str(tmp_path / "c.html"), told)).read()
    assert page.startswith("<!DOCTYPE html>") and all(x in page for x in ("主流程", "renderFlows", "renderOverview", "enterModule", "dblclick", "wheel", "Overview", "arrowhead", "创建 order")) and "\\u003c/script>" in page and "http://" not in page.replace("http://www.w3.org/2000/svg", "")
    e.correct_term(r.url, "order", "订单")
    e.correct_term(r.url, "order", "单")
    assert e.glossary(r.url).first()["target_phrase"] == "单" and e.glossary("other") is None
    assert "   1 | from services" in e.code_context(r, [("api/views.py", 1, 2)])
    answer = '```json\n{"diff_blocks": [{"file": "db/store.py", "diff_content": "@@ -1,2 +1,2 @@\\n def save(row):\\n-    return row\\n+    return dict(row)\\n"}]}\n```'
    done = e.check_code(r, answer)
    assert done["diff_valid"] and done["status"] == "success"


def test_roles_prompts_and_feedback(spark, engine):
    e, r = engine
    assert roles.guidance("ceo") == roles.GUIDANCE["pm"] and "KYC" in roles.guidance("domain_expert", "fintech") and roles.guidance("domain_expert", "none") == roles.GUIDANCE["domain_expert"]
    assert "- 404（找不到）" in roles.http_annotations() and "「slug」" in roles.banned_terms("domain_expert") and roles.banned_terms("qa") == "" and roles.banned_terms("pm", "- a → b") == "- a → b"
    shop = spark.createDataFrame([("README.md", "电商 订单 与 支付"), ("a.py", "订单")], "path string, content string")
    used = spark.createDataFrame([("shopify.api",), ("stripe",)], "module string")
    assert roles.infer_domain(shop, used).first()["domain"] == "ecommerce" and roles.infer_domain(shop.limit(0), used.limit(0)).first()["domain"] is None
    system, user = e.prompt(r, "L1")
    assert "产品经理" in system and "api/views.py" in user and "python" in user and "入口文件未找到" in user
    system, user = e.prompt(r, "L2", role="dev")
    assert "- services: 1 文件, 6 行" in user and "api → services (1 次, 弱依赖)" in user and "create_order" in user
    system, user = e.prompt(r, "L3", "services")
    assert "404" in system and "上游：api" in user and "下游：db" in user and "def create_order" in user
    assert e.read_chapter(r, "services", "qa")["role"] == "dev" and e.chapter(r, "s")["status"] == "ambiguous"
    before = {x["module_name"]: x for x in memory.understanding(e.log(r.url)).collect()}["services"]["view_count"]
    assert before >= 1
    assert e.feedback(r, "nothing", "q", "a")["status"] == "error" and e.feedback(r, "db", "q", "a", 0.5, ["x"])["status"] == "ok"
    assert e.log(r.url).filter("module_name = 'db'").first()["follow_ups"] == ["x"]
    said = e.end_session(r.url, "s1")
    assert said["status"] == "ok" and said["focus"] and e.end_session(r.url, "s2")["status"] == "ok" and {x["session_id"] for x in e.store.load("sessions", r.url).collect()} == {"s1", "s2"}
    assert e.end_session("https://none", "s")["status"] == "error" and "project_name" in e.summary_prompt(r)
    assert e.watching() == {} and e.unfollow(r.url)["status"] == "error"
    e.follow(r.url, lambda: listing(spark), lambda df, _: df)
    assert e.follow(r.url, None, None) is e.watches[r.url] and e.watching()[r.url]["active"] is False and e.unfollow(r.url)["status"] == "ok"


def test_codegen(engine):
    e, r = engine
    asked = e.code_request(r, "把报错改成中文", e.diagnose(r, "create order"), ["db/store.py"], "dev")
    assert asked["status"] == "context_ready" and {"db/store.py", "services/orders.py"} <= set(asked["files"]) and "   2 | def create_order" in asked["current_code"]["services/orders.py"] and asked["locate_info"]["exact_locations"]
    assert e.code_request(r, "x")["status"] == "error"
    md = """## 变更摘要
| 文件 | 行 | 改之前 | 改之后 |
|---|---|---|---|
| `db/store.py` | 1-2 | 原样 | 复制 |

## 代码变更
### 变更 1：复制一份
**文件**：`db/store.py`
**改之前**：原样返回
```diff
@@ -5,2 +5,2 @@
 def save(row):
-    return row
+    return dict(row)
```
**改之后**：返回副本

## 影响范围
| 模块 | 影响 | 行动 |
|---|---|---|
| **services** | 无 | 仅需知晓 |

## 验证方式
1. **保存订单** → 返回副本
"""
    done = e.check_code(r, md)
    assert done["status"] == "success" and "@@ -1,2 +1,2 @@" in done["unified_diff"] and done["change_summary"] == [{"file": "db/store.py", "line_range": "1-2", "before": "原样", "after": "复制"}]
    assert done["diff_blocks"][0]["title"] == "复制一份" and done["diff_blocks"][0]["before_desc"] == "原样返回" and done["diff_blocks"][0]["after_desc"] == "返回副本"
    assert done["blast_radius"][0]["file_or_module"] == "services" and done["verification_steps"] == [{"step": "保存订单", "expected_result": "返回副本"}]
    assert "git_applies" not in done and "git_applies" in e.check_code(r, md, "/nowhere")
    assert codegen.result("no diff", {})["status"] == "error" and e.check_code(r, md.replace("return row", "return nothing"))["status"] == "partial"


def test_incremental_scan(spark, engine):
    e, r = engine
    changed = PROJECT | {"services/new.py": "def fresh():\n    pass\n"}
    del changed["tool"]
    again = e.scan(r.url, listing(spark, changed))
    assert {x["label"] for x in again.nodes.collect()} >= {"fresh", "create_order"} and e.open(r.url).nodes.count() == again.nodes.count()
    assert e.scan(r.url, listing(spark, changed)).results.count() == again.results.count() and e.open("unknown") is None


def test_plan_modes(spark):
    old = spark.createDataFrame([(str(k), "a") for k in range(10)], "path string, sha256 string")
    assert incremental.plan_scan(old, old).first()["mode"] == "none"
    two = old.withColumn("sha256", F.when(F.col("path") < "2", "b").otherwise("a"))
    assert incremental.plan_scan(old, two).first()["mode"] == "incremental" and incremental.plan_scan(old.limit(0), old).first()["mode"] == "full"


def test_watch(spark, tmp_path):
    state = dict(PROJECT)
    n = iter(range(1000))

    def save(df, name):
        p = str(tmp_path / f"{name}{next(n)}")
        df.write.parquet(p)
        return spark.read.schema(df.schema).parquet(p)

    w = Watch(spark, lambda: listing(spark, state), save)
    assert w.look()["added"] == 6
    state["db/store.py"] += "def other():\n    pass\n"
    state["db/more.py"] = "def more():\n    pass\n"
    del state["api/views.py"]
    assert w.look() == {"added": 1, "modified": 1, "removed": 1} and w.look() == {"added": 0, "modified": 0, "removed": 0}
    assert {r["file_path"] for r in w.results.collect()} >= {"db/more.py", "db/store.py"} and w.results.filter("file_path = 'api/views.py'").count() == 0
    w.start(0.2)
    import time

    until = time.time() + 60
    while len(w.events) < 4 and time.time() < until:
        time.sleep(0.2)
    assert w.status()["active"] and len(w.events) >= 4
    w.stop()
    assert not w.status()["active"]


def test_diffs():
    good, moved, wrong, new = (t for _, t in b.DIFFS)
    files = {"f.txt": b.FILE}
    assert [len(d.hunks) for d in diffs.parse(good)] == [1] and diffs.parse(moved)[0].path == "f.txt"
    assert diffs.validate(good, files)["message"] == "ok" and diffs.validate(new, files)["valid"]
    v = diffs.validate(moved, files)
    assert v["message"] == "repaired" and "@@ -20,2 +20,2 @@" in v["repaired_diff"]
    assert not diffs.validate(wrong, files)["valid"] and not diffs.validate(" ", files)["valid"]
    done, ok = diffs.apply(b.FILE, good)
    assert ok and done.splitlines()[2:6] == ["line 3", "line four", "more", "line 5"] and not diffs.apply("a", "nothing")[1]
    assert diffs.check_format("+x")[1] and diffs.repair(good, files) is None
    assert diffs.assemble([{"file": "a", "diff_content": "-x\n+y"}, {"file": "b", "diff_content": " "}]) == "--- a/a\n+++ b/a\n@@ -1,1 +1,1 @@\n-x\n+y\n"


def test_diff_tables(spark):
    t = spark.createDataFrame(b.DIFFS, "diff_id string, text string")
    files = spark.createDataFrame([("f.txt", b.FILE)], "path string, content string")
    wrong = {r["diff_id"] for r in diffs.context_mismatches(diffs.diff_lines(t), files).collect()}
    assert wrong == {"moved", "wrong"}
    got = {r["diff_id"]: r for r in diffs.check_diffs(t, files).collect()}
    assert got["moved"]["message"] == "repaired" and got["new"]["applied"] == "a\nb" and not got["wrong"]["valid"]


def test_answers():
    assert answers.json_object('x {"a": 1} y') == {"a": 1} and answers.json_object("none") is None
    a = answers.code_answer("## Summary\n| f | c |\n|--|--|\n| a.py | x |\n## Diff\n`a.py`\n```diff\n-a\n+b\n```\n## Verify\n1. run\n2. look\n")
    assert a["changes"] == [{"f": "a.py", "c": "x"}] and a["diffs"][0]["file"] == "a.py" and a["steps"] == ["run", "look"]
    text, used = answers.fill_budget([("a", "x" * 5), ("big", "x" * 50), ("b", "y" * 3), ("neighbour1:p", "z" * 40), ("neighbour1:q", "z"), ("neighbour2:r", "w")], 12)
    assert used == ["a", "b", "neighbour2:r"]
    assert answers.clip([str(k) for k in range(600)], 100, 110)[0] == 70


def test_flows(spark):
    nodes = spark.createDataFrame([(n, n, "function") for n in ["main", "a", "b", "c", "d"]], "node_id string, label string, node_type string")
    edges = spark.createDataFrame([("main", "a", 2), ("a", "b", 4), ("b", "c", 1), ("a", "d", 1), ("c", "a", 1)], "src string, dst string, call_count long")
    entries = flows.entry_nodes(nodes, edges)
    assert [r["node_id"] for r in entries.collect()] == ["main"]
    paths = flows.simple_paths(entries, edges)
    assert {tuple(r["path"]) for r in paths.collect()} == {("main", "a", "d"), ("main", "a", "b", "c")}
    mains = flows.main_flows(nodes, entries, edges)
    assert mains[0]["path"] == ["main", "a", "b", "c"] and mains[0]["importance"] == 1.0 and mains[0]["score"] == pytest.approx(4 * (7 / 3) * 2)
    assert {tuple(r["path"]): r["main"] for r in flows.branch_flows(paths, mains[:1]).collect()} == {("main", "a", "d"): 0}
    assert flows.coverage(nodes, paths).first()["coverage"] == 1.0


def test_main_flows_beyond_a_hub(spark):
    """More paths through one hub than go on at once come before the others, which are found all the same."""
    edges = [("h", "i", 9000), ("i", "j", 9000), *[("j", f"x{k}", 9000 - k) for k in range(700)]]
    edges += [e for k in range(5) for e in ((f"{k}a", f"{k}b", 9 - k), (f"{k}b", f"{k}c", 9 - k))]
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    nodes = spark.createDataFrame([(n, n, "function") for n in names], "node_id string, label string, node_type string")
    calls = spark.createDataFrame(edges, "src string, dst string, call_count long")
    found = flows.main_flows(nodes, flows.entry_nodes(nodes, calls), calls, front=64)
    assert [f["path"] for f in found] == [["h", "i", "j", "x0"], *[[f"{k}a", f"{k}b", f"{k}c"] for k in range(4)]]
    assert flows.main_flows(nodes, flows.entry_nodes(nodes, calls), calls.limit(0)) == []


def plain_flows(names, edges, entries, depth, most=flows.MAX_FLOWS):
    """By listing all paths."""
    ahead = {}
    for a, b, n in edges:
        ahead.setdefault(a, []).append((b, n))
    ended = []

    def go(path, calls):
        on = [(b, n) for b, n in ahead.get(path[-1], []) if b not in path]
        if len(path) == depth + 1 or not on:
            if len(path) >= flows.LEAST_NODES:
                bonus = 2.0 if path[0] in flows.ENTRY_NAMES else 1.5 if path[0].startswith(flows.ENTRY_PREFIXES) else 1.0
                ended.append((-(len(path) * (calls / (len(path) - 1)) * bonus), path))
            return
        for b, n in on:
            go([*path, b], calls + n)

    for e in entries:
        go([e], 0)
    out, seen = [], set()
    for score, path in sorted(ended):
        if len(out) < most and (not out or len(set(path) & seen) / len(path) < flows.MOST_OVERLAP):
            out.append((path, -score))
            seen |= set(path)
    return out


@pytest.mark.parametrize(("seed", "front", "depth"), [(1, 3, 5), (2, 512, 6), (3, 1, 3)])
def test_main_flows_against_all_paths(spark, monkeypatch, seed, front, depth):
    """Cycles, ties, dead ends before the full depth, entries of each bonus, and tables of partial paths merged."""
    monkeypatch.setattr(flows, "TABLES", 3)
    rng = random.Random(seed)
    names = ["main", "handle_x", "free", *[f"n{k}" for k in range(11)]]
    edges = sorted({(a, b): rng.choice([1, 1, 2, 5]) for _ in range(30) for a, b in [(rng.choice(names), rng.choice(names[3:]))] if a != b}.items())
    edges = [(a, b, n) for (a, b), n in edges]
    nodes = spark.createDataFrame([(n, n, "function") for n in names], "node_id string, label string, node_type string")
    calls = spark.createDataFrame(edges, "src string, dst string, call_count long")
    entries = flows.entry_nodes(nodes, calls)
    found = flows.main_flows(nodes, entries, calls, max_depth=depth, front=front)
    want = plain_flows(names, edges, [r["node_id"] for r in entries.collect()], depth)
    assert [(f["path"], f["score"]) for f in found] == want and len(want) > 1


def test_terms(spark):
    cols = "source_term string, target_phrase string, context string, domain string, source string, confidence double, usage_count long, ord long"
    own = spark.createDataFrame([("a", "A1", "", "general", "default", 0.8, 0, 1), ("a", "A2", "", "general", "user_correction", 1.0, 0, 2)], cols)
    pack = spark.createDataFrame([("a", "P", "", "x", "domain_pack", 0.8, 0, 1), ("b", "B", "", "x", "domain_pack", 0.9, 0, 2)], cols)
    got = {r["source_term"]: r["target_phrase"] for r in glossary.resolve(glossary.project_layers(own, pack)).collect()}
    assert got == {"a": "A2", "b": "B"}
    h = spark.createDataFrame([("payment order ab1", "uses pay_order and Ab"), ("payment", "pay_order")], "question string, answer_summary string")
    n = {(r["source_term"], r["target_phrase"]): r["confidence"] for r in glossary.infer(h).collect()}
    assert n[("pay_order", "payment")] == pytest.approx(0.75) and ("pay_order", "order") in n and ("Ab", "order") not in n
    assert glossary.as_text(glossary.resolve(glossary.project_layers(own))).first()[0] == "- a → A2"


def test_ranges_and_scope(spark):
    r = spark.createDataFrame([("f", 1, 5), ("f", 7, 9), ("f", 12, 13), ("g", 1, 1)], "file string, line_start int, line_end int")
    assert sorted(map(tuple, search.coalesce_ranges(r).collect())) == [("f", 1, 9), ("f", 12, 13), ("g", 1, 1)]


def test_store(tmp_path, spark):
    write_json(str(tmp_path / "a" / "b.json"), {"x": 1})
    assert read_json(str(tmp_path / "a" / "b.json")) == {"x": 1} and read_json(str(tmp_path / "none")) == {}
    (tmp_path / "c.json").write_text("{")
    assert read_json(str(tmp_path / "c.json")) == {}
    write_json(str(tmp_path / "old" / "r.json"), {"repo_url": "u", "diagnoses": [{"q": 1}]})
    from loomgraph.sources.store import RepositoryStore

    s = RepositoryStore(spark, str(tmp_path / "new"))
    assert migrate(s, str(tmp_path / "old")) == 1 and migrate(s, str(tmp_path / "old")) == 0 and s.load("diagnoses", "u").count() == 1 and s.load("nothing") is None
    assert s.load("diagnoses").count() == 1 and s.load("diagnoses", "u").first()["q"] == 1
    write_json(str(tmp_path / "older" / "r.json"), {"repo_url": "v", "interactions": [{"module_name": "m", "kind": "qa", "query": "why", "confidence": 0.2}], "odd": [{"a": 1, "b": [2]}, {"a": 1.5}]})
    assert migrate(s, str(tmp_path / "older")) == 1 and memory.understanding(s.load("interactions", "v")).first()["ask_count"] == 1
    assert sorted((r["a"], r["b"]) for r in s.load("odd", "v").collect()) == [(1.0, "[2]"), (1.5, None)]


def test_picture_escapes(spark):
    one = spark.createDataFrame([('a/b.c::<x>"',)], "t string")
    assert one.select(render.safe_id(F.col("t")), render.safe_label(F.col("t"))).first() == ('a_b_c__x"', "a/b.c::‹x›'")


def test_summary(engine, tmp_path):
    e, r = engine
    r = e.open(r.url)
    s = e.summarize(r)
    by = {m["code_path"]: m for m in s["modules"]}
    assert s["project_name"] == "shop" and by["services"]["depends_on"] == ["db"] and by["services"]["used_by"] == ["api"] and by["db"]["business_name"] == "数据库" and "测试" not in by
    told = {f["code_name"]: f["explanation"] for f in by["services"]["functions"]}
    assert told["create_order"] == "创建 order，参数为 data" and {c["verb"] for c in s["connections"]} == {"读写数据", "调用"}
    assert e.summarize(r, "no json") == s and e.summarize(r, {"project_name": "x", "project_description": "y", "modules": [{"code_path": "a", "business_name": "b", "description": "c"}]})["modules"][0]["health"] == "green"
    assert read_json(e.save_summary(r, {"modules": 3}, str(tmp_path / "s.json")))["project_name"] == "shop"
    assert summary.prompt("L4", module_name="m", source_code="{x}")[1] == "m\n{x}" and roles.banned_terms("dev") == "" and "无" not in roles.banned_terms("pm")
    assert summary.load_config([str(tmp_path / "none.json")], {"a": 1}) == {"a": 1}


def test_swift_package(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    files = {"Package.swift": '.target(name: "Core"), .testTarget(name: "CoreTests")', "Sources/Core/a.swift": "func go() {\n}\n", "Tests/CoreTests/t.swift": "func t() {\n}\n", "Other/x.swift": "class X {\n}\n"}
    r = e.scan("swift", listing(spark, files))
    assert {m["name"]: m["is_special"] for m in r.modules.collect()} == {"Core": False, "CoreTests": True, "Other": False, "<root>": False}


def test_grammar_health():
    now, calls = [0.0], []

    def load(name):
        calls.append(name)
        if name != "shell":
            raise ImportError
        return name

    h = health.GrammarHealth(load, lambda: now[0])
    assert h.parser("bash") == "shell" and not h.available("go") and not h.available("go") and calls.count("go") == 1
    now[0] = 301
    assert not h.available("go") and calls.count("go") == 2
