"""Substring search by the inverted list, and budgets of many questions, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import answers
from loomgraph.operators import budget, diffs, modules, search, triples
from loomgraph.plans.tools import Engine


def test_no_holding_row_is_missed(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abÀ中\n x") for _ in range(rng.randint(0, 40))) for _ in range(150)] + ["", None, "a", "ab", "abc" * 9000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, t string")
    words = {q: ["".join(rng.choice("abà中 x") for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(0, 3))] for q in range(40)} | {99: ["zzz"], 98: ["ab", "\n "]}
    asked = spark.createDataFrame(list(words.items()), "question long, words array<string>")
    got = {(r["question"], r["key"]) for r in triples.candidates(triples.index(rows, "id", "t"), asked).collect()}
    want = {(q, k) for q, ws in words.items() for k, t in enumerate(texts) if t and any(w in t.lower() for w in ws)}
    assert want <= got and len(got) < 3 * len(want) and not [x for x in got if x[0] == 99]
    with pytest.raises(Exception, match="no list for the word x"):
        triples.candidates(triples.index(rows, "id", "t"), spark.createDataFrame([(1, ["x"])], "question long, words array<string>")).collect()


def test_lookups_are_the_same_by_index(spark):
    rng = random.Random(3)
    names = [rng.choice(["get", "Load", "parse", "ID"]) + "_" + rng.choice(["user", "Order", "x", "中文"]) for _ in range(80)]
    nodes = spark.createDataFrame([(f"n{k}", n, f"src/{rng.choice(['Users', 'io', 'b'])}/f{k % 9}.py", k) for k, n in enumerate(names)], "node_id string, label string, file string, ord long")
    known = search.node_index(nodes)
    for q in ("load the user order", "io", "nothingAtAll", "x", ""):
        plain = search.match_nodes(nodes, q, limit=20).select("node_id", "score").collect()
        assert search.match_nodes(nodes, q, limit=20, index=known).select("node_id", "score").collect() == plain
    mods = spark.createDataFrame([("api/users", "api/Users"), ("api/orders", "x/orders"), ("b", "deep/bb")], "name string, dir_path string")
    for w in ("api", "API/USERS", "b", "bb", "orders", "x/orders", "none"):
        for run in (modules.find_module, modules.modules_in_scope):
            assert sorted(map(str, run(mods, w, modules.module_index(mods)).collect())) == sorted(map(str, run(mods, w).collect()))


def test_budgets_are_filled_as_one_by_one(spark):
    rng = random.Random(4)
    asked = {}
    for q in range(40):
        asked[q] = [(p, f"{rng.choice(['neighbour1', 'neighbour2', 'other'])}:{p}", rng.choice(["", None, "x" * rng.randint(1, 30), "é" * rng.randint(1, 60)])) for p in range(rng.randint(0, 9))]
    rows = [(q, p, label, t, label.split(":")[0] if label.startswith("neighbour") else None) for q, ps in asked.items() for p, label, t in ps]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "question long, place int, label string, text string, run string").repartition(3)
    got = {r["question"]: (r["context"], r["labels"], r["left"]) for r in budget.fill_budgets(df, 70).collect()}
    for q, ps in asked.items():
        if ps:
            text, labels = answers.fill_budget([(label, t or "") for _, label, t in ps], 70)
            assert got[q][:2] == (text, labels) and got[q][2] == 70 - sum(len(t or "") for _, label, t in ps if label in labels)
    assert len(got) == len([q for q in asked if asked[q]]) and budget.fill_budgets(df.limit(0)).count() == 0


def test_flows_of_a_scan(spark, tmp_path):
    code = {"app.py": "from work import load\n\ndef main():\n    load(1)\n    load(2)\n    save()\n\ndef save():\n    pass\n", "work.py": "def load(x):\n    return parse(x)\n\ndef parse(x):\n    return x\n\ndef lone():\n    pass\n"}
    e = Engine(spark, str(tmp_path))
    r = e.scan("u", spark.createDataFrame(list(code.items()), "path string, content string"))
    told = e.flows(r)
    assert [[s["node_id"] for s in f["steps"]] for f in told["flows"]] == [["app.py::main", "work.py::load", "work.py::parse"]]
    assert told["flows"][0]["importance"] == 1.0 and told["flows"][0]["branches"] == 1 and told["coverage"] == pytest.approx(3 / 5)
    assert [x["node_id"] for x in e.diagnose(e.open("u"), "where is parse done")["locations"]][:1] == ["work.py::parse"]


def test_hunks_are_found_as_line_by_line(spark):
    rng = random.Random(6)
    files, texts = {}, []
    for f in range(12):
        files[f"f{f}.py"] = [rng.choice(["a", "b ", "", "  c", "d\t"]) for _ in range(rng.randint(0, 90))]
        hunks = []
        for _ in range(rng.randint(1, 4)):
            k = rng.randrange(max(1, len(files[f"f{f}.py"])))
            want = files[f"f{f}.py"][k : k + rng.randint(1, 4)] or ["nowhere"]
            if rng.random() < 0.2:
                want = [*want, "zzz"]
            hunks += [f"@@ -{rng.randint(1, 90)},{len(want)} +1,1 @@", *[rng.choice(" -") + x.rstrip() + rng.choice(["", " "]) for x in want], "+new"]
        texts.append((f"d{f}", "\n".join([f"--- a/f{f}.py", f"+++ b/f{f}.py", *hunks, "@@ -7,0 +7,1 @@", "+only new"]) + "\n"))
    texts.append(("lost", "--- a/none.py\n+++ b/none.py\n@@ -3,1 +3,1 @@\n-x\n+y\n"))
    table = spark.createDataFrame([(p, "\n".join(x) + "\n") for p, x in files.items()], "path string, content string")
    got = {(r["diff_id"], r["hunk"]): r["place"] for r in diffs.hunk_places(diffs.diff_lines(spark.createDataFrame(texts, "diff_id string, text string")), table).collect()}
    want = {}
    for name, text in texts:
        for d in diffs.parse(text):
            for n, h in enumerate(d.hunks):
                at = diffs.place_of(("\n".join(files[d.path]) + "\n").splitlines(), h.old(), h.old_start - 1) if d.path in files and h.old() else None if h.old() else h.old_start - 1
                want[name, n] = None if at is None else at + 1
    assert got == want and None in want.values() and len({v for v in want.values()}) > 10
