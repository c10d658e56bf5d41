import itertools
import os

import duckdb
import pytest

from loomgraph.operators import flows
from loomgraph.plans import bind_graph
from loomgraph.queries import core_oracle_sql, core_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core_oracle_sql()))
def test_against_sql(spark, con, name):
    a = core_queries()[name](spark, SF).toPandas()
    b = con.execute(core_oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    rows = lambda df: sorted(map(tuple, df[cols].astype(str).values.tolist()))
    assert rows(a) == rows(b)


def test_whole_call_graph(spark):
    """Queries that enumerate no paths see every call, backward ones too: against plain Python over the tables."""
    items = spark.read.parquet(f"{SF}/lineitem.parquet").toPandas().sort_values(["l_orderkey", *bind_graph.f._ORDER.split(", ")])
    nodes = {r.ord: r for r in bind_graph.nodes(spark, SF).collect()}
    steps = [(a, b) for (a, o), (b, p) in itertools.pairwise(zip(items.l_partkey, items.l_orderkey, strict=True)) if o == p]
    down, up = {}, {}
    for a, b in steps:
        if a != b:
            down.setdefault(a, set()).add(b)
            up.setdefault(b, set()).add(a)
    assert any(a > b for a, b in steps) and max(map(len, down.values())) > 2

    def reached(side, start, depth):
        at, front = dict.fromkeys(start, 0), set(start)
        for k in range(1, depth + 1):
            front = {b for a in front for b in side.get(a, ())} - at.keys()
            at |= dict.fromkeys(front, k)
        return at

    run = lambda name: core_queries()[name](spark, SF).collect()
    seeds = [r.ord for r in run("topk_nodes")]
    found = {k: (r, d) for r, side in ((2, down), (1, up)) for k, d in reached(side, seeds, 3).items()} | dict.fromkeys(seeds, (0, 0))
    best = sorted((*found[k], k) for k in found)[:30]
    names = ["seed", "upstream", "downstream"]
    want = {(nodes[k].node_id, names[r], d) for r, d, k in best}
    assert {(r.node_id, r.direction, r.depth) for r in run("trace")} == want
    assert {(r.node_id, r.direction, r.depth) for r in run("diagnose")} == want
    picture = run("mermaid_chain")[0][0]
    assert all(nodes[k].label in picture for _, _, k in best)
    show = lambda k: f"{nodes[k].module_group}/{nodes[k].label}"
    walks = lambda side, k: {show(b) for b in side.get(k, ())} | {show(c) for b in side.get(k, ()) for c in side.get(b, ())}
    chains = {r.node_id: r for r in run("call_chain")}
    own = [k for k in nodes if nodes[k].module_group == "m1/brand11"]
    assert own and all(set(filter(None, chains[nodes[k].node_id].callers.split(","))) == walks(up, k) and set(filter(None, chains[nodes[k].node_id].callees.split(","))) == walks(down, k) for k in own)
    by_name = lambda x: x.lower() in flows.ENTRY_NAMES or x.lower().startswith(flows.ENTRY_PREFIXES)
    assert {r.node_id for r in run("entry_nodes")} == {n.node_id for k, n in nodes.items() if n.node_type != "class" and (k not in up or by_name(n.label))}
    called = {(nodes[a].module_group, nodes[b].label) for a, b in steps}
    for r in run("module_interfaces"):
        free = [n.label for _, n in sorted(nodes.items()) if n.module_group == r.name and n.node_type == "function" and (r.name, n.label) not in called]
        assert r.entry_functions == ",".join(free[:10])


def test_entry_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['loomgraph.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') or k == 'pipeline'], list(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(__file__)))
