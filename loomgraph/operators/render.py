"""Pictures and reports: lines are made by plans, in order, and only the finished text of a picture's bounded
content comes to the driver."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import CRITICAL_CALLS, HEAVY_CALLS, grid

EMPTY = 'graph TD\n  empty[暂无模块依赖数据]'
STYLES = ("classDef seed fill:#ff6b6b,stroke:#c92a2a,color:#fff", "classDef upstream fill:#74c0fc,stroke:#1971c2,color:#fff", "classDef downstream fill:#69db7c,stroke:#2b8a3e,color:#fff")
COLORS = {"green": "#2f9e44", "yellow": "#f59f00", "red": "#e03131"}


def safe_id(text: Column) -> Column:
    for a, b in (("/", "_"), (".", "_"), ("::", "__"), ("-", "_"), (" ", "_"), ("<", ""), (">", "")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def safe_label(text: Column) -> Column:
    return F.translate(text, "\"<>", "'‹›")


#: Bytes that a row's text can have.
MOST_BYTES = (1 << 31) - 64


def _whole(batches):
    """All texts (text), in their order, as one. It is held once: the batch that is sent on is a view of it."""
    import struct

    import pyarrow as pa

    out = bytearray()
    for batch in batches:
        for text in batch["text"]:
            if text.is_valid:
                out += text.as_buffer()
        if len(out) > MOST_BYTES:
            raise ValueError("a picture of more than 2 GB has no room in one row; draw a part of the graph")
    one = pa.StringArray.from_buffers(1, pa.py_buffer(struct.pack("<ii", 0, len(out))), pa.py_buffer(out))
    yield pa.RecordBatch.from_arrays([one], names=["mermaid"])


def joined(rows: DataFrame, head: str = "graph TD") -> DataFrame:
    """One row: head and lines (part, k1, k2, line) in order. Lines are put together by k1 first. The task that has the
    whole picture goes through these texts sorted, on disk where they are many, and holds nothing but the one that they become."""
    lines = rows.groupBy("part", "k1").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k2", "line"))), lambda x: F.concat(F.lit("\n"), x.line)), "").alias("text"))
    first = rows.sparkSession.range(1).select(F.lit(-1).alias("part"), F.lit("").alias("k1"), F.lit(head).alias("text"))
    one = lines.unionByName(first).repartition(1).sortWithinPartitions("part", "k1").select("text")
    return one.mapInArrow(_whole, "mermaid string")


def arrow(count: Column, heavy: int, label: Column | None = None) -> Column:
    line = F.when(count >= heavy, " ==>").otherwise(" -->")
    return line if label is None else F.concat(line, F.when(label != "", F.concat(F.lit('|"'), label, F.lit('"|'))).otherwise(""))


def module_picture(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules in order of name, then their edges."""
    n = modules.select(F.lit(0).alias("part"), F.col("name").alias("k1"), F.lit("").alias("k2"), F.concat(F.lit("  "), safe_id(F.col("name")), F.lit("["), safe_label(F.col("name")), F.lit("]")).alias("line"))
    e = edges.select(F.lit(1).alias("part"), F.col("src").alias("k1"), F.col("dst").alias("k2"), F.concat(F.lit("  "), safe_id(F.col("src")), arrow(F.col("call_count"), HEAVY_CALLS), F.lit(" "), safe_id(F.col("dst"))).alias("line"))
    return joined(n.unionByName(e))


def overview_picture(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """groups (name, group) of overview_groups() and edges of overview_edges()."""
    n = groups.groupBy("group").agg(F.count("*").alias("n"))
    label = F.when(F.col("n") > 1, F.concat("group", F.lit(" ("), "n", F.lit(" 子模块)"))).otherwise(F.col("group"))
    n = n.select(F.lit(0).alias("part"), F.col("group").alias("k1"), F.lit("").alias("k2"), F.concat(F.lit("  "), safe_id(F.col("group")), F.lit('["'), safe_label(label), F.lit('"]')).alias("line"))
    e = edges.select(F.lit(1).alias("part"), F.col("src").alias("k1"), F.col("dst").alias("k2"), F.concat(F.lit("  "), safe_id(F.col("src")), arrow(F.col("call_count"), HEAVY_CALLS), F.lit(" "), safe_id(F.col("dst"))).alias("line"))
    return joined(n.unionByName(e))


def focus_picture(modules: DataFrame, edges: DataFrame, focus: str) -> DataFrame:
    """A group's modules in a frame, other groups as single nodes; dotted lines lead out. edges of focus_edges()."""
    inside = modules.filter(F.split_part("name", F.lit("/"), F.lit(1)) == focus)
    one = modules.sparkSession.range(1)
    frame = one.select(F.lit(0).alias("part"), F.lit("").alias("k1"), F.lit("").alias("k2"), F.concat(F.lit("  subgraph "), safe_id(F.lit(focus)), F.lit('["'), safe_label(F.lit(focus)), F.lit('"]')).alias("line"))
    end = one.select(F.lit(2).alias("part"), F.lit("").alias("k1"), F.lit("").alias("k2"), F.lit("  end").alias("line"))
    n = inside.select(F.lit(1).alias("part"), F.col("name").alias("k1"), F.lit("").alias("k2"), F.concat(F.lit("    "), safe_id(F.col("name")), F.lit('["'), safe_label(F.col("name")), F.lit('"]')).alias("line"))
    ends = edges.filter("kind = 'outer'").select(F.explode(F.array("src", "dst")).alias("name")).distinct().join(inside.select("name"), "name", "left_anti")
    out = ends.select(F.lit(3).alias("part"), F.col("name").alias("k1"), F.lit("").alias("k2"), F.concat(F.lit("  "), safe_id(F.col("name")), F.lit('["'), safe_label(F.col("name")), F.lit('"]')).alias("line"))
    mark = F.when(F.col("kind") == "outer", " -.-").otherwise(arrow(F.col("call_count"), HEAVY_CALLS))
    e = edges.select(F.when(F.col("kind") == "inner", 4).otherwise(5).alias("part"), F.col("src").alias("k1"), F.col("dst").alias("k2"), F.concat(F.lit("  "), safe_id(F.col("src")), mark, F.lit(" "), safe_id(F.col("dst"))).alias("line"))
    return joined(frame.unionByName(n).unionByName(end).unionByName(out).unionByName(e))


def function_picture(nodes: DataFrame, edges: DataFrame, by: str = "module_group") -> DataFrame:
    """Functions framed by module (or file), with labelled edges."""
    g = F.coalesce(F.nullif(F.col(by), F.lit("")), F.lit("其他"))
    shown = nodes.withColumn("g", g)
    frames = shown.select("g").distinct()
    head = frames.select(F.lit(0).alias("part"), F.col("g").alias("k1"), F.lit("").alias("k2"), F.concat(F.lit("  subgraph "), safe_id(F.col("g")), F.lit('["'), safe_label(F.col("g")), F.lit('"]')).alias("line"))
    tail = frames.select(F.lit(0).alias("part"), F.col("g").alias("k1"), F.lit("￿").alias("k2"), F.lit("  end").alias("line"))
    where = F.concat(F.element_at(F.split("file", "/"), -1), F.lit(":L"), "line_start")
    n = shown.select(F.lit(0).alias("part"), F.col("g").alias("k1"), F.col("node_id").alias("k2"), F.concat(F.lit("    "), safe_id(F.col("node_id")), F.lit('["'), safe_label(F.concat("label", F.lit("\\n"), where)), F.lit('"]')).alias("line"))
    e = edges.select(F.lit(1).alias("part"), F.col("src").alias("k1"), F.col("dst").alias("k2"), F.concat(F.lit("  "), safe_id(F.col("src")), arrow(F.col("call_count"), CRITICAL_CALLS, F.col("data_label")), F.lit(" "), safe_id(F.col("dst"))).alias("line"))
    return joined(head.unionByName(tail).unionByName(n).unionByName(e))


def chain_picture(found: DataFrame, links: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What trace() found, colored by direction."""
    shown = found.join(nodes, "node_id")
    e = links.join(edges, ["src", "dst"])
    base = function_picture(shown, e)
    colors = shown.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "direction"))), lambda x: F.concat(F.lit("\n  class "), safe_id(x.node_id), F.lit(" "), x.direction)), "").alias("c"))
    styles = "".join(f"\n  {s}" for s in STYLES)
    return base.crossJoin(colors).select(F.concat(F.regexp_replace("mermaid", "^graph TD", "graph TD" + styles), "c").alias("mermaid"))


def detail_grid(nodes: DataFrame, columns: int = 3, width: int = 220, height: int = 80) -> DataFrame:
    """nodes of one module with x and y, three in a row. A module's functions: the window is one module's."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("module_group").orderBy("ord")) - 1
    return nodes.withColumn("k", k).withColumn("x", (F.col("k") % columns * width).cast("double")).withColumn("y", (F.floor(F.col("k") / columns) * height).cast("double")).drop("k")


def flow_steps(flows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path_id, step, node_id, label, file): flows (path_id, path) step by step."""
    return flows.select("path_id", F.posexplode("path").alias("step", "node_id")).join(nodes.select("node_id", "label", "file"), "node_id").select("path_id", "step", "node_id", "label", "file")


def blueprint(title: str, modules: list[dict], links: list[dict], summary: dict | None = None) -> str:
    """A page with a drawing of the places of core_and_rest() (bounded) and a card for each module; with a summary
    its text comes first."""
    names = [m["name"] for m in modules]
    at = grid(names, [(e["src"], e["dst"]) for e in links])
    boxes = "".join(f'<g class="node" data-name="{html.escape(n)}"><rect x="{x + 10}" y="{y + 10}" width="180" height="50" rx="6"/><text x="{x + 100}" y="{y + 40}" text-anchor="middle">{html.escape(n)}</text></g>' for n, (x, y) in at.items())
    lines = "".join(f'<line x1="{at[e["src"]][0] + 100}" y1="{at[e["src"]][1] + 35}" x2="{at[e["dst"]][0] + 100}" y2="{at[e["dst"]][1] + 35}" stroke-width="{2 + (e["call_count"] >= HEAVY_CALLS)}"/>' for e in links if e["src"] in at and e["dst"] in at)
    cards = "".join(f'<section><h2>{html.escape(str(m["name"]))}</h2><p style="color:{COLORS.get(m.get("health", "green"), COLORS["green"])}">{html.escape(str(m.get("summary", "")))}</p></section>' for m in modules)
    width, height = (max((p[k] for p in at.values()), default=0) + s for k, s in ((0, 220), (1, 80)))
    lead = f"<p>{html.escape(str(summary.get('summary', '')))}</p>" if summary else ""
    data = json.dumps({"modules": modules, "links": links}, ensure_ascii=False, default=str).replace("</", "<\\/")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>rect{{fill:#f1f3f5;stroke:#495057}}line{{stroke:#868e96}}</style></head><body><h1>{html.escape(title)}</h1>{lead}<svg viewBox="0 0 {width} {height}">{lines}{boxes}</svg>{cards}<script type="application/json" id="data">{data}</script></body></html>'


def write_page(path: str, text: str) -> str:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")
    return path


def write_blueprint(path: str, title: str, modules: list[dict], links: list[dict], summary: dict | None = None) -> str:
    return write_page(path, blueprint(title, modules, links, summary))


#: Colors of flows, one after the other.
FLOW_COLORS = ("#6366f1", "#10b981", "#f59e0b", "#ef4444", "#06b6d4")

#: Fixed in it, as readers of the page look for them: __BLUEPRINT_DATA, renderFlows, renderOverview, enterModule, arrowhead.
_PAGE = """<!DOCTYPE html><html lang="zh"><head><meta charset="utf-8"><title>%TITLE%</title><style>
body{margin:0;font:14px sans-serif;color:#212529}nav{padding:8px 14px;border-bottom:1px solid #dee2e6}nav a{cursor:pointer;color:#1971c2}
svg{width:100vw;height:78vh;background:#f8f9fa;cursor:grab}.box rect{fill:#fff;stroke-width:2}.box{cursor:pointer}.link{stroke:#868e96;fill:none}
text{font:12px sans-serif}aside{padding:8px 14px}table{border-collapse:collapse}td{border:1px solid #dee2e6;padding:2px 8px}</style></head><body>
<nav><a id="home">Overview</a><span id="crumb"></span></nav>
<svg id="canvas"><defs><marker id="arrowhead" markerWidth="8" markerHeight="8" refX="8" refY="4" orient="auto"><path d="M0,0 L8,4 L0,8 z" fill="#868e96"/></marker></defs><g id="scene"></g></svg>
<aside><p id="said"></p><p>对话：在 MCP 宿主中就任一模块继续提问。</p></aside>
<script>const __BLUEPRINT_DATA = %DATA%;
const NS = "http://www.w3.org/2000/svg", scene = document.getElementById("scene"), canvas = document.getElementById("canvas");
const view = {x: 20, y: 20, k: 1};
function place() { scene.setAttribute("transform", `translate(${view.x},${view.y}) scale(${view.k})`); }
function draw(kind, at, parent, text) { const e = document.createElementNS(NS, kind); for (const n in at) e.setAttribute(n, at[n]); if (text !== undefined) e.textContent = text; (parent || scene).appendChild(e); return e; }
function clear(crumb, said) { scene.replaceChildren(); document.getElementById("crumb").textContent = crumb ? " / " + crumb : ""; document.getElementById("said").textContent = said || ""; }
function box(x, y, title, below, color) { const g = draw("g", {class: "box", transform: `translate(${x},${y})`}); draw("rect", {width: 180, height: 56, rx: 8, stroke: color}, g); draw("text", {x: 90, y: 24, "text-anchor": "middle"}, g, title); draw("text", {x: 90, y: 42, "text-anchor": "middle", fill: "#868e96"}, g, below || ""); return g; }
function line(a, b, label, width) { draw("path", {class: "link", d: `M${a.x + 180},${a.y + 28} C${a.x + 220},${a.y + 28} ${b.x - 40},${b.y + 28} ${b.x},${b.y + 28}`, "stroke-width": width, "marker-end": "url(#arrowhead)"}); if (label) draw("text", {x: (a.x + b.x + 180) / 2, y: (a.y + b.y) / 2 + 20, "text-anchor": "middle", fill: "#495057"}, scene, label); }
function renderFlows() { clear("", __BLUEPRINT_DATA.summary); __BLUEPRINT_DATA.flows.forEach((f, r) => { draw("text", {x: 0, y: r * 130 + 14, "font-weight": "bold", fill: f.color}, scene, f.name + (f.description ? " — " + f.description : "")); f.steps.forEach((s, i) => { const at = {x: i * 230, y: r * 130 + 28}; box(at.x, at.y, String(s), "", f.color); if (i) line({x: at.x - 230, y: at.y}, at, "", 2); }); }); }
function renderOverview() { clear("", __BLUEPRINT_DATA.summary); const at = {}; __BLUEPRINT_DATA.modules.forEach(m => at[m.name] = m); __BLUEPRINT_DATA.links.forEach(e => at[e.src] && at[e.dst] && line(at[e.src], at[e.dst], e.verb, e.call_count >= 5 ? 3 : 1.5)); __BLUEPRINT_DATA.modules.forEach(m => box(m.x, m.y, m.title || m.name, m.name, m.color).addEventListener("dblclick", () => enterModule(m))); }
function enterModule(m) { clear(m.name, m.summary); box(0, 0, m.title || m.name, m.name, m.color); (m.functions || []).forEach((f, i) => box(230 + i % 3 * 220, Math.floor(i / 3) * 80, f.business_name || f.code_name, f.explanation, "#adb5bd")); }
function home() { __BLUEPRINT_DATA.flows.length ? renderFlows() : renderOverview(); }
canvas.addEventListener("wheel", e => { e.preventDefault(); const k = e.deltaY < 0 ? 1.1 : 1 / 1.1; view.x = e.offsetX - (e.offsetX - view.x) * k; view.y = e.offsetY - (e.offsetY - view.y) * k; view.k *= k; place(); }, {passive: false});
canvas.addEventListener("pointermove", e => { if (e.buttons) { view.x += e.movementX; view.y += e.movementY; place(); } });
document.getElementById("home").addEventListener("click", home); place(); home();
</script></body></html>"""


def interactive_blueprint(title: str, modules: list[dict], links: list[dict], summary: dict | None = None) -> str:
    """One page without anything from elsewhere: flows where the summary has any, else modules in layers; a double
    click opens a module, the wheel zooms, dragging moves. Names are put in as data, never as markup."""
    at = grid([m["name"] for m in modules], [(e["src"], e["dst"]) for e in links], 300, 110)
    told = {m.get("code_path"): m for m in (summary or {}).get("modules", [])}
    shown = [{"name": m["name"], "title": m.get("summary", ""), "x": at[m["name"]][0], "y": at[m["name"]][1], "color": COLORS.get(m.get("health", "green"), COLORS["green"]), "summary": told.get(m["name"], {}).get("description", m.get("summary", "")), "functions": told.get(m["name"], {}).get("functions", [])} for m in modules]
    known = set(at)
    flows = [{"name": f.get("name", ""), "description": f.get("description", ""), "steps": [s.get("name", s.get("text", "")) if isinstance(s, dict) else s for s in f.get("steps", [])], "color": FLOW_COLORS[k % len(FLOW_COLORS)]} for k, f in enumerate((summary or {}).get("flows", []))]
    data = {"summary": (summary or {}).get("project_description", ""), "modules": shown, "links": [e for e in links if e["src"] in known and e["dst"] in known], "flows": flows}
    text = json.dumps(data, ensure_ascii=False, default=str).replace("<", "\\u003c")
    return _PAGE.replace("%TITLE%", html.escape(title)).replace("%DATA%", text)
