"""The engine's front: a repository's tables and what is asked of them."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.patterns import swift_targets
from ..extract.router import facts, parse_files, quality, warning
from ..functions import answers
from ..functions.text import project_name
from ..functions.naming import business_name, connection_verb, module_description
from ..operators import delta_graph, diffs, flows, glossary, graph, incremental, memory, modules, render, resolve, search, stats, triples
from ..sources.repository import MAX_FILES, ordered, scan
from ..sources.store import RepositoryStore, Transaction, write_json
from . import codegen, roles, summary
from .roles import BADGES, ROLES, role_column, role_of

LARGE_MODULE, CARDS = 3000, 10


@dataclass
class Repository:
    """Tables of one scanned repository. All are plans over stored tables, so each is read only where asked for."""

    url: str
    files: DataFrame
    summary: DataFrame
    results: DataFrame
    nodes: DataFrame
    edges: DataFrame
    modules: DataFrame
    module_edges: DataFrame
    lists: DataFrame | None = None  # nodes by letters, for lookups

    @property
    def module_list(self) -> DataFrame:
        return self.modules.select("name", F.monotonically_increasing_id().alias("ord")) if "ord" not in self.modules.columns else self.modules.select("name", "ord")


class Engine:
    """Scans and questions, with tables kept in a folder by repository."""

    def __init__(self, spark: SparkSession, root: str, templates: list[str] | None = None):
        """templates: files with prompts by level, (system, user) each, the first that can be read; else the built-in ones."""
        self.spark, self.store = spark, RepositoryStore(spark, root)
        self.watches: dict = {}
        self.streams: dict = {}
        self.templates = summary.load_config(templates or [], summary.TEMPLATES)

    # -- scanning

    def scan(self, url: str, listing: DataFrame, max_files: int | None = MAX_FILES) -> Repository:
        """Files to facts, graph and modules; only what changed is parsed where a former scan is known and less than
        FULL_SCAN_SHARE of it has changed."""
        files, counts = scan(listing, max_files)
        with self.store.writing(url) as t:  # all tables of a scan become one version, or none does
            files = t.save("files", ordered(files))
            now = t.save("snapshots", incremental.snapshot(files))
            was, old = t.former("snapshots"), t.former("results")
            results, edited = None, None
            if was is not None and old is not None:
                changed = t.save("changes", incremental.changes(was, now))
                plan = incremental.plan_scan(was, now).first()
                if plan["mode"] == "none":
                    results = old
                elif plan["mode"] == "incremental":
                    fresh = parse_files(files.join(changed.filter("change != 'removed'").select("path"), "path", "left_semi"))
                    results, edited = t.save("results", incremental.merge(old, fresh, changed)), changed
            if results is None:
                results = t.save("results", parse_files(files))
            return self._build(t, url, files, counts, results, edited)

    def _build(self, t: Transaction, url: str, files: DataFrame, counts: DataFrame, results: DataFrame, edited: DataFrame | None = None) -> Repository:
        """edited: what has changed since the former version, whose graph is then brought up to date."""
        now = self._facts(files, results)
        place, flat = now.files, facts(results)
        former = {n: t.former(n) for n in ("files", "results", "nodes", "edges", "resolved")}
        if edited is None or None in former.values():
            whole = delta_graph.build(now)
        else:
            was = delta_graph.Graph(former["nodes"].drop("module_group"), former["edges"], former["resolved"])
            whole, _ = delta_graph.update(self._facts(former["files"], former["results"]), now, edited, was)
        t.save("resolved", whole.resolved)
        nodes, edges = whole.nodes, whole.edges
        grouped = modules.module_files(place)
        manifest = files.filter("path = 'Package.swift'").select("content").first()
        targets = swift_targets(manifest["content"] or "") if manifest else []
        if targets:  # a package's own targets are its modules; a file under two is in both
            under = modules.swift_files(place, self.spark.createDataFrame(targets, "name string, path string, type string"))
            kind = F.when(F.col("type") == "test", 2).otherwise(0)
            grouped = under.select(*place.columns, kind.alias("kind"), "name", F.col("path").alias("dir_path"), F.col("name").alias("key"))
        mods = modules.build_modules(grouped, flat["functions"], flat["classes"], flat["calls"])
        nodes = t.save("nodes", resolve.assign_modules(nodes, grouped.select("name", "file", "ord")))
        edges = t.save("edges", edges)
        listed = mods.withColumn("ord", F.struct("rank.kind", "rank.by_name", "rank.ord"))
        mods = t.save("modules", listed.drop("rank").withColumn("ord", F.col("ord.kind").cast("long") * 1_000_000_000 + F.col("ord.ord")))
        lists = t.save("triples", triples.lists_of(nodes, "node_id", "label", "file").repartitionByRange("gram", "key").sortWithinPartitions("gram", "key"))
        return Repository(url, files, counts, results, nodes, edges, mods, graph.module_edges(nodes, edges), lists)

    def _facts(self, files: DataFrame, results: DataFrame) -> delta_graph.Facts:
        flat = facts(results)
        place = files.select(F.col("path").alias("file"), "ord", "line_count", "is_config")
        return delta_graph.Facts(place, flat["functions"], flat["classes"], flat["imports"], flat["calls"])

    def open(self, url: str) -> Repository | None:
        """A repository scanned before."""
        now = self.store.begin(url).tables  # one version, whoever writes meanwhile
        if not {"files", "results", "nodes", "edges", "modules"} <= now.keys():
            return None
        t = {n: self.store.reader(now[n]) for n in ("files", "results", "nodes", "edges", "modules")}
        from ..sources.repository import summarize

        return Repository(url, t["files"], summarize(t["files"], t["files"].withColumn("skipped", F.lit(None).cast("string"))), t["results"], t["nodes"], t["edges"], t["modules"], graph.module_edges(t["nodes"], t["edges"]), self.store.reader(now["triples"]) if "triples" in now else None)

    def scan_report(self, r: Repository, role: str = "pm") -> dict:
        """What a scan shows: overview, modules with health and names, links with verbs, pictures, parse quality."""
        started = time.time()
        cards = r.modules.select("name", "total_lines", "is_special", F.size("files").alias("n_files"), graph.size_health(F.col("total_lines")).alias("health"), business_name(F.col("name")).alias("title"), module_description(F.col("name"), F.col("entry_functions"), F.lit(0), F.size("files"), F.col("total_lines")).alias("summary"), "entry_functions", "public_interfaces")
        cards = cards.withColumn("body", summary.node_body(F.col("summary"), F.col("entry_functions"), F.col("public_interfaces"))).drop("entry_functions", "public_interfaces")
        links = r.module_edges.select("src", "dst", "call_count", connection_verb(F.col("dst")).alias("verb"), graph.strength(F.col("call_count")).alias("strength"), graph.call_label(F.col("call_count")).alias("label"))
        q = quality(r.results.join(r.files.filter("not is_config").select(F.col("path").alias("file_path")), "file_path", "left_semi")).first().asDict()
        listed = r.module_list
        return {
            "role": role_of(role), "badge": BADGES[role_of(role)], "overview": stats.overview(r.files, r.modules, r.module_edges).first().asDict(),
            "modules": [x.asDict() for x in cards.collect()], "links": [x.asDict() for x in links.collect()], "parse_quality": q, "warning": warning(q),
            "expandable": [x.asDict() for x in graph.expandable_groups(r.nodes).collect()],
            "mermaid": render.overview_picture(graph.overview_groups(listed), graph.overview_edges(listed, r.module_edges)).first()[0], "seconds": time.time() - started,
        }

    # -- questions

    def read_chapter(self, r: Repository, wanted: str, role: str = "pm") -> dict:
        """chapter() as a reader sees it, who is counted: a view is kept for what is known of the module."""
        own = self.chapter(r, wanted)
        if own["status"] == "ok":
            self.remember(r.url, own["name"], "view", wanted, "", 1.0)
        return own | {"role": role_of(role), "guidance": roles.guidance(role)}

    def chapter(self, r: Repository, wanted: str) -> dict:
        """A module's files as cards: signatures, classes, calls, imports; a large one's first ten files. Several modules
        that hold a name are told, as are all where none does."""
        found = modules.find_module(r.modules, wanted).collect()
        if not found:
            several = [x["name"] for x in modules.modules_in_scope(r.modules, wanted).orderBy("ord").limit(CARDS).collect()]
            known = several or [x["name"] for x in r.modules.filter("not is_special").orderBy("ord").limit(CARDS).collect()]
            return {"status": "ambiguous" if several else "not_found", "wanted": wanted, "available": known}
        m = found[0]
        shown = m["files"][:CARDS] if m["total_lines"] > LARGE_MODULE else m["files"]
        own = r.results.filter(F.col("file_path").isin(shown)) if shown else r.results.limit(0)
        cards = own.filter("size(functions) > 0 or size(classes) > 0").select(
            "file_path",
            F.expr("transform(functions, f -> struct(f.name, slice(f.params, 1, 5) as params, f.return_type, concat(f.line_start, '-', f.line_end) as lines, f.is_method, left(trim(substring_index(f.docstring, '\\n', 1)), 80) as doc))").alias("functions"),
            F.expr("transform(classes, c -> struct(c.name, slice(c.methods, 1, 10) as methods))").alias("classes"),
            F.expr("array_distinct(transform(calls, c -> struct(c.caller_func, c.callee_name)))").alias("calls"),
            F.expr("transform(slice(filter(imports, i -> i.module != ''), 1, 8), i -> concat(i.module, if(size(i.names) > 0, concat(' (', array_join(slice(i.names, 1, 3), ', '), ')'), '')))").alias("imports"),
        )
        inside = r.nodes.filter(F.col("file").isin(m["files"]))
        ids = inside.select("node_id")
        e = r.edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
        picture = render.function_picture(inside.filter("label != '<module>'"), e, "file").first()[0]
        return {"status": "ok", "name": m["name"], "total_lines": m["total_lines"], "cards": [c.asDict(recursive=True) for c in cards.collect()], "remaining": m["files"][len(shown) :], "mermaid": picture}

    def diagnose(self, r: Repository, query: str, module: str | None = None) -> dict:
        """Places that a question is about, and what calls and is called from there."""
        scope = None
        if module is not None:
            scope = modules.modules_in_scope(r.modules, module).select(F.explode("files").alias("file"))
        seeds = search.match_nodes(r.nodes, query, scope, limit=5, index=triples.of_lists(r.lists) if r.lists is not None else None)
        found, links = graph.trace(r.nodes, r.edges, seeds)
        places = search.locations(found, r.nodes, r.files)
        order = F.when(F.col("priority") == "high", 0).otherwise(1)
        rows = [x.asDict() for x in places.orderBy(order, "direction", "depth", "ord").collect()]  # 30 and the seeds at most
        out = {"status": "ok" if rows else "no_exact_match", "locations": rows}
        out["mermaid"] = render.chain_picture(found, links, r.nodes, r.edges).first()[0] if rows else "graph TD\n  empty[未找到匹配的代码节点]"
        out["context"] = context_text(rows)
        if module is not None:
            self.remember(r.url, module, "diagnosis", query, "; ".join(x["ref"] for x in rows[:3]), 1.0 if rows else 0.0)
        return out

    def flows(self, r: Repository) -> dict:
        """Main flows of a repository, told step by step, and how much of it they cover. Entries are found by name, by
        what nothing calls, and by the modules' entry functions."""
        named = r.modules.select(F.explode("entry_functions").alias("name")).distinct()
        entries = flows.entry_nodes(r.nodes, r.edges, named)
        mains = flows.main_flows(r.nodes, entries, r.edges)
        if not mains:
            return {"flows": [], "coverage": 0.0}
        told = flows.named_flows(mains, flows.side_calls(mains, r.edges), r.nodes).orderBy("flow", "step").collect()  # MAX_FLOWS paths
        out = [{"name": "", "importance": m["importance"], "steps": []} for m in mains]
        for x in told:
            out[x["flow"]] |= {"name": x["name"], "entry": x["entry"], "branches": x["n_branches"]}
            out[x["flow"]]["steps"].append({"node_id": x["node_id"], "file": x["file"], "text": x["text"]})
        paths = self.spark.createDataFrame([(m["path"],) for m in mains], "path array<string>")
        return {"flows": out, "coverage": flows.coverage(r.nodes, paths).first()["coverage"]}

    def ask_context(self, r: Repository, question: str, wanted: str, role: str = "pm", budget: int = answers.CONTEXT_CHARS) -> dict:
        """What a model needs to answer about a module, by priority and as far as a budget goes."""
        own = self.chapter(r, wanted)
        if own["status"] != "ok":
            return own
        log = self.log(r.url)
        near = [x["name"] for x in graph.neighbours(r.module_edges, own["name"], 1).orderBy("direction", "name").limit(6).collect()]
        far = [x["name"] for x in graph.neighbours(r.module_edges, own["name"], 2).filter("depth = 2").orderBy("direction", "name").limit(4).collect()]
        source = r.files.filter(F.col("path").isin([c["file_path"] for c in own["cards"]])).select("path", "content").orderBy("path").limit(CARDS).collect()
        past = [] if log is None else [x["query"] for x in memory.last_records(log.filter(F.col("module_name") == own["name"]), 5).orderBy("ord").collect()]
        parts = [("summary", card_text(own)), ("source", "\n".join(f"### {s['path']}\n{answers.numbered((s['content'] or '').splitlines()[:200])}" for s in source)[:15_000])]
        parts += [(f"neighbour1:{n}", card_text(self.chapter(r, n))) for n in near if n != own["name"]]
        parts += [("history", "\n".join(past)), ("hotspots", "" if log is None else "\n".join(f"{x['topic']} ({x['question_count']})" for x in memory.hotspots(log.filter(F.col("module_name") == own["name"])).collect()))]
        parts += [(f"neighbour2:{n}", card_text(self.chapter(r, n))) for n in far if n not in near]
        text, used = answers.fill_budget(parts, budget)
        return {"status": "ok", "module": own["name"], "role": role_of(role), "context": text, "used": used, "prompt": f"{BADGES[role_of(role)]}\n{roles.guidance(role)}\n\n{text}\n\n问题：{question}"}

    def code_context(self, r: Repository, refs: list[tuple[str, int, int]]) -> str:
        """Numbered code around places (file, first line, last line)."""
        texts = {x["path"]: (x["content"] or "").splitlines() for x in r.files.filter(F.col("path").isin([a for a, _, _ in refs])).select("path", "content").collect()}
        out = []
        for path, a, b in refs:
            first, lines = answers.clip(texts.get(path, []), a, b)
            out.append(f"### {path}\n{answers.numbered(lines, first)}")
        return "\n\n".join(out)

    def _contents(self, r: Repository, paths: list[str]) -> dict[str, str]:
        """Texts of a few files."""
        return {x["path"]: x["content"] or "" for x in r.files.filter(F.col("path").isin(paths)).select("path", "content").collect()} if paths else {}

    def code_request(self, r: Repository, instruction: str, located: dict | None = None, paths: list[str] | None = None, role: str = "pm") -> dict:
        """What a model is given to change code: files of a diagnosis and those that are named."""
        wanted = sorted({x["file"] for x in codegen.places(located)} | set(paths or []))
        return codegen.request(instruction, self._contents(r, wanted), located, role, self.domain(r) if role_of(role) == "domain_expert" else None)

    def check_code(self, r: Repository, answer: str, root: str | None = None) -> dict:
        """A model's answer taken apart, with its diff checked against the repository's files; and by git where root, a
        working tree, is given."""
        touched = [d.path for d in diffs.parse(diffs.assemble(codegen.read_answer(answer)["diff_blocks"]))]
        done = codegen.result(answer, self._contents(r, touched))
        if root is not None and done["diff_valid"]:
            fits, said = diffs.git_check(root, done["unified_diff"])
            done |= {"git_applies": fits, "git_says": said}
        return done

    def prompt(self, r: Repository, level: str, module: str = "", role: str = "pm", project_summary: str = "", lines: int = 400) -> tuple[str, str]:
        """(system, user) for a summary: L1 the project, L2 its modules, L3 one module, L4 one module's code. Texts are
        bounded by what a model reads: as many lines of each table."""
        view = role_of(role)
        said = {"guidance": roles.guidance(view, self.domain(r) if view == "domain_expert" else None), "http_status_annotations": roles.http_annotations()}
        terms = self.glossary(r.url)
        said["banned_terms"] = roles.banned_terms(view, None if terms is None else glossary.as_text(terms).first()[0])
        text = lambda df, *order: "\n".join(x["line"] for x in df.orderBy(*order).limit(lines).collect())
        if level == "L1":
            tree = modules.file_tree(r.files.select(F.col("path").alias("file")), 2).select("path", F.col("path").alias("line"))
            entry = summary.entry_file(r.files).collect()
            stat = {x["language"]: x["files"] for x in stats.language_stats(r.files).collect()}
            return summary.prompt(level, self.templates, file_tree=text(tree, "path"), language_stats=stat, entry_file_content=entry[0]["content"] if entry else "(入口文件未找到)", **said)
        if level == "L2":
            told = r.results.filter("size(functions) > 0").select(F.col("file_path"), F.concat(F.lit("- "), "file_path", F.lit(": "), F.array_join(F.expr("transform(slice(functions, 1, 10), f -> f.name)"), ", ")).alias("line"))
            return summary.prompt(level, self.templates, project_summary=project_summary or "(待生成)", module_groups=text(summary.module_lines(r.modules), "ord"), dependency_edges=text(summary.edge_lines(r.module_edges), "src", "dst"), module_functions=text(told, "file_path"), **said)
        own = self.chapter(r, module)
        if own["status"] != "ok":
            raise ValueError(f"{module}: {own['status']}")
        code = "\n\n".join(f"### {p}\n{answers.numbered(t.splitlines()[:200])}" for p, t in sorted(self._contents(r, [c["file_path"] for c in own["cards"]][:CARDS]).items()))
        near = graph.neighbours(r.module_edges, own["name"], 1).collect()
        side = {d: ", ".join(sorted(x["name"] for x in near if x["direction"] == d)) or "无" for d in ("upstream", "downstream")}
        info = {"name": own["name"], "total_lines": own["total_lines"], "files": len(own["cards"]) + len(own["remaining"])}
        return summary.prompt(level, self.templates, module_name=own["name"], module_info=info, source_code=code, parse_result=card_text(own), **side, **said)

    def domain(self, r: Repository) -> str | None:
        """What field a project is in, by its README and what it imports."""
        imports = r.results.select(F.explode("imports").alias("i")).select(F.col("i.module").alias("module"))
        return roles.infer_domain(r.files.select("path", "content"), imports).first()["domain"]

    def explore(self, r: Repository, query: str = "", role: str = "pm") -> dict:
        """Scan report, the chapters that fit the question best (or the hubs), and diagnoses of the question."""
        report = self.scan_report(r, role)
        about = r.modules.select("name", F.array_join("files", " ").alias("body"), business_name(F.col("name")).alias("title"), F.col("ord"))
        names = [x["name"] for x in search.match_modules(about, query).collect()] if query.strip() else []
        if not names:
            hubs = graph.hub_scores(r.module_list, r.module_edges).orderBy(F.desc("score"), "ord").limit(5).collect()
            names = [h["name"] for h in hubs if h["score"] > 0] or [h["name"] for h in hubs[:3]]
        chapters = [self.chapter(r, n) for n in names[:5]]
        found = [self.diagnose(r, query)] if query.strip() else []
        return {"report": report, "chapters": chapters, "diagnoses": found, "mermaid": report["mermaid"], "locations": [x for f in found for x in f["locations"]]}

    def blueprint(self, r: Repository, path: str, text: dict | None = None, version: int = 2) -> str:
        """A report as one page: version 1 a still drawing, version 2 one to move about in, by flows where there are any."""
        places, links = graph.core_and_rest(r.module_list, r.module_edges)
        cards = places.select(F.col("place").alias("name"), "core").distinct().join(r.modules.select("name", "total_lines"), "name", "left").select("name", F.coalesce(graph.size_health(F.col("total_lines")), F.lit("green")).alias("health"), business_name(F.col("name")).alias("summary"))
        shown, lines = [x.asDict() for x in cards.orderBy("name").collect()], [x.asDict() for x in links.withColumn("verb", connection_verb(F.col("dst"))).collect()]
        if version == 1:
            return render.write_blueprint(path, r.url, shown, lines, text)
        return render.write_page(path, render.interactive_blueprint(r.url, shown, lines, text))

    def summarize(self, r: Repository, answer: object = None) -> dict:
        """A summary for the blueprint: a model's answer where it is given and sound, else by rules."""
        def rules() -> dict:
            project = self.spark.range(1).select(project_name(F.lit(r.url))).first()[0]
            return summary.rule_summary(project, r.modules, r.results, r.module_edges)

        return rules() if answer is None else summary.read_summary(answers.json_object(answer) if isinstance(answer, str) else answer, rules)

    def summary_prompt(self, r: Repository) -> str:
        """What a model is given to write the summary that summarize() reads."""
        return summary.summary_prompt(self.summarize(r))

    def save_summary(self, r: Repository, answer: object, path: str) -> str:
        write_json(path, self.summarize(r, answer))
        return path

    def feedback(self, r: Repository, module: str, question: str, answer_summary: str, confidence: float = 0.9, follow_ups: list[str] | None = None) -> dict:
        """Keeps how a question about a module was answered; modules are called by their name or directory."""
        known = r.modules.filter((F.col("name") == module) | (F.col("dir_path") == module)).select("name").limit(1).collect()
        if not known:
            return {"status": "error", "error": f"模块「{module}」不存在", "available_modules": [x["name"] for x in r.modules.filter("not is_special").orderBy("ord").limit(CARDS).collect()]}
        more = follow_ups or []
        self.remember(r.url, known[0]["name"], "qa", question, answer_summary, confidence, more)
        return {"status": "ok", "message": f"已记录：模块「{module}」的 Q&A 交互。置信度 {confidence:.0%}，后续追问方向 {len(more)} 个。"}

    def follow(self, url: str, listing, save):
        """A watch of a repository, one at a time for each: start(), look(), status(), stop() are its own."""
        from ..streaming.watch import Watch

        if url not in self.watches:
            self.watches[url] = Watch(self.spark, listing, save)
        return self.watches[url]

    def watch(self, url: str, stream: DataFrame, checkpoint: str, **trigger):
        """A watch by a stream of edits (path, content, at), which goes on where it was stopped; a running one stays."""
        from ..streaming import edits

        if url not in self.streams or not self.streams[url].isActive:
            self.streams[url] = edits.follow(stream, self.store, url, checkpoint, **trigger)
        return self.streams[url]

    def unwatch(self, url: str) -> dict:
        """Stops such a watch; what it reports, or that there was none."""
        from ..streaming import edits

        query = self.streams.pop(url, None)
        if query is None:
            return {"status": "error", "error": "没有正在进行的监听"}
        query.stop()
        return {"status": "ok", **edits.progress(query)}

    def unfollow(self, url: str) -> dict:
        """Stops a repository's watch; what it had seen, or that there was none."""
        watch = self.watches.pop(url, None)
        if watch is None:
            return {"status": "error", "error": "没有正在进行的监听"}
        watch.stop()
        return {"status": "ok", **watch.status()}

    def watching(self) -> dict:
        from ..streaming import edits

        return {url: watch.status() for url, watch in self.watches.items()} | {url: edits.progress(q) for url, q in self.streams.items()}

    # -- memory and terms

    def end_session(self, url: str, session_id: str) -> dict:
        """What was found and what stays open of a session, kept with the last ones: and what was asked about most."""
        log = self.log(url)
        if log is None:
            return {"status": "error", "error": "没有交互记录"}
        findings, unresolved = memory.session_summary(log)
        focus = [x["module_name"] for x in memory.focus_profile(log).orderBy(F.desc("n"), "module_name").limit(5).collect()]
        told = {"findings": [x["summary"] for x in findings.collect()], "unresolved": [x["query"] for x in unresolved.collect()], "focus": focus}
        kinds = "session_id string, ts timestamp, findings array<string>, unresolved array<string>, focus array<string>"
        row = self.spark.createDataFrame([(session_id, None, *told.values())], kinds).withColumn("ts", F.current_timestamp())
        known = self.store.load("sessions", url)
        kept = memory.keep_sessions(row if known is None else known.unionByName(row))  # KEPT_SESSIONS rows
        self.store.save("sessions", url, self.spark.createDataFrame(kept.collect(), kinds))
        return {"status": "ok", **told}

    def remember(self, url: str, module: str, kind: str, query: str, summary: str, confidence: float, follow_ups: list[str] | None = None) -> None:
        more = F.array(*[F.lit(x) for x in follow_ups or []]).cast("array<string>")
        row = self.spark.range(1).select(*memory.record(F.lit(module), kind, F.lit(query), F.lit(summary), F.lit(confidence)), more.alias("follow_ups"), F.lit(time.time_ns()).alias("ord"))
        self.store.save("interactions", url, row, append=True)

    def log(self, url: str) -> DataFrame | None:
        return self.store.load("interactions", url)

    def correct_term(self, url: str, term: str, phrase: str, context: str = "", domain: str = "general") -> None:
        """Kept by repository, so its glossary finds it."""
        row = self.spark.createDataFrame([(term, phrase, context, domain, glossary.CORRECTION, 1.0, 0, time.time_ns())], "source_term string, target_phrase string, context string, domain string, source string, confidence double, usage_count long, ord long")
        self.store.save("terms", url, row, append=True)

    def glossary(self, url: str, domain_pack: DataFrame | None = None, general_pack: DataFrame | None = None) -> DataFrame | None:
        own = self.store.load("terms", url)
        return None if own is None else glossary.resolve(glossary.project_layers(own, domain_pack, general_pack))


def card_text(chapter: dict) -> str:
    if chapter.get("status") != "ok":
        return ""
    lines = [f"## 模块：{chapter['name']}"]
    for c in chapter["cards"]:
        lines += [f"### {c['file_path']}", "- 函数：" + ", ".join(f["name"] for f in c["functions"]), "- 依赖：" + ", ".join(c["imports"])]
    return "\n".join(lines)


def context_text(rows: list[dict]) -> str:
    out = []
    for direction, title in (("seed", "## 匹配到的核心代码位置"), ("upstream", "## 上游调用方（谁调用了这段代码）"), ("downstream", "## 下游调用（这段代码调用了谁）")):
        own = [x for x in rows if x["direction"] == direction]
        if own:
            out += [title, *[f"- **{x['label']}** @ {x['ref']}" + (f"\n```\n{x['snippet']}\n```" if x.get("snippet") else "") for x in own], ""]
    return "\n".join(out)
