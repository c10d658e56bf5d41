"""Unified diffs: parsing, checks against file tables, repair and application.

A diff is one small text, so it is read as a whole; diffs come as rows and files as a table, and both meet by path.
"""

from __future__ import annotations

import re
import subprocess
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dealt

HUNK = re.compile(r"@@\s*-(\d+)(?:,(\d+))?\s*\+(\d+)(?:,(\d+))?\s*@@")
#: Lines either way of the stated place that are searched before the whole file.
NEARBY = 20
#: Windows are held against the hashes that are asked for in their own file, while these are so few.
FEW = 64


@dataclass
class Hunk:
    old_start: int
    old_count: int
    new_start: int
    new_count: int
    lines: list[str] = field(default_factory=list)

    def old(self) -> list[str]:
        """Lines that the file must have."""
        return [x[1:] for x in self.lines if x[:1] in (" ", "-")]

    def header(self, shift: int = 0) -> str:
        return f"@@ -{self.old_start + shift},{self.old_count} +{self.new_start + shift},{self.new_count} @@"


@dataclass
class FileDiff:
    old_path: str
    new_path: str
    hunks: list[Hunk] = field(default_factory=list)

    @property
    def path(self) -> str:
        return re.sub("^[ab]/", "", self.old_path if self.new_path == "/dev/null" else self.new_path)


def parse(text: str) -> list[FileDiff]:
    """Files and hunks, of plain and git headers. One pass: each line belongs to what was opened last."""
    out: list[FileDiff] = []
    hunk, titled, lines = None, False, text.splitlines()
    for k, line in enumerate(lines):
        following = lines[k + 1] if k + 1 < len(lines) else ""
        git = re.match("diff --git a/(.+) b/(.+)", line)
        if git:
            out.append(FileDiff("a/" + git[1], "b/" + git[2]))
            hunk, titled = None, True
        elif line.startswith("--- ") and (titled or following.startswith("+++ ")):
            if titled:
                out[-1].old_path = line[4:].strip()
            else:
                out.append(FileDiff(line[4:].strip(), ""))
            hunk = None
        elif line.startswith("+++ ") and hunk is None and out and not out[-1].hunks:
            out[-1].new_path, titled = line[4:].strip(), False
        elif line.startswith("@@"):
            m = HUNK.match(line)
            hunk = Hunk(int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)) if m and out else None
            titled = False
            if hunk:
                out[-1].hunks.append(hunk)
        elif hunk is not None:
            hunk.lines.append(line)
    for h in (h for d in out for h in d.hunks):
        while h.lines and not h.lines[-1]:  # what only ends the text
            h.lines.pop()
    return out


def check_format(text: str) -> tuple[bool, list[str]]:
    """(valid, remarks): empty texts and those without changes or headers fail; changes without a header pass."""
    if not text.strip():
        return False, ["未收到任何代码变更"]
    lines = text.splitlines()
    changed = any(x[:1] in ("+", "-") for x in lines)
    headed = any(x.startswith(("@@", "---", "+++")) for x in lines)
    remarks = [] if changed else ["diff 中没有任何变更行（没有以 + 或 - 开头的行）"]
    if not headed and changed:
        remarks.append("缺少 @@ hunk header，这是简化格式的 diff")
    return changed or headed, remarks


def place_of(lines: list[str], wanted: list[str], hint: int) -> int | None:
    """Where `wanted` stands in a file (from 0), near the hint first; white space at ends of lines aside."""
    have, want = [x.rstrip() for x in lines], [x.rstrip() for x in wanted]
    last = len(have) - len(want)
    near = range(max(0, hint - NEARBY), min(last + 1, hint + NEARBY))
    return next((k for r in (near, range(last + 1)) for k in r if have[k : k + len(want)] == want), None)


def repair(text: str, files: dict[str, str], places: dict[int, int | None] | None = None) -> str | None:
    """The diff with hunks where their lines stand; None where nothing moves or lines can't be found. places: of a diff
    of one file, where hunk_places() has found its hunks; else they are looked for here."""
    out, moved = [], False
    for d in parse(text):
        if d.path not in files:
            continue
        out += [f"--- a/{d.path}", f"+++ b/{d.path}"]
        for n, h in enumerate(d.hunks):
            if places is not None:
                at = None if places.get(n) is None else places[n] - 1
            else:
                at = place_of(files[d.path].splitlines(), h.old(), h.old_start - 1) if h.old() else h.old_start - 1
            if at is None:
                return None
            shift = at - (h.old_start - 1)
            moved |= shift != 0
            out += [h.header(shift), *h.lines]
    return "\n".join(out) + "\n" if moved else None


def mismatches(text: str, files: dict[str, str]) -> list[str]:
    """What a diff expects of files and they don't have."""
    out = []
    for d in parse(text):
        if d.path not in files:
            if any(not (x.startswith(("+", "@@")) or not x.strip()) for h in d.hunks for x in h.lines):
                out.append(f"文件不存在: {d.path}")
            continue
        have = files[d.path].splitlines()
        for h in d.hunks:
            for k, want in enumerate((x[1:] for x in h.lines if not x.startswith("+")), h.old_start - 1):
                if not 0 <= k < len(have):
                    out.append(f"{d.path}: 行号 {k + 1} 超出文件范围（文件共 {len(have)} 行）")
                elif want.rstrip() != have[k].rstrip():
                    out.append(f"{d.path} L{k + 1}: diff 中为 '{want.strip()[:50]}' 但文件中为 '{have[k].strip()[:50]}'")
    return out


def apply(content: str, text: str) -> tuple[str, bool]:
    """A file with a diff's hunks put in, last ones first so that places hold; contexts aren't compared."""
    hunks = [h for d in parse(text) for h in d.hunks] or [h for d in parse("--- a\n+++ a\n" + text) for h in d.hunks]
    lines = content.splitlines()
    for h in reversed(hunks):
        lines[h.old_start - 1 : h.old_start - 1 + len(h.old())] = [x[1:] for x in h.lines if x[:1] in (" ", "+")]
    return ("\n".join(lines), True) if hunks else (content, False)


def assemble(blocks: list[dict]) -> str:
    """One diff of blocks (file, diff_content), with the headers that they lack."""
    out = []
    for b in blocks:
        body = b.get("diff_content", "")
        if not body.strip():
            continue
        if not body.startswith(("--- ", "diff --git")):
            if not any(x.startswith("@@") for x in body.splitlines()):
                n = {c: sum(x.startswith(c) for x in body.splitlines()) for c in "+- "}
                body = f"@@ -1,{n['-'] + n[' ']} +1,{n['+'] + n[' ']} @@\n{body}"
            body = f"--- a/{b.get('file', '')}\n+++ b/{b.get('file', '')}\n{body}"
        out.append(body)
    return "\n".join(out) + "\n" if out else ""


def git_check(root: str, text: str) -> tuple[bool, str]:
    """`git apply --check` in a working tree, on the driver; passes where there is none."""
    try:
        done = subprocess.run(["git", "apply", "--check", "-"], input=text, text=True, cwd=root, capture_output=True, timeout=30)
    except (OSError, subprocess.TimeoutExpired) as e:
        return True, f"skipped: {e}"
    return done.returncode == 0 or "not a git repository" in done.stderr.lower(), done.stderr.strip()


def validate(text: str, files: dict[str, str], places: dict[int, int | None] | None = None) -> dict:
    """Format, then context, then repair of places: valid, message, details, repaired_diff."""
    sound, remarks = check_format(text)
    if not sound:
        return {"valid": False, "message": "format", "details": remarks, "repaired_diff": None}
    wrong = mismatches(text, files)
    if not wrong:
        return {"valid": True, "message": "ok", "details": remarks, "repaired_diff": None}
    fixed = repair(text, files, places)
    if fixed and not mismatches(fixed, files):
        return {"valid": True, "message": "repaired", "details": wrong, "repaired_diff": fixed}
    return {"valid": False, "message": "context", "details": wrong, "repaired_diff": None}


LINES = "diff_id string, path string, hunk int, old_start int, new_start int, pos int, tag string, text string"


def diff_lines(diffs: DataFrame) -> DataFrame:
    """diffs (diff_id, text) as one row per hunk line."""

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in LINES.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            rows = [(i, d.path, n, h.old_start, h.new_start, k, x[:1], x[1:]) for i, t in zip(batch["diff_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for d in parse(t or "") for n, h in enumerate(d.hunks) for k, x in enumerate(h.lines)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 8, kinds, strict=True)], names=names)

    return dealt(diffs.select(F.col("diff_id").cast("string"), "text"), "diff_id").mapInArrow(run, LINES)


def context_mismatches(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(diff_id, path, line, expected, actual) where old lines of many diffs differ from files (path, content). Of each
    file only the lines that diffs ask for move, once; both sides are dealt by path and line: a plain left join."""
    from pyspark.sql import Window

    w = Window.partitionBy("diff_id", "path", "hunk").orderBy("pos")
    old = lines.filter("tag != '+'").withColumn("line", F.col("old_start") + F.row_number().over(w) - 1)
    asked = old.groupBy("path").agg(F.collect_set("line").alias("asked"))  # a file's lines, and those that it lacks
    text = dealt(files.select("path", "content"), "path").join(asked.hint("merge"), "path").select("path", "asked", F.split(F.regexp_replace("content", "\n$", ""), "\n").alias("all"))
    there = F.filter("asked", lambda k: (k >= 1) & (k <= F.size("all")))
    have = text.select("path", F.explode(F.transform(there, lambda k: F.struct(k.alias("line"), F.get("all", (k - 1).cast("int")).alias("actual")))).alias("x")).select("path", "x.line", "x.actual")
    j = old.join(have.hint("merge"), ["path", "line"], "left")
    return j.filter(F.col("actual").isNull() | (F.rtrim("text") != F.rtrim("actual"))).select("diff_id", "path", "line", F.col("text").alias("expected"), "actual")


def hunk_places(lines: DataFrame, files: DataFrame, nearby: int = NEARBY) -> DataFrame:
    """(diff_id, path, hunk, old_start, place): where each hunk's old lines stand in its file, from 1, white space at ends
    of lines aside; null where they don't, or where there is no such file. Of several places the first of those within
    `nearby` lines of the stated one, else the first of all, as place_of() chooses. A hunk without old lines stays.

    Files are cut into windows as long as the hunks that ask for them, each with one hash of its lines' hashes; windows
    and hunks meet by path, length and hash, wherever the hunk says that it stands.
    """
    bare = lambda x: F.regexp_replace(x, r"\s+$", "")
    sized = lines.filter("tag in (' ', '-')").groupBy("diff_id", "path", "hunk", "old_start").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: F.xxhash64(bare(x.text))).alias("want"))
    asked = sized.select("diff_id", "path", "hunk", "old_start", F.size("want").alias("m"), F.xxhash64("want").alias("w"))
    wanted = asked.groupBy("path", "m").agg(F.collect_set("w").alias("ws"))
    text = F.when(F.col("content") == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("content", "\n$", ""), "\n"))
    have = dealt(files.select("path", "content"), "path").select("path", F.transform(text, lambda x: F.xxhash64(bare(x))).alias("h"))
    starts = F.when(F.size("h") >= F.col("m"), F.sequence(F.lit(0), F.size("h") - F.col("m"))).otherwise(F.array().cast("array<int>"))
    each = F.transform(starts, lambda s: F.struct(s.alias("s"), F.xxhash64(F.slice("h", s + 1, F.col("m"))).alias("w")))
    # Where few are asked for, windows that nobody asks for don't leave their file.
    kept = F.filter(each, lambda x: (F.size("ws") > FEW) | F.array_contains("ws", x.w))
    windows = have.hint("merge").join(wanted, "path").select("path", "m", F.explode(kept).alias("x")).select("path", "m", "x.s", "x.w").hint("merge")
    hint = F.col("old_start") - 1
    near = F.col("s").between(hint - nearby, hint + nearby - 1)
    met = asked.join(windows, ["path", "m", "w"]).groupBy("diff_id", "path", "hunk", "old_start").agg((F.min(F.struct(~near, "s")).getField("s") + 1).alias("place"))
    every = lines.select("diff_id", "path", "hunk", "old_start").distinct()
    plain = every.join(sized.select("diff_id", "path", "hunk").hint("merge"), ["diff_id", "path", "hunk"], "left_anti").withColumn("place", F.col("old_start"))
    return sized.drop("want").join(met.hint("merge"), ["diff_id", "path", "hunk", "old_start"], "left").unionByName(plain)


CHECKED = "diff_id string, path string, valid boolean, message string, details array<string>, repaired string, applied string"


def check_diffs(diffs: DataFrame, files: DataFrame) -> DataFrame:
    """One row per diff and file: verdict, repaired diff and the file with it applied. diffs: diff_id, text; a diff is
    split by file first, so each part meets its own file by path. Where hunks stand is found for all of them at once by
    hunk_places()."""

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(i, d.path, f"{i}\0{k}", "\n".join([f"--- {d.old_path}", f"+++ {d.new_path}", *[x for h in d.hunks for x in (h.header(), *h.lines)]]) + "\n") for i, t in zip(batch["diff_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for k, d in enumerate(parse(t or ""))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in list(zip(*rows, strict=True)) or [[]] * 4], names=["diff_id", "path", "part", "text"])

    def check(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for i, p, t, c, found in zip(*(batch[x].to_pylist() for x in ("diff_id", "path", "text", "content", "places")), strict=True):
                v = validate(t, {} if c is None else {p: c}, {x["hunk"]: x["place"] for x in found or ()})
                done = apply(c or "", v["repaired_diff"] or t)[0] if v["valid"] else None
                rows.append((i, p, v["valid"], v["message"], v["details"], v["repaired_diff"], done))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 7, kinds, strict=True)], names=[x.split()[0] for x in CHECKED.split(", ")])

    parts = dealt(diffs.select(F.col("diff_id").cast("string"), "text"), "diff_id").mapInArrow(split, "diff_id string, path string, part string, text string")
    places = hunk_places(diff_lines(parts.select(F.col("part").alias("diff_id"), "text")), files.select("path", "content"))
    by_part = places.groupBy(F.col("diff_id").alias("part")).agg(F.collect_list(F.struct("hunk", "place")).alias("places"))  # a diff's hunks
    met = parts.join(files.select("path", "content").hint("merge"), "path", "left").join(by_part.hint("merge"), "part", "left")
    return met.select("diff_id", "path", "text", "content", "places").mapInArrow(check, CHECKED)
