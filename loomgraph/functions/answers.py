"""Texts that a model gave or is to be given: parsing of answers, and assembly of contexts under a budget."""

from __future__ import annotations

import json
import re

CONTEXT_CHARS = 60_000


def json_object(text: str) -> dict | None:
    """The whole text, what a fence encloses, or the outermost braces: the first that is an object."""
    fence = re.search(r"```(?:json)?\s*\n?(.*?)```", text, re.DOTALL)
    brace = re.search(r"\{.*\}", text, re.DOTALL)
    for part in (text, fence and fence[1], brace and brace[0]):
        try:
            found = json.loads(part) if part else None
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def sections(markdown: str) -> dict[str, str]:
    """Texts by heading."""
    found = re.split(r"^#{1,6}\s+(.+?)\s*$", markdown, flags=re.MULTILINE)
    return {h.strip(): t.strip() for h, t in zip(found[1::2], found[2::2], strict=True)}


def table(markdown: str) -> list[dict[str, str]]:
    """The first table's rows by column."""
    rows = [[c.strip() for c in line.strip().strip("|").split("|")] for line in markdown.splitlines() if line.strip().startswith("|")]
    body = [r for r in rows[1:] if not all(re.fullmatch(":?-+:?", c) for c in r)]
    return [dict(zip(rows[0], r, strict=False)) for r in body] if rows else []


def steps(markdown: str) -> list[str]:
    return [m[1].strip() for m in re.finditer(r"^\s*(?:\d+[.)]|[-*])\s+(.+)$", markdown, re.MULTILINE)]


def diff_blocks(markdown: str) -> list[dict[str, str]]:
    """(file, diff_content) of fenced diffs; the file is the one that the block names or that was named last."""
    out, named = [], ""
    for m in re.finditer(r"```diff\s*\n(.*?)```|`([^`\s]+\.\w+)`", markdown, re.DOTALL):
        if m[2]:
            named = m[2]
            continue
        own = re.search(r"^\+\+\+ (?:b/)?(\S+)", m[1], re.MULTILINE)
        out.append({"file": own[1] if own else named, "diff_content": m[1].rstrip("\n") + "\n"})
    return out


def code_answer(text: str) -> dict:
    """changes, diffs, impact and steps of an answer, as JSON or Markdown; empty lists where nothing is found."""
    found = json_object(text)
    if found is not None:
        return {"changes": found.get("change_summary", []), "diffs": found.get("diff_blocks", found.get("diffs", [])), "impact": found.get("blast_radius", []), "steps": found.get("verification_steps", []), "format": "json"}
    by = sections(text)
    at = lambda *words: next((t for h, t in by.items() if any(w in h.lower() for w in words)), "")
    return {"changes": table(at("summary", "变更")) or steps(at("summary", "变更")), "diffs": diff_blocks(text), "impact": table(at("impact", "blast", "影响")) or steps(at("impact", "blast", "影响")), "steps": steps(at("verif", "验证", "test")), "format": "markdown"}


def fill_budget(parts: list[tuple[str, str]], budget: int = CONTEXT_CHARS) -> tuple[str, list[str]]:
    """(text, labels): texts (label, text) in order of priority as far as the budget goes. One that is too large is
    left out and smaller ones after it may still fit, but of a run of `neighbour` texts the first that doesn't fit
    ends the run. What fits depends on what was left out before, so this is a fold over a handful of texts."""
    out, labels, ended = [], [], set()
    for label, text in parts:
        run = label.split(":")[0] if label.startswith("neighbour") else None
        if not text or run in ended:
            continue
        if len(text) > budget:
            ended.add(run)
            ended.discard(None)
            continue
        out.append(text)
        labels.append(label)
        budget -= len(text)
    return "\n".join(out), labels


def clip(lines: list[str], first: int, last: int, margin: int = 30, whole: int = 500) -> tuple[int, list[str]]:
    """(number of the first line, lines): a short file as a whole, else the stretch with a margin."""
    if len(lines) <= whole:
        return 1, lines
    lo = max(1, first - margin)
    return lo, lines[lo - 1 : min(len(lines), last + margin)]


def numbered(lines: list[str], first: int = 1) -> str:
    return "\n".join(f"{k:4d} | {x}" for k, x in enumerate(lines, first))
