"""Facts from tokens, for languages without a syntax tree here and for Python that doesn't parse.

A source is cut into names, strings and signs once; comments go, and what stands in strings is never taken for code.
Braces and parentheses know their partners, lines their indentation. Declarations are read from these tokens by a
reader for each family of languages, which yields (kind, row) of what it finds.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

METHOD, FAILED = "partial", "failed"

# Fixed: how far the facts of a language can be trusted; others have the last.
CONFIDENCE = {"python": 0.8, "typescript": 0.7, "javascript": 0.7, "tsx": 0.7, "go": 0.7, "rust": 0.65, "java": 0.65}
CONFIDENCE_ELSE = 0.5
# Fixed: words that stand before a parenthesis without being called.
NOT_CALLED = frozenset(("if", "for", "while", "with", "except", "elif", "return", "yield", "assert", "print", "def", "class", "import", "from", "and", "or", "not", "in", "is", "lambda", "raise", "del", "switch", "catch", "new", "function", "func", "fn", "match", "case", "await", "typeof", "sizeof", "synchronized", "super", "else", "do", "loop", "async", "pub"))
# Fixed: words that declare functions and types in languages without a reader of their own.
ANY_FUNCTION = frozenset(("def", "fn", "func", "function", "fun", "sub", "proc", "method", "subroutine"))
ANY_TYPE = frozenset(("class", "struct", "interface", "trait", "enum", "module", "object", "type", "protocol"))
ANY_IMPORT = frozenset(("import", "include", "require", "use", "using"))

HASH_COMMENTS = frozenset(("python", "ruby", "perl", "r", "julia", "elixir", "nim", "bash", "php"))
DASH_COMMENTS = frozenset(("lua", "haskell"))


@dataclass(slots=True)
class Token:
    kind: str  # name, string, sign
    text: str
    at: int
    line: int
    partner: int = -1  # of a brace or parenthesis: the token that closes (or opens) it
    depth: int = 0  # braces around it


@lru_cache(64)
def _cutter(language: str) -> re.Pattern:
    comments = [r"\#[^\n]*"] if language in HASH_COMMENTS else [r"--[^\n]*"] if language in DASH_COMMENTS else [r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"]
    strings = [r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'"]
    if language in ("python", "java", "kotlin", "swift", "scala", "julia", "elixir", "groovy"):
        strings.insert(0, r'"""(?:\\.|[^\\])*?(?:"""|\Z)')
    if language == "python":
        strings.insert(1, r"'''(?:\\.|[^\\])*?(?:'''|\Z)")
    if language in ("typescript", "javascript", "tsx"):
        strings += [r"`(?:\\.|[^`\\])*`?", r"(?<=[=(,:!&|?\[;{}])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/"]
    elif language == "go":
        strings.append(r"`[^`]*`?")
    elif language == "rust":
        strings = [r'b?r(?P<_h>\#*)".*?"(?P=_h)', r'"(?:\\.|[^"\\])*"?', r"'(?:\\[^\n]{1,8}?|[^'\\\n])'"]
    return re.compile(f"(?P<comment>{'|'.join(comments)})|(?P<string>{'|'.join(strings)})|(?P<name>[^\\W\\d]\\w*)|(?P<sign>=>|->|\\S)", re.DOTALL)


class Source:
    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.lines = text.split("\n")
        self.tokens: list[Token] = []
        open_: list[int] = []
        depth, line, end = 0, 1, text.find("\n")
        for m in _cutter(language).finditer(text):
            kind = m.lastgroup
            if kind == "comment":
                continue
            at = m.start()
            while 0 <= end < at:
                line, end = line + 1, text.find("\n", end + 1)
            t = Token(kind, m.group(), at, line, -1, depth)
            if kind != "sign":
                pass
            elif t.text in "({[":
                open_.append(len(self.tokens))
                depth += t.text == "{"
            elif t.text in ")}]":
                want = {")": "(", "}": "{", "]": "["}[t.text]
                while open_ and self.tokens[open_[-1]].text != want:  # one that nothing closes
                    depth -= self.tokens[open_.pop()].text == "{"
                if open_:
                    t.partner = open_.pop()
                    self.tokens[t.partner].partner = len(self.tokens)
                    depth -= t.text == "}"
                t.depth = depth
            self.tokens.append(t)

    def __getitem__(self, k: int) -> str:
        return self.tokens[k].text if 0 <= k < len(self.tokens) else ""

    def is_name(self, k: int) -> bool:
        return 0 <= k < len(self.tokens) and self.tokens[k].kind == "name"

    def starts_line(self, k: int) -> bool:
        return k == 0 or self.tokens[k - 1].line < self.tokens[k].line

    def indent(self, line: int) -> int:
        x = self.lines[line - 1]
        return len(x) - len(x.lstrip())

    def rest_of_line(self, k: int) -> str:
        """What follows token k on its line."""
        t = self.tokens[k]
        return self.text[t.at + len(t.text) :].split("\n", 1)[0].strip()

    def after(self, k: int) -> int:
        """The token behind a parenthesis or brace that opens at k."""
        end = self.tokens[k].partner if k < len(self.tokens) else -1
        return end + 1 if end >= 0 else len(self.tokens)

    def body(self, k: int) -> int:
        """The brace that opens the body of what is declared from token k on; -1 where a semicolon comes first."""
        while k < len(self.tokens):
            if self[k] == "{":
                return k
            if self[k] in (";", "}"):
                return -1
            k = self.after(k) if self[k] in ("(", "[") else k + 1
        return -1

    def brace_end(self, k: int) -> int:
        """Line where the body of what is declared at token k ends: its own without a body, the last if unclosed."""
        b = self.body(k)
        if b < 0:
            return self.tokens[k].line if k < len(self.tokens) else len(self.lines)
        end = self.tokens[b].partner
        return self.tokens[end].line if end >= 0 else len(self.lines)

    def indent_end(self, line: int) -> int:
        """Last line with code that stands deeper than `line`, before one that doesn't; lines inside strings and
        parentheses don't count, nor do comments."""
        indent, last, wrapped = self.indent(line), line, 0
        for k in range(self._first_after(line), len(self.tokens)):
            t = self.tokens[k]
            if t.line >= wrapped and self.starts_line(k) and self.indent(t.line) <= indent:
                break
            last = max(last, t.line + t.text.count("\n"))
            if t.text in ("(", "[", "{") and t.partner >= 0:
                wrapped = max(wrapped, self.tokens[t.partner].line + 1)
        return last

    def _first_after(self, line: int) -> int:
        k = bisect_right(self.tokens, line, key=lambda t: t.line)
        # a head over several lines: what its parentheses hold belongs to it
        first = bisect_right(self.tokens, line - 1, key=lambda t: t.line)
        for j in range(first, k):
            if self[j] == "(" and self.tokens[j].partner >= k:
                k = self.tokens[j].partner + 1
                while k < len(self.tokens) and self.tokens[k].line == self.tokens[k - 1].line:
                    k += 1
        return k

    def parameters(self, k: int) -> list[str]:
        """Names, with their stars, of what stands between the parenthesis at k and its partner."""
        end, out, j = self.after(k) - 1, [], k + 1
        while j < end:
            mark = ""
            while self[j] in ("*", "/", "&"):
                mark, j = mark + self[j], j + 1
            if self.is_name(j) and self[j] not in ("self", "cls") and mark != "/":
                out.append(mark + self[j])
            while j < end and self[j] != ",":
                j = self.after(j) if self[j] in ("(", "[", "{") else j + 1
            j += 1
        return out


def _function(s: Source, k: int, name: str, end: int, params=(), is_method: bool = False, parent: str | None = None) -> tuple:
    return "functions", {"name": name, "params": list(params), "return_type": None, "line_start": s.tokens[k].line, "line_end": end, "docstring": None, "is_method": is_method, "parent_class": parent}


def _class(s: Source, k: int, name: str, end: int, methods=(), parent: str | None = None) -> tuple:
    return "classes", {"name": name, "methods": list(methods), "parent_class": parent, "line_start": s.tokens[k].line, "line_end": end}


def _import(s: Source, k: int, module: str, names=(), relative: bool = False) -> tuple:
    return "imports", {"module": module, "names": list(names), "is_relative": relative, "line": s.tokens[k].line}


def _upto(s: Source, k: int, sign: str) -> str:
    """The text between token k and the next `sign`, on one line's worth of blanks."""
    end = s.text.find(sign, s.tokens[k].at)
    return " ".join(s.text[s.tokens[k].at + len(s[k]) : end if end >= 0 else None].split())


def _read_python(s: Source) -> Iterator[tuple]:
    for k, t in enumerate(s.tokens):
        if t.kind != "name" or not (s.starts_line(k) or (s[k - 1] == "async" and s.starts_line(k - 1))):
            continue
        if t.text == "def" and s.is_name(k + 1) and s[k + 2] == "(":
            yield _function(s, k, s[k + 1], s.indent_end(t.line), s.parameters(k + 2), s.indent(t.line) > 0)
        elif t.text == "class" and s.is_name(k + 1):
            end, base = s.indent_end(t.line), None
            if s[k + 2] == "(":
                close = s.after(k + 2) - 1
                stop = next((j for j in range(k + 3, close) if s[j] == ","), close)
                if stop > k + 3:
                    base = s.text[s.tokens[k + 3].at : s.tokens[stop].at if stop < len(s.tokens) else None].strip() or None
            methods, inside = [], 0
            for j in range(k, len(s.tokens) - 1):
                line = s.tokens[j].line
                if line > end:
                    break
                if s[j] == "def" and line > max(t.line, inside):  # not inside another one
                    methods.append(s[j + 1])
                    inside = s.indent_end(line)
            yield _class(s, k, s[k + 1], end, methods, base)
        elif t.text == "import":
            for part in s.rest_of_line(k).split("#")[0].split(","):
                if part.strip():
                    yield _import(s, k, part.split()[0])
        elif t.text == "from" and (m := re.match(r"from\s+(\.*)([\w.]*)\s+import\s+(\(.*?\)|[^\n#]*)", s.text[t.at :], re.DOTALL)):
            yield _import(s, k, m[2], [x.split()[0] for x in m[3].strip("()").split(",") if x.split()], m[1] != "")


def _read_script(s: Source) -> Iterator[tuple]:
    """TypeScript and JavaScript."""
    for k, t in enumerate(s.tokens):
        if t.kind != "name" or s[k - 1] == ".":
            continue
        if t.text == "function" and s.is_name(k + 1 + (s[k + 1] == "*")):
            yield _function(s, k, s[k + 1 + (s[k + 1] == "*")], s.brace_end(k))
        elif t.text in ("const", "let", "var") and s.is_name(k + 1):
            j = k + 2
            while j < len(s.tokens) and s[j] not in ("=", ";", ",") and s[j] not in ("const", "let", "var"):  # a type
                j = s.after(j) if s[j] in ("(", "{", "[") else j + 1
            j += 1 + (s[j + 1] == "async")
            arrow = s.after(j) if s[j] == "(" else j + 1
            if s[j - 1 - (s[j - 1] == "async")] == "=" and s[j] != "function" and s[arrow] == ":":  # the result's type
                arrow = next((a for a in range(arrow, min(arrow + 40, len(s.tokens))) if s[a] in ("=>", ";")), arrow)
            if s[j] == "function" or (s[arrow] == "=>" and (s[j] == "(" or s.is_name(j))):
                yield _function(s, k, s[k + 1], s.brace_end(j) if s[j] == "function" or s[arrow + 1] == "{" else s.tokens[min(arrow + 1, len(s.tokens) - 1)].line)
        elif t.text == "class" and s.is_name(k + 1):
            b = s.body(k)
            heritage = [j for j in range(k + 2, b) if s[j] == "extends"] if b >= 0 else []
            methods, j, end = [], b + 1, s.after(b) - 1 if b >= 0 else 0
            while b >= 0 and j < end:
                if s.is_name(j) and s[j + 1] == "(" and s[j] not in NOT_CALLED and s[j] != "constructor" and s[j - 1] not in (".", "=", "@"):
                    if s.body(s.after(j + 1)) >= 0:
                        methods.append(s[j])
                        yield "declared", (s[j], s.tokens[j].line)
                    j = s.after(j + 1)
                else:
                    j = s.after(j) if s[j] in ("{", "(", "[") else j + 1
            yield _class(s, k, s[k + 1], s.brace_end(k), methods, s[heritage[0] + 1] if heritage else None)
        elif t.text == "import" and s.starts_line(k):
            j = next((j for j in range(k + 1, len(s.tokens)) if s.tokens[j].kind == "string" or s[j] in (";", "import")), -1)
            if j >= 0 and s.tokens[j].kind == "string":
                yield _import(s, k, s[j].strip("'\"`"))
        elif t.text == "require" and s[k + 1] == "(" and k + 2 < len(s.tokens) and s.tokens[k + 2].kind == "string":
            yield _import(s, k, s[k + 2].strip("'\"`"))


def _read_go(s: Source) -> Iterator[tuple]:
    for k, t in enumerate(s.tokens):
        if t.kind != "name" or t.depth or not s.starts_line(k):
            continue
        if t.text == "func":
            j, owner = k + 1, None
            if s[j] == "(":
                close = s.after(j) - 1
                held = [x for x in range(j + 1, close) if s.is_name(x) and not any(s[y] == "[" and y < x < s.after(y) for y in range(j + 1, x))]
                owner, j = s[held[-1]] if held else None, close + 1
            if s.is_name(j):
                yield _function(s, k, s[j], s.brace_end(k), is_method=owner is not None, parent=owner)
        elif t.text == "type" and s.is_name(k + 1) and (kind := s[s.after(k + 2) if s[k + 2] == "[" else k + 2]) in ("struct", "interface") and kind:
            yield _class(s, k, s[k + 1], s.brace_end(k))
        elif t.text == "import":
            last = s.after(k + 1) if s[k + 1] == "(" else min(k + 3, len(s.tokens))
            yield from (_import(s, k, s[j].strip('"`')) for j in range(k + 1, last) if s.tokens[j].kind == "string" and (s[k + 1] == "(" or s.tokens[j].line == t.line))


def _read_rust(s: Source) -> Iterator[tuple]:
    for k, t in enumerate(s.tokens):
        if t.kind != "name" or not s.is_name(k + 1):
            if t.text == "use" and s.starts_line(k) and t.kind == "name":
                yield _import(s, k, _upto(s, k, ";"))
            continue
        if t.text == "fn":
            yield _function(s, k, s[k + 1], s.brace_end(k), is_method=t.depth > 0)
        elif t.text in ("struct", "enum", "trait") and not t.depth:
            yield _class(s, k, s[k + 1], s.brace_end(k))
        elif t.text == "use" and not t.depth and (s.starts_line(k) or s[k - 1] in ("pub", ")")):
            yield _import(s, k, _upto(s, k, ";"))
        elif t.text == "mod" and s[k + 2] == ";":
            yield _import(s, k, s[k + 1])


def _read_java(s: Source) -> Iterator[tuple]:
    for k, t in enumerate(s.tokens):
        if t.kind != "name":
            continue
        if t.text in ("class", "interface", "enum", "record") and s.is_name(k + 1) and s[k - 1] != ".":
            b = s.body(k)
            heritage = [j for j in range(k + 2, b) if s[j] == "extends"] if b >= 0 else []
            yield _class(s, k, s[k + 1], s.brace_end(k), parent=s[heritage[0] + 1] if heritage else None)
        elif t.text == "import" and s.starts_line(k):
            yield _import(s, k, _upto(s, k, ";").removeprefix("static "))
        elif t.depth and s[k + 1] == "(" and t.text not in NOT_CALLED and (s.is_name(k - 1) or s[k - 1] in (">", "]")) and s[k - 1] not in NOT_CALLED and s[s.after(k + 1)] in ("{", ";", "throws", "default"):
            yield _function(s, k, t.text, s.brace_end(k), is_method=True)


def _read_any(s: Source) -> Iterator[tuple]:
    def end(k: int) -> int:
        line = s.tokens[k].line
        braces = any(x.text == "{" and x.kind == "sign" and line <= x.line <= line + 1 for x in s.tokens[k : k + 200])
        return s.brace_end(k) if braces else s.indent_end(line)

    for k, t in enumerate(s.tokens):
        if t.kind != "name":
            continue
        if t.text in ANY_FUNCTION and s.is_name(k + 1) and s[k + 2] in ("(", "[", "<"):
            yield _function(s, k, s[k + 1], end(k))
        elif t.text in ANY_TYPE and s.is_name(k + 1) and (s.starts_line(k) or all(s.is_name(j) for j in range(k - 1, max(k - 4, -1), -1) if s.tokens[j].line == t.line)):
            yield _class(s, k, s[k + 1], end(k))
        elif t.text in ANY_IMPORT and s.indent(t.line) == 0 and (s.starts_line(k) or s[k - 1] == "#" and s.starts_line(k - 1)) and (rest := s.rest_of_line(k)):
            yield _import(s, k, rest.rstrip(";").strip())
        elif t.text == "from" and s.starts_line(k) and s.indent(t.line) == 0 and (m := re.match(r"\S+\s+import\s+(.+)", s.rest_of_line(k))):
            yield _import(s, k, m[1].rstrip(";").strip())


READERS = {"python": _read_python, "typescript": _read_script, "javascript": _read_script, "tsx": _read_script, "go": _read_go, "rust": _read_rust, "java": _read_java}


def _calls(s: Source, functions: list[dict], methods: list[tuple[str, int]]) -> Iterator[dict]:
    """Names before a parenthesis that aren't declared there. The caller is the innermost function around; in Python,
    whose blocks are only guessed here, the module. Names with a leading underscore are left out in Python."""
    python = s.language == "python"
    declared = {(f["name"], f["line_start"]) for f in functions}.union(methods)
    spans = sorted(functions, key=lambda f: (f["line_start"], -f["line_end"]))
    at, around = 0, []
    for k, t in enumerate(s.tokens):
        if t.kind != "name" or s[k + 1] != "(" or t.text in NOT_CALLED or s[k - 1] in ("def", "class", "fn", "func", "function") or (t.text, t.line) in declared or (python and t.text.startswith("_")):
            continue
        if not python:
            while at < len(spans) and spans[at]["line_start"] <= t.line:
                around.append(spans[at])
                at += 1
            around = [f for f in around if f["line_end"] >= t.line]
        yield {"caller_func": around[-1]["name"] if around else "<module>", "callee_name": t.text, "line": t.line}


#: Of languages with a reader of their own: without one of these a source has no facts, so it isn't cut.
MARKS = {"python": ("(", "class", "import"), "typescript": ("(", "=>", "class", "function", "import"), "javascript": ("(", "=>", "class", "function", "import"), "tsx": ("(", "=>", "class", "function", "import"), "go": ("(", "func", "type", "import"), "rust": ("(", "fn", "struct", "enum", "trait", "use", "mod"), "java": ("(", "class", "interface", "enum", "record", "import")}


def extract(source: str, language: str) -> tuple[dict, float]:
    """(facts, confidence). Of languages with a reader of their own calls are told, too."""
    out: dict = {"functions": [], "classes": [], "imports": [], "calls": [], "declared": []}
    if language in MARKS and not any(x in source for x in MARKS[language]):
        del out["declared"]
        return out, CONFIDENCE[language]
    s = Source(source, language)
    for kind, row in READERS.get(language, _read_any)(s):
        out[kind].append(row)
    methods = out.pop("declared")
    if language in READERS:
        out["calls"] = list(_calls(s, out["functions"], methods))
    return out, CONFIDENCE.get(language, CONFIDENCE_ELSE)


#: Fixed: calls of a package's manifest that declare a target, with the folder where it lies unless stated, and its kind.
TARGETS = {"target": ("Sources", "regular"), "executableTarget": ("Sources", "regular"), "testTarget": ("Tests", "test")}


def swift_targets(manifest: str) -> list[dict]:
    """(name, path, type) of a package's targets; each call is read up to its closing parenthesis."""
    s, out = Source(manifest, "swift"), []
    for k, t in enumerate(s.tokens):
        if t.text not in TARGETS or s[k - 1] != "." or s[k + 1] != "(":
            continue
        given, j, end = {}, k + 2, s.after(k + 1) - 1
        while j < end:
            if s.is_name(j) and s[j + 1] == ":" and s.tokens[j + 2].kind == "string":
                given.setdefault(s[j], s[j + 2].strip('"'))
            j = s.after(j) if s[j] in ("(", "[", "{") else j + 1
        if "name" in given:
            folder, kind = TARGETS[t.text]
            out.append({"name": given["name"], "path": given.get("path") or f"{folder}/{given['name']}", "type": kind})
    return out
