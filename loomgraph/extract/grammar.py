"""Facts from syntax trees of grammars, where a machine has them: a visitor that a table of node types drives.

A tree's nodes need type, children, text (bytes), start_point, end_point and child_by_field_name, as the bindings of
such grammars give them. Which grammars work is asked of GrammarHealth, once for a while in each worker.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from .health import GrammarHealth

METHOD, CONFIDENCE = "full", 1.0


class Nodes(NamedTuple):
    """Types of nodes, and the fields of a name, of what a class extends and of parameters."""

    functions: tuple[str, ...]
    classes: tuple[str, ...]
    imports: tuple[str, ...]
    calls: tuple[str, ...]
    name: str | None = "name"
    base: str | None = None
    parameters: str | None = "parameters"


# Fixed: node types of the grammars, by language.
NODES = {
    "python": Nodes(functions=("function_definition",), classes=("class_definition",), imports=("import_statement", "import_from_statement"), calls=("call",), base="superclasses"),
    "typescript": Nodes(functions=("function_declaration", "method_definition", "arrow_function"), classes=("class_declaration",), imports=("import_statement",), calls=("call_expression",), base="heritage"),
    "javascript": Nodes(functions=("function_declaration", "method_definition", "arrow_function"), classes=("class_declaration",), imports=("import_statement",), calls=("call_expression",), base="heritage"),
    "java": Nodes(functions=("method_declaration", "constructor_declaration"), classes=("class_declaration",), imports=("import_declaration",), calls=("method_invocation",), base="superclass"),
    "go": Nodes(functions=("function_declaration", "method_declaration"), classes=("type_declaration",), imports=("import_declaration",), calls=("call_expression",)),
    "cpp": Nodes(functions=("function_definition",), classes=("class_specifier", "struct_specifier"), imports=("preproc_include",), calls=("call_expression",), name="declarator", base="base_class_clause"),
    "rust": Nodes(functions=("function_item",), classes=("struct_item", "impl_item", "enum_item"), imports=("use_declaration",), calls=("call_expression",)),
    "csharp": Nodes(functions=("method_declaration", "constructor_declaration"), classes=("class_declaration",), imports=("using_directive",), calls=("invocation_expression",), base="base_list"),
    "swift": Nodes(functions=("function_declaration", "protocol_function_declaration"), classes=("class_declaration", "protocol_declaration"), imports=("import_declaration",), calls=("call_expression",), parameters=None),
    "ruby": Nodes(functions=("method", "singleton_method"), classes=("class", "module"), imports=("call",), calls=("call", "command_call"), base="superclass"),
    "php": Nodes(functions=("function_definition", "method_declaration"), classes=("class_declaration", "interface_declaration", "trait_declaration"), imports=("namespace_use_declaration",), calls=("function_call_expression", "member_call_expression"), base="base_clause"),
    "kotlin": Nodes(functions=("function_declaration",), classes=("class_declaration", "object_declaration"), imports=("import_header",), calls=("call_expression",), name="simple_identifier", base="delegation_specifiers", parameters="function_value_parameters"),
    "zig": Nodes(functions=("FnDecl", "TestDecl"), classes=("ContainerDecl",), imports=("BuiltinCallExpr",), calls=("CallExpr", "BuiltinCallExpr")),
    "nim": Nodes(functions=("proc_def", "func_def", "method_def", "template_def", "macro_def"), classes=("type_section",), imports=("import_stmt", "from_stmt"), calls=("call",)),
    "v": Nodes(functions=("function_declaration",), classes=("struct_declaration", "interface_declaration", "enum_declaration"), imports=("import_declaration",), calls=("call_expression",)),
    "d": Nodes(functions=("function_declaration",), classes=("class_declaration", "struct_declaration", "interface_declaration"), imports=("import_declaration",), calls=("call_expression",), base="base_class_list"),
    "scala": Nodes(functions=("function_definition", "function_declaration"), classes=("class_definition", "object_definition", "trait_definition"), imports=("import_declaration",), calls=("call_expression",), base="extends_clause"),
    "groovy": Nodes(functions=("method_declaration",), classes=("class_declaration",), imports=("import_declaration",), calls=("method_call",), base="superclass"),
    "clojure": Nodes(functions=("list_lit",), classes=("list_lit",), imports=("list_lit",), calls=("list_lit",), name=None, parameters=None),
    "dart": Nodes(functions=("function_signature", "method_signature"), classes=("class_definition",), imports=("import_or_export",), calls=("call_expression",), base="superclass", parameters="formal_parameter_list"),
    "objc": Nodes(functions=("function_definition", "method_declaration"), classes=("class_interface", "class_implementation", "protocol_declaration"), imports=("preproc_import", "preproc_include"), calls=("call_expression", "message_expression"), name="declarator", base="superclass_reference"),
    "haskell": Nodes(functions=("function",), classes=("class", "data", "newtype"), imports=("import",), calls=("apply",), parameters="patterns"),
    "ocaml": Nodes(functions=("let_binding", "value_definition"), classes=("type_definition", "class_definition", "module_definition"), imports=("open_statement",), calls=("application",), parameters="parameter"),
    "elixir": Nodes(functions=("call",), classes=("call",), imports=("call",), calls=("call",), name=None, parameters="arguments"),
    "erlang": Nodes(functions=("function",), classes=(), imports=("module_attribute",), calls=("call",), parameters="args"),
    "lua": Nodes(functions=("function_declaration", "function_definition", "local_function"), classes=(), imports=("function_call",), calls=("function_call",)),
    "perl": Nodes(functions=("subroutine_declaration_statement",), classes=("package_statement",), imports=("use_statement", "require_statement"), calls=("call_expression", "method_call_expression"), parameters=None),
    "r": Nodes(functions=("function_definition",), classes=(), imports=("call",), calls=("call",)),
    "julia": Nodes(functions=("function_definition", "short_function_definition"), classes=("struct_definition", "abstract_definition"), imports=("import_statement", "using_statement"), calls=("call_expression",), base="supertype_clause"),
    "bash": Nodes(functions=("function_definition",), classes=(), imports=("command",), calls=("command",), parameters=None),
}
# Fixed: words that declare or import where declarations are themselves calls.
FORMS = {"def": "functions", "defp": "functions", "defmacro": "functions", "defn": "functions", "defn-": "functions", "defmodule": "classes", "defrecord": "classes", "defprotocol": "classes", "deftype": "classes"}
IMPORT_CALLS = frozenset(("require", "require_relative", "library", "source", ".", "import", "use", "alias", "@import", "load", "ns"))


def load(name: str):
    """A parser of an installed grammar; raises where there is none."""
    from tree_sitter_language_pack import get_parser  # not a requirement: absent, patterns serve

    return get_parser(name)


HEALTH = GrammarHealth(load)


def _text(node) -> str:
    return node.text.decode("utf-8", "replace") if node is not None else ""


def _field(node, name: str | None):
    """A field; where a grammar has no such field, the first child of that type."""
    if name is None:
        return None
    found = node.child_by_field_name(name)
    return found if found is not None else next((c for c in node.children if c.type == name), None)


def _name(node, field: str | None) -> str:
    found = _field(node, field)
    while found is not None and found.child_by_field_name("declarator") is not None:  # a name within its signature
        found = found.child_by_field_name("declarator")
    return _text(found)


def _last_name(text: str) -> str:
    return re.split(r"\.|::|->", text.strip())[-1].strip()


def _callee(node) -> str:
    """The last part of what is called; chains count by their last call."""
    called = node.child_by_field_name("function") or node.child_by_field_name("method") or node.child_by_field_name("name")
    if called is None:
        called = next(iter(node.children), None)
    for child in called.children if called is not None else ():
        if child.type == "navigation_suffix":
            return _last_name(_text(child))
    return (_last_name(_text(called)) if called is not None else "") or "<unknown>"


def _parameters(node, field: str | None, language: str) -> list[str]:
    if language == "swift":  # label name: Type
        before = [_text(c).split(":")[0].split() for c in node.children if c.type == "parameter" and ":" in _text(c)]
        return [x[-1] for x in before if x and x[-1] != "_"]
    held = _field(node, field)
    out = []
    for child in held.children if held is not None else ():
        if child.type in ("(", ")", ",", "comment"):
            continue
        named = child.child_by_field_name("name") or child.child_by_field_name("pattern")
        text = _text(named if named is not None else child)
        if language == "python":
            text = re.split("[:=]", text)[0].strip()
        if text and text not in ("self", "cls"):
            out.append(text)
    return out


def _docstring(node, language: str) -> str | None:
    body = node.child_by_field_name("body") if language == "python" else None
    first = next((c for c in body.children if c.type != "comment"), None) if body is not None else None
    if first is not None and first.type == "expression_statement":
        first = next(iter(first.children), None)
    if first is None or first.type != "string":
        return None
    return re.sub(r"^[a-zA-Z]*(\"\"\"|'''|\"|')|(\"\"\"|'''|\"|')$", "", _text(first)).strip()


def _python_import(node) -> list[dict]:
    line = node.start_point[0] + 1
    named = [c for c in node.children if c.type in ("dotted_name", "aliased_import", "identifier", "relative_import", "wildcard_import")]
    plain = [_text(c.children[0] if c.type == "aliased_import" and c.children else c) for c in named]
    if node.type == "import_statement":
        return [{"module": x, "names": [], "is_relative": False, "line": line} for x in plain]
    module = plain[0] if plain else ""
    return [{"module": module.lstrip("."), "names": plain[1:], "is_relative": module.startswith("."), "line": line}]


def _module(node) -> str:
    """What an import names: a string, or its text without the words around it."""
    text = _text(node)
    if m := re.search(r"""["'<]([^"'<>]+)["'>]""", text):
        return m[1]
    return re.sub(r"^[@#]?\w+[\s(]+(?:static\s+|struct\s+|class\s+)?", "", text.strip(), count=1).rstrip(";) \n")


def visit(root, language: str) -> dict:
    """Facts in the order of the tree; a function within a class, however deep, has it as its parent."""
    table = NODES[language]
    kinds = {k: frozenset(getattr(table, k)) for k in ("functions", "classes", "imports", "calls")}
    out: dict = {k: [] for k in kinds}
    todo = [(root, None, None)]
    while todo:
        node, cls, func = todo.pop()
        line, last = node.start_point[0] + 1, node.end_point[0] + 1
        words = _text(node).strip("( ").split(None, 2)[:2] if node.type in kinds["calls"] and table.name is None else []
        form = FORMS.get(words[0]) if len(words) > 1 else None
        told = form is not None or table.name is not None
        if node.type in kinds["functions"] and told and form in (None, "functions"):
            name = re.split(r"[(\[]", words[1])[0] if form else _name(node, table.name)
            if name:
                out["functions"].append({
                    "name": name, "params": _parameters(node, table.parameters, language), "return_type": _text(node.child_by_field_name("return_type")) or None, "line_start": line, "line_end": last,
                    "docstring": _docstring(node, language), "is_method": cls is not None, "parent_class": cls,
                })
                func = name
        elif node.type in kinds["classes"] and told and form in (None, "classes"):
            name = words[1] if form else _name(node, table.name) or next((_name(c, "name") for c in node.children if _name(c, "name")), "")
            base = ", ".join(_text(c).strip() for c in node.children if c.type == "inheritance_specifier") if language == "swift" else _text(_field(node, table.base)).strip("() \n")
            if name:
                out["classes"].append({"name": name, "methods": [], "parent_class": base or None, "line_start": line, "line_end": last})
                cls = name
        elif node.type in kinds["imports"] and (node.type not in kinds["calls"] or (words[0] if words else _callee(node)) in IMPORT_CALLS):
            out["imports"] += _python_import(node) if language == "python" else [{"module": _module(node), "names": [], "is_relative": False, "line": line}]
        elif node.type in kinds["calls"]:
            out["calls"].append({"caller_func": func or "<module>", "callee_name": words[0] if words else _callee(node), "line": line})
        todo += [(c, cls, func) for c in reversed(node.children)]
    for c in out["classes"]:
        c["methods"] = [f["name"] for f in out["functions"] if f["parent_class"] == c["name"] and c["line_start"] <= f["line_start"] <= c["line_end"]]
    return out


def extract(parser, source: str, language: str) -> dict:
    return visit(parser.parse(source.encode()).root_node, language) | {"parse_method": METHOD, "parse_confidence": CONFIDENCE}
