"""Facts from source files: one pass in Python over each file's text, because it takes parsers.

A fact is a row (path, fact, name, line, end_line, scope, target, attrs, items); fact is symbol, import,
call, flow, type, entity, route, client, entry or doc. Python is parsed with ast, other languages by
line patterns.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from corvane.functions.text import split_parameters

SCHEMA = "path string, fact string, name string, line int, end_line int, scope string, target string, attrs map<string,string>, items array<string>"


def _fact(path: str, fact: str, name: str | None, line: int, end_line: int | None = None, scope: str | None = None, target: str | None = None, items: list[str] | None = None, **attrs: object) -> tuple:
    return (path, fact, name, line, end_line or line, scope, target, {k: str(v) for k, v in attrs.items() if v is not None}, items or [])


# --- documentation ------------------------------------------------------------------------------


def parse_docstring(text: str) -> dict:
    """summary, params {name: (type, text)}, returns_type, returns, raises; reST, Google and NumPy forms."""
    lines = [x.strip() for x in text.strip().splitlines()]
    out: dict = {"summary": " ".join(_until_blank(lines))[:160], "params": {}, "returns": None, "returns_type": None, "raises": []}
    section = None
    for i, line in enumerate(lines):
        if m := re.match(r":param\s+(?:(\S+)\s+)?(\w+)\s*:\s*(.*)", line):
            out["params"][m[2]] = (m[1], m[3])
        elif m := re.match(r":type\s+(\w+)\s*:\s*(.*)", line):
            out["params"][m[1]] = (m[2], out["params"].get(m[1], (None, ""))[1])
        elif m := re.match(r":returns?\s*:\s*(.*)", line):
            out["returns"] = m[1]
        elif m := re.match(r":rtype\s*:\s*(.*)", line):
            out["returns_type"] = m[1]
        elif m := re.match(r":raises?\s+(\S+?)\s*:", line):
            out["raises"].append(m[1])
        elif m := re.match(r"(Args|Arguments|Parameters|Returns|Yields|Raises|Examples?)\s*:?$", line):
            section = m[1].lower()
        elif re.fullmatch(r"-{3,}", line):
            continue
        elif section in ("args", "arguments", "parameters"):
            if m := re.match(r"(\w+)\s+:\s*(\S.*)$", line):
                out["params"][m[1]] = (m[2], "")
            elif m := re.match(r"\*{0,2}(\w+)\s*(?:\(([^)]*)\))?:\s*(.*)", line):
                out["params"][m[1]] = (m[2], m[3])
        elif section in ("returns", "yields") and line and out["returns"] is None:
            m = re.match(r"([\w\[\], .|]+):\s*(.*)", line)
            out["returns_type"], out["returns"] = (m[1], m[2]) if m else (out["returns_type"], line)
        elif section == "raises" and (m := re.match(r"([A-Z]\w+)\s*:?", line)):
            out["raises"].append(m[1])
    return out


def _until_blank(lines: list[str]) -> list[str]:
    out: list[str] = []
    for x in lines:
        if not x or x[0] in ":@":
            break
        out.append(x)
    return out


def parse_jsdoc(text: str) -> dict:
    """The same of a JSDoc block's inside."""
    lines = [re.sub(r"^\s*\*?\s?", "", x) for x in text.splitlines()]
    out: dict = {"summary": " ".join(x.strip() for x in _until_blank([x.strip() for x in lines if x.strip() or True][next((i for i, x in enumerate(lines) if x.strip()), 0) :]))[:160], "params": {}, "returns": None, "returns_type": None, "raises": []}
    for line in lines:
        if m := re.match(r"\s*@param\s+(?:\{([^}]*)\}\s*)?\[?(\w+)[^\s\]]*\]?\s*-?\s*(.*)", line):
            out["params"][m[2]] = (m[1], m[3])
        elif m := re.match(r"\s*@returns?\s+(?:\{([^}]*)\}\s*)?(.*)", line):
            out["returns_type"], out["returns"] = m[1], m[2]
        elif m := re.match(r"\s*@throws?\s+\{?([\w.]+)", line):
            out["raises"].append(m[1])
    return out


def _doc(path: str, owner: str, line: int, doc: dict) -> tuple:
    return _fact(path, "doc", owner, line, items=[f"{n}:{t or ''}" for n, (t, _) in doc["params"].items()][:6], summary=doc["summary"], returns_type=doc["returns_type"], returns=doc["returns"], raises=",".join(doc["raises"][:4]))


# --- Python -------------------------------------------------------------------------------------


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    return _dotted(node.func) if isinstance(node, ast.Call) else _dotted(node.value) if isinstance(node, ast.Subscript) else None


class _Python(ast.NodeVisitor):
    def __init__(self, path: str, source: str) -> None:
        self.path, self.facts, self.scope, self.assigned = path, [], [], [{}]
        self.lines = source.splitlines()

    def add(self, *args: object, **more: object) -> None:
        self.facts.append(_fact(self.path, *args, **more))

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add("import", a.name, node.lineno, kind="import", level=0)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        names = [a.name for a in node.names]
        self.add("import", node.module or "", node.lineno, items=names, kind="import", level=node.level)

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        a = node.args
        params = [x.arg for x in (*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])) if x.arg not in ("self", "cls")]
        signature = f"{node.name}({ast.unparse(a)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
        scope = ".".join(self.scope) or None
        gives = any(isinstance(x, ast.Return) and x.value is not None for x in ast.walk(node))
        self.add("symbol", node.name, node.lineno, node.end_lineno, scope=scope, items=params, kind="function", signature=signature, visibility="private" if node.name.startswith("_") else "public", returns_value=gives)
        if text := ast.get_docstring(node):
            self.facts.append(_doc(self.path, node.name, node.lineno, parse_docstring(text)))
        for d in node.decorator_list:
            if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                verb = d.func.attr
                if verb in ("get", "post", "put", "delete", "patch", "head", "options", "websocket"):
                    self.add("route", d.args[0].value, d.lineno, target=node.name, method=verb.upper())
                elif verb == "route":
                    methods = next((ast.literal_eval(k.value) for k in d.keywords if k.arg == "methods" and isinstance(k.value, ast.List | ast.Tuple)), ["GET"])
                    for m in methods:
                        self.add("route", d.args[0].value, d.lineno, target=node.name, method=str(m).upper())
            self.visit(d)
        self.scope.append(node.name)
        self.assigned.append({x: node.lineno for x in params})
        for x in node.body:
            self.visit(x)
        self.assigned.pop()
        self.scope.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = [b for b in map(_dotted, node.bases) if b]
        self.add("symbol", node.name, node.lineno, node.end_lineno, kind="class", signature=f"class {node.name}({', '.join(bases)})", visibility="private" if node.name.startswith("_") else "public")
        if text := ast.get_docstring(node):
            self.facts.append(_doc(self.path, node.name, node.lineno, parse_docstring(text)))
        for b in bases:
            self.add("type", node.name, node.lineno, target=b.rpartition(".")[2], kind="extends")
        fields = [f"{s.target.id}:{ast.unparse(s.annotation)}" for s in node.body if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name)]
        marks = [d for d in map(_dotted, node.decorator_list) if d]
        model = next((k for k, test in (("pydantic", any(b.endswith("BaseModel") for b in bases)), ("sqlalchemy", any(b.rpartition(".")[2] in ("Base", "DeclarativeBase", "Model", "SQLModel") for b in bases)), ("dataclass", any(m.rpartition(".")[2] == "dataclass" for m in marks))) if test), None)
        if model:
            columns = [f"{t.id}:{(ast.unparse(s.value.args[0]) if s.value.args else '')}" for s in node.body if isinstance(s, ast.Assign) and isinstance(s.value, ast.Call) and (_dotted(s.value.func) or "").endswith("Column") for t in s.targets if isinstance(t, ast.Name)]
            self.add("entity", node.name, node.lineno, items=fields + columns, kind=model)
        for x in node.body:
            self.visit(x)

    def visit_Call(self, node: ast.Call) -> None:
        name = _dotted(node.func)
        if name and self.scope:
            self.add("call", name.rpartition(".")[2], node.lineno, scope=".".join(self.scope))
        if name and name.rpartition(".")[2] in ("get", "post", "put", "delete", "patch") and name.split(".")[0] in ("requests", "httpx", "client", "session") and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
            self.add("client", node.args[0].value, node.lineno, method=name.rpartition(".")[2].upper())
        self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        self.visit(node.value)
        for t in node.targets:
            if isinstance(t, ast.Name):
                self.assigned[-1][t.id] = node.lineno
            else:
                self.visit(t)

    def visit_Name(self, node: ast.Name) -> None:
        at = self.assigned[-1].get(node.id)
        if at is not None and at != node.lineno and isinstance(node.ctx, ast.Load):
            self.add("flow", node.id, at, node.lineno, scope=".".join(self.scope) or None, kind="def-use")


def python_facts(path: str, source: str) -> list[tuple]:
    """Facts of a Python file; none if it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    v = _Python(path, source)
    v.visit(tree)
    if text := ast.get_docstring(tree):
        v.facts.append(_doc(path, "<module>", 1, parse_docstring(text)))
    return v.facts


# --- TypeScript, JavaScript, Rust, Go -----------------------------------------------------------

_TS_SYMBOL = [
    ("function", re.compile(r"^\s*(?P<e>export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<n>\w+)\s*(?P<s>\([^)]*\)?[^{]*)")),
    ("class", re.compile(r"^\s*(?P<e>export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<n>\w+)(?P<s>[^{]*)")),
    ("interface", re.compile(r"^\s*(?P<e>export\s+)?interface\s+(?P<n>\w+)(?P<s>[^{]*)")),
    ("type", re.compile(r"^\s*(?P<e>export\s+)?type\s+(?P<n>\w+)(?P<s>[^=]*)=")),
    ("enum", re.compile(r"^\s*(?P<e>export\s+)?(?:const\s+)?enum\s+(?P<n>\w+)(?P<s>)")),
    ("function", re.compile(r"^\s*(?P<e>export\s+)?(?:const|let|var)\s+(?P<n>\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?P<s>\([^)]*\)(?:\s*:\s*[^=]+)?)\s*=>")),
    ("const", re.compile(r"^(?P<e>export\s+)?(?:const|let|var)\s+(?P<n>\w+)(?P<s>)\s*(?::[^=]+)?=")),
]
_RS_SYMBOL = [
    ("function", re.compile(r"^\s*(?P<e>pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(?P<n>\w+)(?P<s>[^{;]*)")),
    ("class", re.compile(r"^\s*(?P<e>pub(?:\([^)]*\))?\s+)?struct\s+(?P<n>\w+)(?P<s>)")),
    ("enum", re.compile(r"^\s*(?P<e>pub(?:\([^)]*\))?\s+)?enum\s+(?P<n>\w+)(?P<s>)")),
    ("interface", re.compile(r"^\s*(?P<e>pub(?:\([^)]*\))?\s+)?trait\s+(?P<n>\w+)(?P<s>)")),
]
_TS_IMPORT = re.compile(r"""(?:import|export)\s+(?:type\s+)?(?P<names>[\w*{}\s,$]*?)\s*(?:from\s*)?["'](?P<m>[^"']+)["']|(?:require|import)\(\s*["'](?P<r>[^"']+)["']\s*\)""")
_RS_IMPORT = re.compile(r"^\s*(?:pub\s+)?(?:use\s+(?P<m>[\w:]+)|mod\s+(?P<mod>\w+)\s*;)")
_CALL = re.compile(r"(?<![\w.])(?:[\w$]+\.)*([A-Za-z_$][\w$]*)\s*\(")
_WORDS = frozenset("if for while switch catch function return typeof await new super import require match fn let loop async constructor".split())
_ASSIGN = re.compile(r"^\s*(?:(?:const|let|var|let\s+mut)\s+)?([A-Za-z_]\w*)\s*(?::[^=]+)?=(?![=>])\s*(.*)$")
_EXTENDS = re.compile(r"\bclass\s+(\w+)[^{]*?\bextends\s+([\w.]+)|\binterface\s+(\w+)\s+extends\s+([\w.,\s]+?)\s*\{|\bclass\s+(\w+)[^{]*?\bimplements\s+([\w.,\s]+?)\s*\{", re.S)
_ALIAS = re.compile(r"\btype\s+(\w+)\s*(?:<[^>]*>)?\s*=\s*([A-Z]\w*)\s*;?")
_JS_ROUTE = re.compile(r"""\b(?:app|router|api|server|route[rs]?)\.(get|post|put|delete|patch|head|options|all|use|ws)\(\s*["'`]([^"'`]+)["'`]\s*,?\s*(\w+)?""")
_CLIENT = re.compile(r"""\b(?:fetch|(?:axios|api|client|http|ky)(?:\.(get|post|put|delete|patch))?)\(\s*["'`]([^"'`$]+)["'`](?:\s*,\s*\{[^}]*?method\s*:\s*["'](\w+)["'])?""")
_RS_ROUTE = re.compile(r"""#\[(get|post|put|delete|patch)\("([^"]+)"\)\]|\.route\(\s*"([^"]+)"\s*,\s*(get|post|put|delete|patch)\((\w+)\)""")
_GO_ROUTE = re.compile(r"""\b\w+\.(GET|POST|PUT|DELETE|PATCH|HandleFunc|Handle|Get|Post|Put|Delete|Patch)\(\s*"([^"]+)"\s*,\s*([\w.]+)?""")
_RPC = re.compile(r"^\s*rpc\s+(\w+)\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(?:stream\s+)?([\w.]+)")


def _blocks(source: str) -> list[tuple[int, int, str]]:
    """(first line, last line, inside) of JSDoc blocks."""
    return [(source.count("\n", 0, m.start()) + 1, source.count("\n", 0, m.end()) + 1, m[1]) for m in re.finditer(r"/\*\*(.*?)\*/", source, re.S)]


def body_end(lines: list[str], at: int) -> int:
    """Line, from 1, at which the braces that open at line `at` or after it are closed again."""
    depth, opened = 0, False
    for i in range(at - 1, len(lines)):
        for c in re.sub(r"//.*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", "", lines[i]):
            depth += (c == "{") - (c == "}")
            opened |= c == "{"
        if opened and depth <= 0:
            return i + 1
        if not opened and i - at > 2:
            return at
    return len(lines)


def script_facts(path: str, source: str, language: str) -> list[tuple]:
    """Facts of a TypeScript, JavaScript or Rust file, by patterns over its lines."""
    rust = language == "rs"
    lines, facts = source.splitlines(), []
    symbols: list[tuple[int, str, int]] = []
    blocks = _blocks(source)
    for n, line in enumerate(lines, 1):
        if line.lstrip().startswith(("//", "*", "/*")):
            continue
        for kind, pattern in _RS_SYMBOL if rust else _TS_SYMBOL:
            if m := pattern.match(line):
                name, open_to = m["n"], bool(m["e"])
                if kind == "function" and language in ("tsx", "jsx") and name[:1].isupper():
                    kind = "component"
                end = body_end(lines, n) if kind in ("function", "class", "component", "interface") else n
                inside = re.search(r"\((.*)\)", m["s"] or "")
                params = [re.split(r"[:=?]", p.lstrip(".").replace("&mut ", "").replace("&", "").replace("mut ", ""))[0].strip() for p in split_parameters(inside[1])] if inside else []
                facts.append(_fact(path, "symbol", name, n, end, items=[p for p in params if p != "self"], kind=kind, signature=f"{name}{' ' * (m['s'] or '').strip()[:1].isalnum()}{(m['s'] or '').strip()}", visibility="private" if name.startswith("_") else "public" if open_to else "internal"))
                if kind in ("function", "component"):
                    symbols.append((n, name, end))
                above = [b for b in blocks if b[1] < n and all(not lines[k - 1].strip() or lines[k - 1].strip().startswith("@") for k in range(b[1] + 1, n))]
                if above:
                    facts.append(_doc(path, name, n, parse_jsdoc(above[-1][2])))
                break
    heads = {n for n, _, _ in symbols}

    def scope_of(n: int) -> str | None:
        own = [s for s in symbols if s[0] <= n]
        return own[-1][1] if own else None

    assigned: dict[str, int] = {}
    for n, line in enumerate(lines, 1):
        if rust:
            if m := _RS_IMPORT.match(line):
                facts.append(_fact(path, "import", m["m"] or f"self::{m['mod']}", n, kind="import", level=0))
        code = re.sub(r"//.*", "", line)
        if n in heads:
            assigned = {}
            code = code.partition("{")[2] or code.partition("=>")[2]
        for m in _CALL.finditer("" if code.lstrip().startswith("#[") else code):
            if m[1] not in _WORDS and scope_of(n):
                facts.append(_fact(path, "call", m[1], n, scope=scope_of(n)))
        m = _ASSIGN.match(code)
        for w in sorted(set(re.findall(r"[A-Za-z_]\w*", m[2] if m else code)) & assigned.keys()):
            facts.append(_fact(path, "flow", w, assigned[w], n, scope=scope_of(n), kind="def-use"))
        if m:
            assigned[m[1]] = n
    for pattern, fact in ((_JS_ROUTE, "route"), (_CLIENT, "client")) if not rust else ():
        for m in pattern.finditer(source):
            at = source.count("\n", 0, m.start()) + 1
            if fact == "route":
                facts.append(_fact(path, fact, m[2], at, target=m[3], method=m[1].upper()))
            else:
                facts.append(_fact(path, fact, m[2], at, method=(m[1] or m[3] or "get").upper()))
    if rust:
        for m in _RS_ROUTE.finditer(source):
            facts.append(_fact(path, "route", m[2] or m[3], source.count("\n", 0, m.start()) + 1, target=m[5], method=(m[1] or m[4]).upper()))
        return facts
    for m in _TS_IMPORT.finditer(source):
        names = re.findall(r"\w+", m["names"] or "")
        out = source[m.start() :].startswith("export")
        facts.append(_fact(path, "import", m["m"] or m["r"], source.count("\n", 0, m.start()) + 1, items=names, kind="reexport" if out else "import", level=0))
    for m in _EXTENDS.finditer(source):
        at = source.count("\n", 0, m.start()) + 1
        for a, b, kind in ((m[1], m[2], "extends"), (m[3], m[4], "extends"), (m[5], m[6], "implements")):
            for target in re.split(r"\s*,\s*", b or ""):
                if a and target:
                    facts.append(_fact(path, "type", a, at, target=target.strip(), kind=kind))
    for m in _ALIAS.finditer(source):
        facts.append(_fact(path, "type", m[1], source.count("\n", 0, m.start()) + 1, target=m[2], kind="alias"))
    facts += script_entities(path, source)
    return facts


def _members(body: str) -> list[str]:
    found = re.findall(r"^\s*(?:readonly\s+|public\s+|private\s+)?(\w+)(\??)\s*!?:\s*([^;,\n]+)", body, re.M)
    return [f"{n}{o}:{t.strip()}" for n, o, t in found]


def _body(source: str, at: int, opening: str = "{", closing: str = "}") -> str:
    start = source.find(opening, at)
    if start < 0:
        return ""
    depth = 0
    for i in range(start, len(source)):
        depth += (source[i] == opening) - (source[i] == closing)
        if depth == 0:
            return source[start + 1 : i]
    return source[start + 1 :]


def script_entities(path: str, source: str) -> list[tuple]:
    """Entities of TypeScript: drizzle tables, TypeORM classes, interfaces, zod objects, GraphQL templates."""
    out = []
    at = lambda m: source.count("\n", 0, m.start()) + 1
    for m in re.finditer(r"(?:const|let)\s+(\w+)\s*=\s*(?:pg|mysql|sqlite)Table\(", source):
        fields = [f"{n}:{t}" for n, t in re.findall(r"^\s*(\w+)\s*:\s*(\w+)\(", _body(source, m.end() - 1), re.M)]
        out.append(_fact(path, "entity", m[1], at(m), items=fields, kind="drizzle"))
    for m in re.finditer(r"@Entity\([^)]*\)\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)", source):
        out.append(_fact(path, "entity", m[1], at(m), items=_members(_body(source, m.end())), kind="typeorm"))
    for m in re.finditer(r"(?:export\s+)?interface\s+(\w+)", source):
        out.append(_fact(path, "entity", m[1], at(m), items=_members(_body(source, m.end())), kind="interface"))
    for m in re.finditer(r"(?:const|let)\s+(\w+)\s*=\s*z\.object\(", source):
        fields = [f"{n}:{t}" for n, t in re.findall(r"^\s*(\w+)\s*:\s*z\.(\w+)", _body(source, m.end() - 1), re.M)]
        out.append(_fact(path, "entity", m[1], at(m), items=fields, kind="zod"))
    for m in re.finditer(r"gql`([^`]*)`", source):
        out += [(p, f, n, line + at(m) - 1, e, s, t, a, i) for p, f, n, line, e, s, t, a, i in graphql_facts(path, m[1])]
    return out


def graphql_facts(path: str, source: str) -> list[tuple]:
    return [_fact(path, "entity", m[1], source.count("\n", 0, m.start()) + 1, items=[f"{n}:{t}" for n, t in re.findall(r"^\s*(\w+)(?:\([^)]*\))?\s*:\s*([\w\[\]!]+)", _body(source, m.end()), re.M)], kind="graphql") for m in re.finditer(r"^\s*(?:type|input)\s+(\w+)", source, re.M) if m[1] not in ("Query", "Mutation", "Subscription")]


def prisma_facts(path: str, source: str) -> list[tuple]:
    return [_fact(path, "entity", m[1], source.count("\n", 0, m.start()) + 1, items=[f"{n}:{t}" for n, t in re.findall(r"^\s*(\w+)\s+(\w+[\[\]?]*)", _body(source, m.end()), re.M)], kind="prisma") for m in re.finditer(r"^\s*model\s+(\w+)", source, re.M)]


def sql_facts(path: str, source: str) -> list[tuple]:
    out = []
    for m in re.finditer(r"create\s+table\s+(?:if\s+not\s+exists\s+)?[\"`\[]?([\w.]+)", source, re.I):
        columns = [re.match(r"[\"`\[]?(\w+)[\"`\]]?\s+([\w()]+)", c) for c in split_parameters(_body(source, m.end(), "(", ")"))]
        fields = [f"{c[1]}:{c[2]}" for c in columns if c and c[1].lower() not in ("primary", "foreign", "unique", "constraint", "check", "key")]
        out.append(_fact(path, "entity", m[1], source.count("\n", 0, m.start()) + 1, items=fields, kind="sql"))
    return out


def go_facts(path: str, source: str) -> list[tuple]:
    method = {"HandleFunc": "ALL", "Handle": "ALL"}
    out = [_fact(path, "route", m[2], source.count("\n", 0, m.start()) + 1, target=m[3], method=method.get(m[1], m[1].upper())) for m in _GO_ROUTE.finditer(source)]
    out += [_fact(path, "symbol", m[1], source.count("\n", 0, m.start()) + 1, kind="function", signature=m[0].strip(), visibility="public" if m[1][0].isupper() else "internal") for m in re.finditer(r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\([^)]*\)", source, re.M)]
    return out


def proto_facts(path: str, source: str) -> list[tuple]:
    return [_fact(path, "route", m[1], n, target=m[3], method="RPC", request=m[2]) for n, line in enumerate(source.splitlines(), 1) if (m := _RPC.match(line))]


def facts_of(path: str, source: str | None) -> list[tuple]:
    """All facts of a file, by its extension; null and unknown files have none."""
    ext = path.rsplit(".", 1)[-1].lower() if path and "." in path else ""
    if not source:
        return []
    if ext == "py":
        return python_facts(path, source)
    if ext in ("ts", "tsx", "js", "mjs", "cjs", "jsx", "rs"):
        return script_facts(path, source, {"mjs": "js", "cjs": "js"}.get(ext, ext))
    more = {"go": go_facts, "graphql": graphql_facts, "gql": graphql_facts, "prisma": prisma_facts, "sql": sql_facts, "proto": proto_facts}
    return more[ext](path, source) if ext in more else []


def extract_facts(files: DataFrame) -> DataFrame:
    """Facts of files (path, content); each file is read and parsed once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "fact", "name", "line", "end_line", "scope", "target", "attrs", "items"]
        for batch in batches:
            rows = [f for p, c in zip(batch["path"], batch["content"]) for f in facts_of(p, c)]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, SCHEMA)
