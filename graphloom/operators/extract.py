"""Source files to nodes, edges and references, one file at a time in Arrow batches.

Python is read by the interpreter's own parser, Java and scripts by a scan of text whose strings and
comments are blanked, SQL by its statements. A file that can't be read gives its File node and an
error, never a failed job. Ids are made afterwards, as expressions.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import make_id

NODE = "label string, kind string, name string, fqn string, package string, start_line int, end_line int, signature string, docstring string, visibility string, is_static boolean, is_async boolean, return_type string, param_count int, param_names array<string>, method string, route string, cyclomatic int"
REF = "type string, src_kind string, src_fqn string, target_name string, kind_hint string, recv string, recv_type string, import_fqn string, http_method string, ref_line int, call_arity int"
_NODE, _REF = [c.split()[0] for c in NODE.split(", ")], [c.split()[0] for c in REF.split(", ")]
SCHEMA = f"repo string, file string, lang string, error string, nodes array<struct<{', '.join(c.replace(' ', ': ', 1) for c in NODE.split(', '))}>>, refs array<struct<{', '.join(c.replace(' ', ': ', 1) for c in REF.split(', '))}>>, contains array<struct<parent_kind: string, parent_fqn: string, kind: string, fqn: string>>"


class Unit:
    """What one file gives."""

    def __init__(self, path: str, package: str):
        self.path, self.package = path, package
        self.nodes: list[dict] = []
        self.refs: list[dict] = []
        self.contains: list[tuple[str, str, str, str]] = []
        self.node("File", "file", path.rsplit("/", 1)[-1], path, 1, None)

    def node(self, label: str, kind: str, name: str, fqn: str, start: int | None, end: int | None, parent: tuple[str, str] | None = None, **more: Any) -> tuple[str, str]:
        self.nodes.append(dict.fromkeys(_NODE) | {"label": label, "kind": kind, "name": name, "fqn": fqn, "package": self.package, "start_line": start, "end_line": end} | more)
        if label != "File":
            self.contains.append((*(parent or ("file", self.path)), kind, fqn))
        return kind, fqn

    def ref(self, type_: str, src: tuple[str, str], target: str | None, line: int, hint: str = "", **more: Any) -> None:
        self.refs.append(dict.fromkeys(_REF) | {"type": type_, "src_kind": src[0], "src_fqn": src[1], "target_name": target, "kind_hint": hint, "ref_line": line, "call_arity": -1, "recv": "", "recv_type": ""} | more)


# Java and scripts

_BLANK = re.compile(r"\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`|//[^\n]*|/\*[\s\S]*?\*/|(?<=[=(,:\[!&|?;])[ \t]*/(?![*/ ])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_TYPE = r"[\w$.]+(?:<[^;{}()\n]*>)?(?:\[\])*"
_MODIFIERS = r"(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp|transient|volatile|export|declare|readonly|override|async)"
_HEAD = re.compile(rf"^[ \t]*(?:@[\w.]+(?:\([^)\n]*\))?\s+)*((?:{_MODIFIERS}\s+)*)(class|interface|enum|record|@interface)\s+([\w$]+)([^{{;]*)\{{", re.MULTILINE)
_METHOD = {
    "java": re.compile(rf"^[ \t]*((?:@[\w.]+(?:\([^)\n]*\))?\s+)*)((?:{_MODIFIERS}\s+)*)(?:<[^>\n]+>\s+)?(?:({_TYPE})\s+)?([\w$]+)\s*\(([^;{{}}]*?)\)(?:\s*throws\s+([\w.,\s]+?))?\s*([{{;])", re.MULTILINE),
    "script": re.compile(rf"^[ \t]*()((?:(?:{_MODIFIERS}|function\*?|get|set)\s+)*)()([\w$#]+)\s*(?:<[^(){{}}\n]*>)?\(([^;{{}}]*?)\)(?:\s*:\s*([^;{{}}=\n]+?))?\s*([{{;])", re.MULTILINE),
}
_FIELD = re.compile(rf"^[ \t]*(?:@[\w.]+(?:\([^)\n]*\))?\s+)*((?:{_MODIFIERS}\s+)*)({_TYPE})\s+([\w$]+)\s*(?:=[^;]*)?;", re.MULTILINE)
_IMPORT = re.compile(r"^\s*import\s+(?:static\s+)?([\w.]+?)(\.\*)?\s*;|^\s*import\s+(?:[\w*{},\s$]+\s+from\s+)?['\"]([^'\"\n]+)['\"]", re.MULTILINE)
_CALL = re.compile(r"(\bnew\s+)?(?:([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\.\s*)?([A-Za-z_$][\w$]*)\s*(?:<[\w, .]*>)?\(")
_LOCAL = re.compile(rf"\b({_TYPE})\s+([\w$]+)\s*(?==[^=]|;|:|,|\))|\b(?:var|let|const)\s+([\w$]+)\s*=\s*new\s+([\w$.]+)")
_WORDS = frozenset("if for while switch catch synchronized return new else do try throw assert super this function with case typeof await yield in of instanceof".split())
_MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
_ANNOTATION = re.compile(r"@([\w.]+)(?:\(([^)\n]*)\))?")


def simple_type(t: str | None) -> str:
    return re.sub(r"<.*|\[\]|\.\.\.", "", (t or "").strip()).strip().rsplit(".", 1)[-1]


def _split_params(text: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<([{") - (c in ">)]}")
        if c == "," and depth == 0:
            out.append(text[at:i])
            at = i + 1
    out.append(text[at:])
    return [p.strip() for p in out if p.strip()]


def _arity(flat: str, opened: int) -> int:
    """Arguments of the call whose parenthesis is at ``opened``; -1 if it isn't closed."""
    depth, commas, some = 0, 0, False
    for i in range(opened, len(flat)):
        c = flat[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth == 0:
                return commas + 1 if some else 0
        elif c == "," and depth == 1:
            commas += 1
        if depth >= 1 and i > opened and not c.isspace():
            some = True
    return -1


def braced(path: str, lang: str, source: str) -> Unit:
    """Java, JavaScript and TypeScript."""
    java = lang == "java"
    flat = _BLANK.sub(lambda m: re.sub(r"[^\n]", " " if m[0][0] == "/" else "\x01", m[0]), source)
    found = re.search(r"^\s*package\s+([\w.]+)\s*;", flat, re.MULTILINE)
    package = found[1] if found else "" if java else ".".join(path.split("/")[:-1])
    u = Unit(path, package)
    starts = [0] + [m.end() for m in re.finditer("\n", source)]

    def line(p: int) -> int:
        from bisect import bisect_right

        return bisect_right(starts, p)

    ends: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(r"[{}]", flat):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            ends[stack.pop()] = m.start()
    for m in _IMPORT.finditer(source):
        if flat[m.start(0) : m.end(0)].lstrip().startswith("import"):
            fqn = m[1] or m[3]
            u.ref("IMPORTS", ("file", path), fqn.replace("/", ".").rsplit(".", 1)[-1] if not m[2] else None, line(m.start()), "import_wildcard" if m[2] else "import", import_fqn=fqn)
    scopes: list[tuple[int, int, str, tuple[str, str], dict[str, str]]] = []
    for m in _HEAD.finditer(flat):
        b, e = m.end() - 1, ends.get(m.end() - 1, len(flat))
        outer = [s for s in scopes if s[0] < m.start() < s[1]]
        fqn = ".".join([x for x in [outer[-1][3][1] if outer else package, m[3]] if x])
        kind = m[2] if java and m[2] != "@interface" else "class"
        me = u.node("Class", kind, m[3], fqn, line(m.start(2)), line(e), outer[-1][3] if outer else None, visibility=_visibility(m[1], java), is_static="static" in m[1].split())
        head = re.sub(r"<[^<>]*>", "", m[4])
        for word, type_ in (("extends", "EXTENDS"), ("implements", "IMPLEMENTS")):
            if g := re.search(rf"\b{word}\s+([\w$.,\s]+?)(?=\bimplements\b|\bextends\b|\bpermits\b|$)", head):
                for t in filter(None, map(str.strip, g[1].split(","))):
                    u.ref(type_, me, t.rsplit(".", 1)[-1], line(m.start()), "type")
        for a in _ANNOTATION.finditer(m[0][: m[0].find(m[2])]):
            u.ref("ANNOTATED_WITH", me, "@" + a[1], line(m.start()), "annotation")
        scopes.append((b, e, m[3], me, {}))
    inner = sorted(ends.items())
    methods = []
    for m in _METHOD["java" if java else "script"].finditer(flat):
        notes, mods, ret, name, params, rest, opener = m.groups()
        owner = [s for s in scopes if s[0] < m.start(4) < s[1]]
        if name in _WORDS or (ret in _WORDS if ret else False) or re.match(r"\s*(?:return|new|else|throw|await)\b", m[0]):
            continue
        if opener == ";" and (not owner or (java and not ret) or (not java and not rest)):
            continue
        if not java and not owner and "function" not in mods:
            continue
        if java and owner and not ret and name != owner[-1][2]:
            continue
        stop = ends.get(m.end() - 1, len(flat)) if opener == "{" else m.end() - 1
        methods.append((m.start(4), stop, m, owner[-1] if owner else None))
    taken = [(a, b) for a, b, *_ in methods]
    for s in scopes if java else ():
        for m in _FIELD.finditer(flat, s[0], s[1]):
            if m[2] in _WORDS or m[2] in ("package", "import", "return") or any(a < m.start(3) < b for a, b in taken) or any(o[0] > s[0] and o[0] < m.start(3) < o[1] for o in scopes):
                continue
            u.node("Field", "field", m[3], f"{s[3][1]}#{m[3]}", line(m.start(3)), line(m.end()), s[3], return_type=m[2], visibility=_visibility(m[1], java), is_static="static" in m[1].split())
            s[4][m[3]] = simple_type(m[2])
            if simple_type(m[2])[:1].isupper():
                u.ref("OF_TYPE", ("field", f"{s[3][1]}#{m[3]}"), simple_type(m[2]), line(m.start()), "type")
    for start, stop, m, owner in methods:
        notes, mods, ret, name, params, rest, opener = m.groups()
        raw = source[m.start(5) : m.end(5)]
        plist = _split_params(re.sub(r"@[\w.]+(?:\([^)]*\))?\s*|\bfinal\s+", "", raw))
        names = [re.sub(r"[=:].*", "", p, flags=re.DOTALL).split()[-1].lstrip(".") if not java else p.split()[-1].lstrip(".") for p in plist if p.split()]
        kind = "constructor" if owner and (name == owner[2] or name == "constructor") else "method" if owner else "function"
        base = owner[3][1] if owner else package
        fqn = f"{base}#{name}({' '.join(raw.split())})" if java else ".".join(x for x in (base, name) if x)
        body = flat[m.end() : stop]
        me = u.node(
            "Function", kind, name, fqn, line(start), line(stop), owner[3] if owner else None, signature=f"{name}({' '.join(raw.split())})", param_count=len(plist), param_names=names, return_type=(ret if java else rest) or None,
            visibility=_visibility(mods, java, name), is_static="static" in mods.split(), is_async="async" in mods.split(), cyclomatic=1 + len(re.findall(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?![.?])", body)),
        )
        types = dict(owner[4]) if owner else {}
        types |= {n: simple_type(p.rsplit(None, 1)[0] if java and " " in p else p.split(":")[1] if ":" in p else "") for n, p in zip(names, plist, strict=False)}
        for a in _ANNOTATION.finditer(notes or ""):
            u.ref("ANNOTATED_WITH", me, "@" + a[1], line(start), "annotation")
            if a[1] in _MAPPINGS or a[1] == "RequestMapping":
                route = re.search(r"[\"']([^\"'\n]*)[\"']", source[m.start(1) + a.start() : m.start(1) + a.end()])
                verb = _MAPPINGS.get(a[1], "GET")
                u.node("Endpoint", "endpoint", f"{verb} {route[1] if route else '/'}", f"{verb} {route[1] if route else '/'}", line(start), None, me, method=verb, route=route[1] if route else "/")
        if java and rest:
            for t in rest.split(","):
                u.ref("THROWS", me, t.strip().rsplit(".", 1)[-1], line(start), "type")
        for v in _LOCAL.finditer(body):
            if v[3]:
                types[v[3]] = simple_type(v[4])
            elif java and v[1] not in _WORDS and v[1][:1].isupper():
                types[v[2]] = simple_type(v[1])
        for c in _CALL.finditer(body):
            new, recv, callee = c.groups()
            if callee in _WORDS:
                continue
            at = line(m.end() + c.start(3))
            n = _arity(body, c.end() - 1)
            if new:
                u.ref("INSTANTIATES", me, callee, at, "type", call_arity=n)
                continue
            first = (recv or "").removeprefix("this.")
            self_ = recv == "this"
            u.ref("CALLS", me, callee, at, "call", recv="self" if self_ else first, recv_type="" if self_ else types.get(first, ""), call_arity=n)
        if owner:
            for f in owner[4]:
                for x in re.finditer(rf"(?<![\w.$])(?:this\.)?{re.escape(f)}\b(\s*=(?!=))?", body):
                    u.ref("WRITES" if x[1] else "READS", me, f, line(m.end() + x.start()), "field")
    del inner
    return u


def _visibility(modifiers: str, java: bool, name: str = "") -> str:
    for v in ("public", "protected", "private"):
        if v in modifiers.split():
            return v
    return "package" if java else "private" if name.startswith(("_", "#")) else "public"


# Python

_VERBS = frozenset("get post put delete patch head options".split())


def python(path: str, source: str) -> Unit:
    """Raises SyntaxError for what isn't Python."""
    parts = path.removesuffix(".py").split("/")
    u = Unit(path, ".".join(parts[:-1]))
    module = ".".join(parts[:-1] if parts[-1] == "__init__" else parts)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(source)
    top = {t.id for n in tree.body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)}
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            for a in n.names:
                u.ref("IMPORTS", ("file", path), a.name.rsplit(".", 1)[-1], n.lineno, "import", import_fqn=a.name)
        elif isinstance(n, ast.ImportFrom):
            for a in n.names:
                star = a.name == "*"
                base = "." * n.level + (n.module or "")
                u.ref("IMPORTS", ("file", path), None if star else a.name, n.lineno, "import_wildcard" if star else "import", import_fqn=base if star else f"{base}.{a.name}")

    def dotted(e: ast.AST) -> str:
        if isinstance(e, ast.Name):
            return e.id
        if isinstance(e, ast.Attribute):
            left = dotted(e.value)
            return f"{left}.{e.attr}" if left else ""
        return dotted(e.func) if isinstance(e, ast.Call) else ""

    def calls(f: ast.AST, me: tuple[str, str], types: dict[str, str], local: set[str]) -> None:
        for n in ast.walk(f):
            if isinstance(n, ast.Call):
                name = dotted(n.func)
                if name:
                    recv, _, callee = name.rpartition(".")
                    if not recv and callee[:1].isupper():
                        u.ref("INSTANTIATES", me, callee, n.lineno, "type", call_arity=len(n.args) + len(n.keywords))
                    else:
                        first = recv.removeprefix("self.") if recv.startswith("self.") else recv
                        u.ref("CALLS", me, callee, n.lineno, "call", recv=first, recv_type=types.get(first, ""), call_arity=len(n.args) + len(n.keywords))
            elif isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "self":
                u.ref("WRITES" if isinstance(n.ctx, ast.Store) else "READS", me, n.attr, n.lineno, "field")
            elif isinstance(n, ast.Name) and n.id in top and n.id not in local:
                u.ref("WRITES" if isinstance(n.ctx, ast.Store) else "READS", me, n.id, n.lineno, "field")

    def visit(body: list[ast.stmt], prefix: str, parent: tuple[str, str] | None, in_class: bool) -> None:
        for n in body:
            if isinstance(n, ast.ClassDef):
                me = u.node("Class", "class", n.name, f"{prefix}.{n.name}", n.lineno, n.end_lineno, parent, docstring=(ast.get_docstring(n) or "")[:500] or None, visibility=_visibility("", False, n.name))
                for b in n.bases:
                    if dotted(b):
                        u.ref("EXTENDS", me, dotted(b).rsplit(".", 1)[-1], n.lineno, "type")
                visit(n.body, f"{prefix}.{n.name}", me, True)
            elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                args = [*n.args.posonlyargs, *n.args.args, *([n.args.vararg] if n.args.vararg else []), *n.args.kwonlyargs, *([n.args.kwarg] if n.args.kwarg else [])]
                if in_class and args and args[0].arg in ("self", "cls"):
                    args = args[1:]
                names = [a.arg for a in args]
                notes = [dotted(x) for x in n.decorator_list]
                complexity = 1 + sum(isinstance(x, ast.If | ast.For | ast.While | ast.ExceptHandler | ast.IfExp | ast.comprehension) for x in ast.walk(n))
                me = u.node(
                    "Function", "method" if in_class else "function", n.name, f"{prefix}.{n.name}", n.lineno, n.end_lineno, parent, docstring=(ast.get_docstring(n) or "")[:500] or None, signature=f"{n.name}({', '.join(names)})", param_count=len(names), param_names=names,
                    return_type=ast.unparse(n.returns) if n.returns else None, visibility=_visibility("", False, n.name), is_static="staticmethod" in notes, is_async=isinstance(n, ast.AsyncFunctionDef), cyclomatic=complexity,
                )
                for x in n.decorator_list:
                    name = dotted(x)
                    if name:
                        u.ref("ANNOTATED_WITH", me, "@" + name, x.lineno, "annotation")
                    tail = name.rpartition(".")[2]
                    if isinstance(x, ast.Call) and (tail in _VERBS or tail == "route") and x.args and isinstance(x.args[0], ast.Constant) and isinstance(x.args[0].value, str):
                        given = [e.value for k in x.keywords if k.arg == "methods" and isinstance(k.value, ast.List | ast.Tuple) for e in k.value.elts if isinstance(e, ast.Constant)]
                        for verb in given or [tail.upper() if tail in _VERBS else "GET"]:
                            u.node("Endpoint", "endpoint", f"{verb} {x.args[0].value}", f"{verb} {x.args[0].value}", n.lineno, None, me, method=verb, route=x.args[0].value)
                types = {a.arg: simple_type(ast.unparse(a.annotation)) for a in args if a.annotation}
                local = set(names) | {x.id for x in ast.walk(n) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store)}
                for s in ast.walk(n):
                    if isinstance(s, ast.Assign) and isinstance(s.value, ast.Call) and dotted(s.value.func)[:1].isupper():
                        types |= {t.id: dotted(s.value.func).rsplit(".", 1)[-1] for t in s.targets if isinstance(t, ast.Name)}
                calls(n, me, types, local)
                visit(n.body, f"{prefix}.{n.name}", me, False)
            elif in_class and isinstance(n, ast.Assign | ast.AnnAssign):
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name):
                        u.node("Field", "field", t.id, f"{prefix}.{t.id}", n.lineno, n.end_lineno, parent)
            elif not in_class and parent is None and isinstance(n, ast.Assign):
                for t in n.targets:
                    if isinstance(t, ast.Name):
                        u.node("Field", "global_variable", t.id, f"{prefix}.{t.id}", n.lineno, n.end_lineno)

    visit(tree.body, module, None, False)
    return u


# SQL

_TABLE = re.compile(r"\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:(?:GLOBAL\s+|LOCAL\s+)?TEMP(?:ORARY)?\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?((?:[\w\"`\[\]]+\.)*[\w\"`\[\]]+)\s*\(", re.IGNORECASE)
_FOREIGN = re.compile(r"\bREFERENCES\s+((?:[\w\"`\[\]]+\.)*[\w\"`\[\]]+)", re.IGNORECASE)
_NO_COLUMN = re.compile(r"(?i)^\s*(?:PRIMARY|FOREIGN|UNIQUE|CHECK|CONSTRAINT|KEY|INDEX|EXCLUDE|LIKE)\b")


def sql(path: str, source: str) -> Unit:
    """Tables with their columns (as JSON in docstring), and references between tables."""
    import json

    u = Unit(path, "")
    flat = re.sub(r"--[^\n]*|/\*[\s\S]*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    for m in _TABLE.finditer(flat):
        depth, stop = 0, len(flat)
        for i in range(m.end() - 1, len(flat)):
            depth += (flat[i] == "(") - (flat[i] == ")")
            if depth == 0:
                stop = i
                break
        name = re.sub(r"[\"`\[\]]", "", m[1]).rsplit(".", 1)[-1]
        columns = []
        for p in _split_params(flat[m.end() : stop]):
            if not _NO_COLUMN.match(p) and (c := re.match(r"\s*[\"`\[]?(\w+)[\"`\]]?\s+([\s\S]+)", p)):
                columns.append({"name": c[1], "type": " ".join(c[2].split())})
        me = u.node("Table", "table", name, name, flat.count("\n", 0, m.start()) + 1, flat.count("\n", 0, stop) + 1, docstring=json.dumps(columns))
        for r in _FOREIGN.finditer(flat, m.end(), stop):
            u.ref("REFERENCES", me, re.sub(r"[\"`\[\]]", "", r[1]).rsplit(".", 1)[-1], flat.count("\n", 0, r.start()) + 1, "table")
    return u


# pages

_PAGE = re.compile(r"<%--[\s\S]*?--%>|<%@\s*(\w+)([^%]*)%>|<%!([\s\S]*?)%>|<%=([\s\S]*?)%>|<%([\s\S]*?)%>|<jsp:include\b[^>]*\bpage\s*=\s*[\"']([^\"']+)[\"']|<script\b[^>]*\bsrc\s*=\s*[\"']([^\"']+)[\"']|\$\{([^}]*)\}")


def translate_page(source: str, name: str) -> tuple[str, list[int]]:
    """A page as the Java class it becomes, and the page's line for each line of it."""
    heads, members, body = [], [], []
    for m in _PAGE.finditer(source):
        at = source.count("\n", 0, m.start()) + 1
        if m[1] == "page" and (i := re.search(r"import\s*=\s*[\"']([^\"']+)[\"']", m[2])):
            heads += [(f"import {x.strip()};", at) for x in i[1].split(",")]
        for text, out, form in ((m[3], members, "{}"), (m[4], body, "out.print({});"), (m[5], body, "{}")):
            if text:
                out += [(form.format(x) if form != "out.print({});" else form.format(text.strip()), at + k) for k, x in enumerate(text.split("\n") if form == "{}" else [text])]
    rows = [*heads, (f"public class {name} {{", 1), *members, ("  public void _jspService(HttpServletRequest request, HttpServletResponse response) {", 1), *body, ("  }", 1), ("}", 1)]
    return "\n".join(t for t, _ in rows), [n for _, n in rows]


def page(path: str, source: str) -> Unit:
    name = re.sub(r"\W", "_", path.rsplit("/", 1)[-1])
    text, lines = translate_page(source, name)
    u = braced(path, "java", text)
    at = lambda n: lines[min(max(n, 1), len(lines)) - 1] if n and lines else n
    for x in u.nodes:
        x["start_line"], x["end_line"] = (1, None) if x["label"] == "File" else (at(x["start_line"]), at(x["end_line"]))
    for r in u.refs:
        r["ref_line"] = at(r["ref_line"])
    for m in _PAGE.finditer(source):
        n = source.count("\n", 0, m.start()) + 1
        included = m[6] or (re.search(r"file\s*=\s*[\"']([^\"']+)", m[2])[1] if m[1] == "include" and re.search(r"file\s*=\s*[\"']([^\"']+)", m[2]) else None)
        if included:
            u.ref("INCLUDES_PAGE", ("file", path), included.rsplit("/", 1)[-1], n, "file")
        if m[7]:
            u.ref("INCLUDES_SCRIPT", ("file", path), m[7].rsplit("/", 1)[-1].split("?")[0], n, "file")
        for g in re.finditer(r"\.(\w+)", m[8] or ""):
            u.ref("CALLS", ("file", path), "get" + g[1][:1].upper() + g[1][1:], n, "call", recv="el")
    return u


def unit(path: str, lang: str | None, source: str | None) -> tuple[Unit, str | None]:
    """One file; what it can't read gives the File node alone, and why."""
    if not source or not lang:
        return Unit(path, ""), None
    try:
        if lang == "python":
            return python(path, source), None
        if lang == "sql":
            return sql(path, source), None
        if lang == "jsp":
            return page(path, source), None
        if lang in ("java", "javascript", "typescript", "tsx"):
            return braced(path, lang, source), None
        return Unit(path, ""), None
    except (SyntaxError, ValueError, RecursionError, MemoryError, IndexError) as e:
        return Unit(path, ""), f"{type(e).__name__}: {e}"[:200]


def extract(files: DataFrame) -> DataFrame:
    """One row per file (repo, relpath, lang, source): its nodes, references and containments, and
    an error or null. Rows with a null path are left out; null sources give a File node."""
    df = files.select("repo", F.col("relpath").alias("file"), "lang", "source").filter("relpath is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for repo, path, lang, source in zip(b["repo"], b["file"], b["lang"], b["source"], strict=True):
                u, error = unit(path, lang if isinstance(lang, str) else None, source if isinstance(source, str) else None)
                rows.append((repo, path, lang, error, u.nodes, u.refs, [dict(zip(("parent_kind", "parent_fqn", "kind", "fqn"), c, strict=True)) for c in u.contains]))
            yield pd.DataFrame(rows, columns=["repo", "file", "lang", "error", "nodes", "refs", "contains"])

    return df.mapInPandas(run, SCHEMA)


def tables(extracted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, refs, edges): with ids; edges are the containments and what endpoints expose."""
    n = extracted.select("repo", "file", "lang", F.explode("nodes").alias("n")).select("repo", "file", "lang", "n.*")
    nodes = n.withColumn("id", make_id(F.col("repo"), F.col("kind"), F.col("fqn"))).dropDuplicates(["id"])
    r = extracted.select("repo", "file", F.explode("refs").alias("r")).select("repo", F.col("file").alias("ref_file"), "r.*")
    refs = r.withColumn("src", make_id(F.col("repo"), F.col("src_kind"), F.col("src_fqn"))).withColumn("ref_col", F.lit(0))
    refs = refs.withColumn("ref_id", F.md5(F.concat_ws("\x1f", "type", "src", F.coalesce("target_name", F.lit("")), "recv", "ref_file", F.col("ref_line").cast("string"), F.coalesce("import_fqn", F.lit("")), F.col("call_arity").cast("string")))).dropDuplicates(["ref_id"])
    c = extracted.select("repo", F.explode("contains").alias("c")).select("repo", "c.*")
    exposes = F.col("kind") == "endpoint"
    edges = c.select(F.when(exposes, "EXPOSES").otherwise("CONTAINS").alias("type"), make_id(F.col("repo"), F.col("parent_kind"), F.col("parent_fqn")).alias("src"), make_id(F.col("repo"), F.col("kind"), F.col("fqn")).alias("dst")).distinct()
    return nodes, refs, edges
