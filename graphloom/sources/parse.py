"""Files to graph fragments: symbols, edges inside a file, imports, references left for linking, notes, routes.

A provider turns one file into records; providers are looked up by language and shipped to the workers. Python is read
with the interpreter's own parser; other languages by declarations at line starts, and a language without provider gives its file only.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.sources.scan import LANGUAGES, symbol_id

#: Most characters of a symbol's snippet and of its searchable text.
SNIPPET, SEARCH = 1200, 24_000
_STRENGTH = {"define": 3, "write": 2, "pass": 1, "read": 0}
_NOTE = re.compile(r"(?:#|//|--)\s*(WHY|NOTE|HACK|XXX|TODO|FIXME)\b[:\s]\s*(.*)")
_ROUTE = {"get", "post", "put", "delete", "patch", "head", "options", "route"}

Record = tuple[str, str, str | None, str | None, dict]


def package_of(path: str) -> str:
    """Dotted package of a path without its extension; an ``__init__`` stands for its folder."""
    stem = re.sub(r"\.[^./]*$", "", path.lstrip("./"))
    return re.sub(r"(?:^|\.)__init__$", "", stem.replace("/", "."))


def _python(repo_id: str, path: str, text: str) -> Iterator[Record]:
    tree = ast.parse(text)
    lines = text.splitlines()
    package, file_id = package_of(path), f"{repo_id}:{path.lstrip('./')}"
    table: dict[tuple[str, str], str] = {}
    bodies: list[tuple[str, str, ast.AST]] = []

    def declare(node: ast.AST, kind: str, name: str, owner: str, signature: str, doc: str | None) -> str:
        sid = symbol_id("python", package, owner, kind, name, signature)
        first, last = node.lineno, getattr(node, "end_lineno", node.lineno)
        above = first - 1
        while above > 0 and lines[above - 1].lstrip().startswith("#"):
            above -= 1
        body = "\n".join(lines[first - 1 : last])
        table.setdefault((owner, name), sid)
        record = {"name": name, "kind": kind, "signature": signature, "package": package, "namespace": owner, "file_id": file_id, "line": first, "end_line": last, "docstring": doc, "body": body[:SNIPPET], "search_text": "\n".join(lines[above:last])[:SEARCH]}
        out.append(("symbol", sid, None, None, record))
        return sid

    out: list[Record] = [("file", file_id, None, None, {"path": path, "language": "python", "repo_id": repo_id})]

    def visit(nodes: list, owner: str) -> None:
        for n in nodes:
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                sid = declare(n, "method" if owner else "function", n.name, owner, f"({ast.unparse(n.args)})", ast.get_docstring(n))
                bodies.append((sid, owner, n))
                for d in n.decorator_list:
                    if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in _ROUTE and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                        out.append(("route", f"route:{repo_id}:{d.func.attr.upper()}:{d.args[0].value}", sid, "ROUTES_TO", {"method": "ANY" if d.func.attr == "route" else d.func.attr.upper(), "path": d.args[0].value}))
            elif isinstance(n, ast.ClassDef):
                sid = declare(n, "class", n.name, owner, "", ast.get_docstring(n))
                for b in n.bases:
                    out.append(("ref", sid, ast.unparse(b).rsplit(".", 1)[-1], "inherits", {"line": n.lineno, "qualifier": ast.unparse(b).rpartition(".")[0] or None}))
                visit(n.body, f"{owner}.{n.name}" if owner else n.name)
            elif isinstance(n, ast.Assign | ast.AnnAssign) and not owner:
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name):
                        declare(n, "constant" if t.id.isupper() else "variable", t.id, owner, "", None)
            elif isinstance(n, ast.Import):
                for a in n.names:
                    out.append(("import", file_id, a.name, a.asname or a.name.split(".")[0], {"line": n.lineno, "name": None}))
            elif isinstance(n, ast.ImportFrom):
                base = package.rsplit(".", n.level)[0] if n.level and package.count(".") >= n.level else ""
                module = ".".join(x for x in (base if n.level else "", n.module) if x)
                for a in n.names:
                    out.append(("import", file_id, module, a.asname or a.name, {"line": n.lineno, "name": a.name}))

    visit(tree.body, "")
    for sid, owner, node in bodies:
        kinds: dict[str, tuple[str, int]] = {}
        for n in ast.walk(node):
            if isinstance(n, ast.Call):
                f = n.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                of = ast.unparse(f.value) if isinstance(f, ast.Attribute) else None
                target = table.get((owner, name)) if of == "self" else table.get(("", name)) if of is None else None
                if target and target != sid:
                    out.append(("edge", sid, target, "CALLS", {"line": n.lineno, "ref_kind": None}))
                elif name and not target:
                    out.append(("ref", sid, name, "call", {"line": n.lineno, "qualifier": of}))
            use = [(n, "write" if isinstance(n.ctx, ast.Store | ast.Del) else "read")] if isinstance(n, ast.Name) else [(a, "pass") for a in [*n.args, *[k.value for k in n.keywords]] if isinstance(a, ast.Name)] if isinstance(n, ast.Call) else []
            for x, kind in use:
                target = table.get(("", x.id))
                if target and target != sid and (target not in kinds or _STRENGTH[kind] > _STRENGTH[kinds[target][0]]):
                    kinds[target] = (kind, x.lineno)
        for target, (kind, line) in sorted(kinds.items()):
            out.append(("edge", sid, target, "REFERENCES", {"line": line, "ref_kind": kind}))
    yield from out


_DECLARED = {
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:(?P<f>function)\*?|(?P<c>class))\s+(?P<n>[\w$]+)", "java": r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*(?:(?P<c>class|interface|enum|record)\s+(?P<n>\w+)|[\w<>\[\], ]+?\s+(?P<m>\w+)\s*\([^;]*\)\s*\{)",
    "go": r"^(?:func\s+(?:\([^)]*\)\s*)?(?P<n>\w+)|type\s+(?P<c>\w+)\s+(?:struct|interface))", "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:(?P<f>fn)|(?P<c>struct|enum|trait))\s+(?P<n>\w+)", "cpp": r"^(?:(?P<c>class|struct)\s+(?P<n>\w+)|[\w:<>&*, ]+\s+(?P<m>\w+)\s*\([^;]*\)\s*(?:const\s*)?\{)",
}
_DECLARED |= {"typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:(?P<f>function)\*?|(?P<c>class|interface|enum|type))\s+(?P<n>[\w$]+)", "csharp": _DECLARED["java"]}


def _by_lines(language: str) -> Callable[[str, str, str], Iterator[Record]]:
    pattern = re.compile(_DECLARED[language])

    def provide(repo_id: str, path: str, text: str) -> Iterator[Record]:
        package, file_id = package_of(path), f"{repo_id}:{path.lstrip('./')}"
        yield "file", file_id, None, None, {"path": path, "language": language, "repo_id": repo_id}
        lines = text.splitlines()
        for i, line in enumerate(lines):
            m = pattern.match(line)
            if not m:
                continue
            g = {"f": None, "c": None, "m": None, "n": None} | m.groupdict()
            name = g["n"] or g["m"] or g["c"]
            kind = ("class" if g["c"] in ("class", "record") else g["c"] if g["n"] else "type") if g["c"] else "function"
            depth, last = 0, i
            for j in range(i, len(lines)):
                depth += lines[j].count("{") - lines[j].count("}")
                last = j
                if depth <= 0 and (j > i or "}" in lines[j] or ";" in lines[j]):
                    break
            signature = line.strip().rstrip("{").strip()
            body = "\n".join(lines[i : last + 1])
            record = {"name": name, "kind": kind, "signature": signature, "package": package, "namespace": "", "file_id": file_id, "line": i + 1, "end_line": last + 1, "docstring": None, "body": body[:SNIPPET], "search_text": body[:SEARCH]}
            yield "symbol", symbol_id(language, package, "", kind, name, signature), None, None, record

    return provide


PROVIDERS: dict[str, Callable[[str, str, str], Iterator[Record]]] = {"python": _python, **{x: _by_lines(x) for x in _DECLARED}}


def notes(file_id: str, text: str) -> Iterator[Record]:
    """Design notes of line comments: why, note, hack, to do."""
    for i, line in enumerate(text.splitlines(), 1):
        if m := _NOTE.search(line):
            yield "note", f"note:{symbol_id('', file_id, str(i), m[1], m[2], '')[-16:]}", None, None, {"kind": m[1].lower(), "text": m[2].strip(), "file_id": file_id, "line": i}


def fragments(files: DataFrame, providers: dict | None = None) -> DataFrame:
    """(record, id, target, kind, file_id, properties) of all files (repo_id, path, source), parsed where they lie.

    ``record``: file, symbol, edge, import, ref, route, note, or error for a file that its provider can't read; the properties
    are JSON. Null sources are empty files. Files of languages without provider give their file record only.
    """
    table = providers or PROVIDERS
    names = ["record", "id", "target", "kind", "file_id", "properties"]

    def parse(batches):
        for b in batches:
            rows: list[tuple] = []
            for repo, path, source in zip(*(b.column(i).to_pylist() for i in range(3))):
                path, text = path or "", bytes(source or b"").decode("utf-8", "replace").lstrip("﻿").replace("\r\n", "\n")
                file_id = f"{repo}:{path.lstrip('./')}"
                language = LANGUAGES.get(path.rsplit(".", 1)[-1].lower())
                provide = table.get(language)
                try:
                    found = list(provide(repo, path, text)) if provide else [("file", file_id, None, None, {"path": path, "language": language, "repo_id": repo})]
                except (SyntaxError, ValueError, RecursionError) as e:
                    found = [("file", file_id, None, None, {"path": path, "language": language, "repo_id": repo}), ("error", file_id, None, None, {"message": str(e)[:200]})]
                rows += [(r, i, t, k, file_id, json.dumps(p, sort_keys=True)) for r, i, t, k, p in [*found, *notes(file_id, text)]]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.string()) for i in range(6)], names)

    return files.select("repo_id", "path", "source").mapInArrow(parse, ", ".join(f"{n} string" for n in names))
