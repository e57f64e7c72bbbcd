"""Functions paired with their documentation."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.heavy_keys import heavy_keys, salted_pair
from graphloom.tables import symbols

#: Least words of prose, besides the function's name, that say something.
LEAST_WORDS = 5

_MARKS = re.compile(r"^\s*(?:/\*\*?|\*/|///?!?|\*(?!\S*\*)|#+!?|--)?\s?|\s*\*+/\s*$")
# Lines for tools rather than readers.
_DIRECTIVE = re.compile(
    r"^\s*(?:noqa|nosec|nolint\w*|pylint|flake8|mypy|type:\s*ignore|pragma|isort|fmt|yapf|black|eslint|tslint|jshint|jslint|prettier|istanbul|c8|@ts-|ts-|clang-format|clang-tidy|cppcheck|go:|lint|rustfmt|clippy"
    r"|checkstyle|sonar|suppress\w*|@suppress\w*|resharper|pyright|coverage|region|endregion|cspell|spell-?checker|biome|deno|swiftlint|ktlint|nopep8)\b.*",
    re.IGNORECASE,
)
_NOTE = re.compile(r"^\s*(?:@?todo|fixme|xxx|hack|wip|tbd|tbc|note to self|remove me|temp|refactor me)\b.*", re.IGNORECASE)
_TAG = re.compile(r"^\s*(?:[@\\][A-Za-z]+|:[A-Za-z]+(?: [^:]*)?:|\{@\w+[^}]*\})")
_XML_PARAMETER = re.compile(r"<(param|typeparam|returns?|exception|see|seealso|value|inheritdoc)\b[^>]*(?:/>|>.*?</\1>|>)", re.DOTALL | re.IGNORECASE)
_XML = re.compile(r"</?[A-Za-z][^<>]*>")
_PLACEHOLDER = re.compile(
    r"^\W*(?:no (?:description|documentation)|(?:description|documentation|docs?) (?:goes|to be|missing|needed|pending)|undocumented|auto-?generated (?:method|function|constructor) stub|lorem ipsum"
    r"|(?:add|insert|write|enter) (?:a |the |your |some )?(?:description|documentation|docs?|docstring)|placeholder|none given|n/?a\b|docstring\W*$)",
    re.IGNORECASE,
)
# A line of disabled code: statement ends, assignments, headed blocks, bare calls, continuation lines of literals.
_CODE = re.compile(
    r"[;{}]\s*$|^\s*[\w.\[\]\"'*&]+(?:\s*:\s*[\w<>\[\], ]+)?\s*(?::=|(?<![=!<>])=(?!=))\s*\S|^\s*(?:if|for|foreach|while|with|try|except|else|elif|finally|def|class|async|match|switch|case|catch)\b.*:\s*$"
    r"|^\s*(?:return|raise|throw|defer|yield|await|import|using|package|print|exec|let|const|var|auto|new|pass|break|continue)\b(?:\s+[\w.\"'`({\[\-]+\S*)?(?:\s*\(.*)?\s*$|^\s*[\w.:!]+\(.*\)\s*[;,]?\s*$"
    r"|^\s*(?:[\"'\w\[\]{}().]+|[\"'].*[\"'])\s*,\s*$|^\s*[\[\](){},]+\s*$|^\s*\S+\s*=>\s*.*,?$|^\s*[.@]\w+\(.*$"
)
_TOKEN = re.compile(r"\w+(?:['’][^\W\d_]+)*")
_CLOSE = re.compile(r"\s*\*+/\s*$")
_RULE = frozenset(" *-=_#/~.!\t")
_OPENING = re.compile(r"""\s*[rRuU]?(?P<q>\"{3}|'{3}|"|')""")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_]+")


def prose(text: str) -> str:
    """The sentences of a documentation text: comment marks, tags, directives, notes to self, placeholders, rules and
    disabled code are gone. A comment of which half the lines are code is disabled code altogether."""
    if not text or text.isspace():
        return ""
    if "<" in text:
        text = _XML_PARAMETER.sub(" ", text)
    kept, code, lines = [], 0, 0
    for raw in text.splitlines():
        line = raw
        while (bare := _MARKS.sub("", line, count=1)) != line and bare.strip() != line.strip():
            line = bare
        if line.endswith("/"):
            line = _CLOSE.sub("", line)
        if _RULE.issuperset(line):
            continue
        lines += 1
        if _CODE.search(line):
            code += 1
        elif not (_DIRECTIVE.match(line) or _NOTE.match(line) or _TAG.match(line) or _PLACEHOLDER.match(line)):
            kept.append(_XML.sub(" ", line).strip() if "<" in line else line.strip())
    return "" if lines and 2 * code >= lines else "\n".join(k for k in kept if k)


def words_besides(text: str, name: str) -> int:
    """Words of ``text`` apart from the function's name, written as identifier or as its words in a row."""
    if not text:
        return 0
    words = [w for w in _TOKEN.findall(text) if w != name and "_" not in w and not w.isdigit()]
    parts = [p.lower() for p in _CAMEL.findall(name) if not p.isdigit()] if name else []
    if len(parts) and parts[0] in (low := [w.lower() for w in words]):
        k, i, kept = len(parts), 0, 0
        while i < len(low):
            if low[i : i + k] == parts:
                i += k
            else:
                i, kept = i + 1, kept + 1
        return kept
    return len(words)


def opening_docstring(body: str | None) -> str:
    """The string literal that is a Python body's first statement."""
    m = _OPENING.match(body or "")
    if not m:
        return ""
    end = body.find(m["q"], m.end())
    return body[m.end() : end] if end >= 0 else ""


def leading_comment(search_text: str | None, signature: str | None) -> str:
    """The comment that stands directly above the declaration; a blank line or other code ends it."""
    if not search_text:
        return ""
    at = search_text.find(signature) if signature else -1
    head = search_text[:at] if at >= 0 else search_text
    out: list[str] = []
    block = False
    lines = head.split("\n")
    if at >= 0:
        lines = lines[:-1]  # the declaration's own indentation or modifiers
    for line in lines:
        s = line.strip()
        if block or s.startswith(("/*", "//", "#")) and not s.startswith("#["):
            out.append(s)
            if block or s.startswith("/*"):
                block = "*/" not in s
        elif at < 0 and s:
            break
        elif not s.startswith(("@", "[", "#[")):
            out = []
    return "\n".join(out)


def own_documentation(language: str, name: str, signature: str | None, docstring: str | None, body: str | None, search_text: str | None) -> tuple[str, int]:
    """(prose, words besides the name) of the best of a function's own three places of documentation."""
    texts = [docstring or "", leading_comment(search_text, signature)]
    if language == "python":
        inside = body
        if inside is None and search_text and signature and signature in search_text:
            inside = re.sub(r"^\s*:?[ \t]*\n?", "", search_text[search_text.find(signature) + len(signature) :], count=1)
        texts.append(opening_docstring(inside))
    best = ("", 0)
    for t in texts:
        p = prose(t)
        n = words_besides(p, name)
        if n > best[1]:
            best = (p, n)
    return best


def normalised_signature(signature: Column) -> Column:
    """A signature that tells overloads apart: modifiers, parameter names, defaults and blanks are dropped, types kept."""
    inside = F.regexp_extract(signature, r"\((.*)\)", 1)
    parameters = F.transform(
        F.split(inside, ","),
        lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"=.*$", ""), r"^\s*(?:self|&self|this)\s*$", ""), r"\s+|\b(?:const|final|mut|readonly|ref|in|out)\b", " ")),
    )
    kinds = F.transform(parameters, lambda p: F.when(p.rlike(r"^\w+\??\s*:"), F.regexp_replace(p, r"^\w+\??\s*:\s*", "")).otherwise(F.regexp_replace(p, r"\s+\w+$", "")))
    return F.concat_ws(",", F.filter(kinds, lambda p: p != ""))


def symbol_table(nodes: DataFrame) -> DataFrame:
    """(node_id, language, qualified, overload, name, signature, docstring, body, code, is_declaration, key) of live functions and methods."""
    table = symbols(nodes).where(F.col("kind").isin("function", "method"))
    rows = table.select(
        F.col("symbol_id").alias("node_id"), F.element_at(F.split("symbol_id", "::"), 1).alias("language"),
        F.concat_ws("::", F.element_at(F.split("symbol_id", "::"), 1), "package", "namespace", "name").alias("qualified"),
        F.coalesce(normalised_signature(F.col("signature")), F.lit("")).alias("overload"),
        F.coalesce("name", F.lit("")).alias("name"), "signature", "docstring", "body", F.col("search_text").alias("code"),
        (F.trim(F.coalesce("search_text", F.lit(""))).rlike(r"\)[^{}:]*;\s*$")).alias("is_declaration"),
    )
    return rows.withColumn("key", F.xxhash64("qualified", "overload"))


def documented(rows: DataFrame) -> DataFrame:
    """The symbol table with documentation and words, without the texts that these are from.

    Repeated and older states are folded into the latest one. Null or missing JSON keys are empty texts; kinds other than function
    and method, and deleted nodes, are left out.
    """
    columns = ["node_id", "language", "qualified", "overload", "name", "code", "is_declaration", "key"]

    def extract(batches):
        for b in batches:
            c = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names) if n in ("language", "name", "signature", "docstring", "body", "code")}
            found = [own_documentation(*x) for x in zip(c["language"], c["name"], c["signature"], c["docstring"], c["body"], c["code"])]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(b.schema.names.index(n)) for n in columns], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32())],
                [*columns, "documentation", "words"],
            )

    schema = ", ".join(f"{n} {dict(is_declaration='boolean', key='bigint').get(n, 'string')}" for n in columns)
    return rows.mapInArrow(extract, f"{schema}, documentation string, words int")


def pairs(nodes: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(node_id, code, documentation, words, documented_at) of every live function or method that is documented.

    The symbol table spans all files: a definition without own documentation takes that of a declaration of the same
    qualified name and the same normalised signature elsewhere (the longest, then the least node_id). Only then are
    absent and trivial texts left out. ``documented_at`` is the node that carries the text; for its own it is node_id.
    Qualified names with a large share of all rows are joined in salted shares.
    """
    rows = symbol_table(nodes)
    table = documented(rows)
    offered = table.where(F.col("words") >= least).groupBy("key", "qualified", "overload").agg(F.max(F.struct("words", "documentation", "node_id")).alias("d"))
    offered = offered.select("key", F.col("qualified").alias("_q"), F.col("overload").alias("_o"), "d")
    left, right = salted_pair(table, offered, "key", ["node_id"], heavy_keys(rows, "key"))
    same = (left["key"] == right["key"]) & (left["_salt"] == right["_salt"]) & (F.col("qualified") == F.col("_q")) & (F.col("overload") == F.col("_o"))
    own = F.col("words") >= least
    joined = left.join(right, same, "left").where(own | (F.col("d").isNotNull() & ~F.col("is_declaration")))
    return joined.select(
        "node_id", "code",
        F.when(own, F.col("documentation")).otherwise(F.col("d.documentation")).alias("documentation"),
        F.when(own, F.col("words")).otherwise(F.col("d.words")).alias("words"),
        F.when(own, F.col("node_id")).otherwise(F.col("d.node_id")).alias("documented_at"),
    )
