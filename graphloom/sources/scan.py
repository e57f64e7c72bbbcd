"""Sources of an index: file trees, snapshots, histories, diffs, compiler indexes, benchmark cases."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import lower

# Folders that hold nothing written in the repository.
SKIPPED_FOLDERS = [".git", ".hg", ".svn", "node_modules", "venv", ".venv", "__pycache__", "dist", "build", "target", "vendor", "third_party", "bower_components", "site-packages"]
# Language by file extension.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "cs": "csharp",
    "c": "cpp", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "h": "cpp", "hh": "cpp", "hpp": "cpp", "kt": "kotlin", "swift": "swift", "rb": "ruby", "php": "php", "scala": "scala",
}
#: Characters of a text window, of its overlap with the next, and windows of a text.
WINDOW, OVERLAP, WINDOWS = 2000, 200, 12


def language_of(path):
    """Language by the extension of a path column; null for other files."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return table[lower(F.regexp_extract(path, r"\.([^./]+)$", 1))]


def source_files(spark: SparkSession, root: str, repo_id: str) -> DataFrame:
    """(file_id, repo_id, path, language, source) of all files of known languages below ``root``, skipped folders left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.expr(f"substring(regexp_replace(path, '^file:/+', '/'), {len(root.rstrip('/')) + 2})")
    parts = F.split(rel, "/")
    skipped = F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(x) for x in SKIPPED_FOLDERS]))
    out = raw.select(rel.alias("path"), "content", skipped.alias("skipped"))
    return out.where(~F.col("skipped") & language_of(F.col("path")).isNotNull()).select(F.concat(F.lit(repo_id + ":"), "path").alias("file_id"), F.lit(repo_id).alias("repo_id"), "path", language_of(F.col("path")).alias("language"), F.col("content").alias("source"))


def snapshot_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(status, file_id): A, M or D between two snapshots (file_id, source), by content hash; a rename is a deletion and an addition."""
    a = old.select("file_id", F.sha2("source", 256).alias("h")).distinct()
    b = new.select("file_id", F.sha2("source", 256).alias("g")).distinct()
    x = a.join(b, "file_id", "full_outer")
    status = F.when(F.col("h").isNull(), "A").when(F.col("g").isNull(), "D").when(F.col("h") != F.col("g"), "M")
    return x.select(status.alias("status"), "file_id").where(F.col("status").isNotNull())


def name_status(lines: DataFrame) -> DataFrame:
    """(status, path) from the lines (column value) of a name-status diff; unknown letters count as modified."""
    s = F.substring("value", 1, 1)
    return lines.where(F.length("value") > 0).select(F.when(s.isin("A", "D"), s).otherwise("M").alias("status"), F.element_at(F.split("value", "\t"), -1).alias("path"))


def log_churn(commits: DataFrame, window: int = 500) -> DataFrame:
    """(path, commits) from a history (seq, paths array), newest first by ``seq``: the last ``window`` commits count."""
    top = commits.agg(F.max("seq").alias("top"))
    recent = commits.join(F.broadcast(top)).where(F.col("seq") > F.col("top") - window)  # one row
    return recent.select("seq", F.explode("paths").alias("path")).distinct().groupBy("path").agg(F.count(F.lit(1)).alias("commits"))


def enclosing_definitions(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """(ref_id, symbol): the smallest definition range that holds each reference's line, ties by symbol."""
    x = references.select("ref_id", "file_id", "line").join(definitions.select("file_id", "symbol", "start", "end"), "file_id").where(F.col("line").between(F.col("start"), F.col("end")))
    return x.groupBy("ref_id").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("span"), "symbol")).alias("m")).select("ref_id", F.col("m.symbol").alias("symbol"))


def moniker_name(moniker):
    """Short name of a compiler index's symbol: its last descriptor without marks."""
    return F.regexp_extract(moniker, r"([A-Za-z_][\w$]*)[().#:`]*$", 1)


def diff_ranges(text: str | None) -> list[tuple[str, int, int]]:
    """(path, first, last) line ranges of the old side of a unified diff; an insertion touches the lines around it, new files none."""
    out, path = [], None
    for line in (text or "").splitlines():
        if line.startswith("--- "):
            name = line[4:].split("\t")[0].strip()
            path = None if name == "/dev/null" else re.sub(r"^a/", "", name)
        elif path and (m := re.match(r"@@ -(\d+)(?:,(\d+))? ", line)):
            first, n = int(m[1]), int(m[2] or 1)
            out.append((path, first, first + n - 1) if n else (path, max(first, 1), first + 1))
    return out


_RANGE = T.StructType([T.StructField("path", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])


@F.pandas_udf(T.ArrayType(_RANGE))
def unified_diff(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"path": p, "first": a, "last": b} for p, a, b in diff_ranges(t)])


def text_windows(text: str | None) -> list[str]:
    """Overlapping windows of a long text, cut at the last line end of their second half."""
    out, at, text = [], 0, text or ""
    while at < len(text) and len(out) < WINDOWS:
        end = min(len(text), at + WINDOW)
        if end < len(text) and (cut := text.rfind("\n", at + WINDOW // 2, end)) > 0:
            end = cut + 1
        out.append(text[at:end])
        if end >= len(text):
            break
        at = max(end - OVERLAP, at + 1)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def windows(texts: pd.Series) -> pd.Series:
    return texts.map(text_windows)


def chunks(items: DataFrame) -> DataFrame:
    """(ref_id, chunk, content) of items (ref_id, header, text): every window under the item's header."""
    x = items.select("ref_id", "header", F.posexplode(windows("text")).alias("chunk", "body"))
    return x.select("ref_id", "chunk", F.concat_ws("\n", "header", "body").alias("content"))


def symbol_id(language: str, package: str, namespace: str, kind: str, name: str, signature: str) -> str:
    digest = hashlib.blake2b("\x1f".join([language, package, namespace, kind, name, signature]).encode(), digest_size=8).hexdigest()
    return f"{language}::{package}::{namespace}::{name}#{digest}"


def bench_cases(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark cases of a JSON array: name, task_text, relevant_symbol_ids, repo_ids, max_candidates."""
    schema = "name STRING, task_text STRING, relevant_symbol_ids ARRAY<STRING>, explicit_symbols ARRAY<STRING>, route_paths ARRAY<STRING>, history_file_ids ARRAY<STRING>, repo_ids ARRAY<STRING>, forbidden_repo_ids ARRAY<STRING>, commit STRING, max_candidates INT"
    return spark.read.schema(schema).option("multiLine", "true").json(path).fillna(8, ["max_candidates"])


def repository_url(url):
    """(workspace, slug) of a hosted repository's address."""
    return F.struct(F.regexp_extract(url, r"[/:]([^/:]+)/[^/]+?(?:\.git)?/?$", 1).alias("workspace"), F.regexp_extract(url, r"/([^/]+?)(?:\.git)?/?$", 1).alias("slug"))
