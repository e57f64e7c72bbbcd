"""Text for readers: evidence spans, selector questions, Markdown within a budget, symbol inspection."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.tables import row_rank

#: Lines shown whole, and the windows around a point that are tried from wide to narrow.
WHOLE, WINDOWS = 120, (25, 12, 6, 2)


def span_of(text: str | None, line: int | None, budget: int) -> tuple[int, int, str]:
    """(first, last, text) of a symbol's lines: whole when short, else the widest window from its head that fits the budget."""
    lines = (text or "").split("\n")
    at = line or 1
    if len(lines) <= WHOLE and len(text or "") <= budget:
        return at, at + len(lines) - 1, text or ""
    for w in WINDOWS:
        part = "\n".join(lines[: 2 * w])
        if len(part) <= budget:
            return at, at + min(len(lines), 2 * w) - 1, part
    return at, at, (lines[0] if lines else "")[:budget]


_SPAN = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("digest", T.StringType())])


@F.pandas_udf(_SPAN)
def _spans(texts: pd.Series, lines: pd.Series, budgets: pd.Series) -> pd.DataFrame:
    rows = [span_of(t, None if pd.isna(n) else int(n), int(b)) for t, n, b in zip(texts, lines, budgets)]
    return pd.DataFrame({"first": [r[0] for r in rows], "last": [r[1] for r in rows], "text": [r[2] for r in rows], "digest": [hashlib.sha1(r[2].encode()).hexdigest()[:12] for r in rows]})


def evidence(items: DataFrame, spans: int = 3, budget: int = 4000) -> DataFrame:
    """(task_id, slot, file_id, first, last, digest, text): code of the first ``spans`` items of each task, with its content hash."""
    x = items.where(F.col("body").isNotNull()).select("task_id", "slot", "file_id", "line", "body", row_rank(["task_id"], [F.col("slot")], "k")).where(F.col("k") <= spans)
    return x.withColumn("s", _spans("body", "line", F.lit(budget))).select("task_id", "slot", "file_id", "s.first", "s.last", "s.digest", "s.text")


def outlined(text: str | None, spans: list[tuple[int, int]], head: int = 1) -> str:
    """A file's text with the inside of each (first, last) span folded to a marker after its first ``head`` lines."""
    lines = (text or "").split("\n")
    out, at = [], 1
    for first, last in sorted(set(spans)):
        if first < at or first + head > last:
            continue
        out += lines[at - 1 : first - 1 + head]
        out.append(f"… {first + head}-{last}")
        at = last + 1
    return "\n".join(out + lines[at - 1 :])


@F.pandas_udf(T.StringType())
def _outline(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([outlined(t, [(int(x["s"]), int(x["e"])) for x in s] if s is not None else []) for t, s in zip(texts, spans)])


def outlines(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, outline): each file (file_id, source) with the bodies of its symbols folded; nested ones fold with the outer."""
    spans = symbols.where(F.col("line").isNotNull() & F.col("end_line").isNotNull() & F.col("kind").isin("function", "method")).groupBy("file_id").agg(F.array_sort(F.collect_set(F.struct(F.col("line").alias("s"), F.col("end_line").alias("e")))).alias("spans"))
    text = F.regexp_replace(F.col("source").cast("string"), "\r\n", "\n")
    once = files.groupBy("file_id").agg(F.max("source").alias("source"))
    return once.join(spans, "file_id", "left").select("file_id", _outline(text, "spans").alias("outline"))


def questions(groups: DataFrame) -> DataFrame:
    """(task_id, file_id, question): what a selector is asked about each file, as JSON with sorted keys."""
    return groups.select("task_id", "file_id", F.to_json(F.struct("best_score", "file_id", "n_symbols", "names", "pos")).alias("question"))


def answers(replies: DataFrame) -> DataFrame:
    """(task_id, file_id, relevance) from JSON replies; numbers are held to 0 and 1, anything else is 0."""
    p = F.expr("try_cast(get_json_object(reply, '$.p') AS DOUBLE)")
    return replies.select("task_id", "file_id", F.coalesce(F.least(F.greatest(F.when(F.isnan(p), 0.0).otherwise(p), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias("relevance"))


def compact(items: DataFrame, most_chars: int = 6000) -> DataFrame:
    """(task_id, markdown, shown, left_out): each task's items as Markdown within a budget, in slot order.

    An item that no longer fits is left out, later and shorter ones may still fit.
    """
    line = F.concat(F.lit("- "), F.coalesce("name", "symbol_id"), F.lit(" ("), F.coalesce("file_id", F.lit("?")), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("?")), F.lit(")"))
    rows = F.array_sort(F.collect_list(F.struct("slot", line.alias("text"))))
    start = F.struct(F.lit("").alias("md"), F.lit(0).alias("n"), F.lit(0).alias("skipped"))

    def add(a, x):
        fits = F.length(a["md"]) + F.length(x["text"]) + 1 <= most_chars
        return F.when(fits, F.struct(F.concat(a["md"], x["text"], F.lit("\n")).alias("md"), (a["n"] + 1).alias("n"), a["skipped"].alias("skipped"))).otherwise(F.struct(a["md"].alias("md"), a["n"].alias("n"), (a["skipped"] + 1).alias("skipped")))

    g = items.groupBy("task_id").agg(F.aggregate(rows, start, add).alias("r"))
    return g.select("task_id", F.col("r.md").alias("markdown"), F.col("r.n").alias("shown"), F.col("r.skipped").alias("left_out"))


def inspected(ids: DataFrame, symbols: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """(symbol_id, section, other_id, line): a symbol's definition, callers, callees and references, each section cut to ``most``."""
    own = symbols.join(ids.select("symbol_id").distinct(), "symbol_id", "left_semi").select("symbol_id", F.lit("definition").alias("section"), F.col("file_id").alias("other_id"), "line")
    parts = [("callers", ["CALLS"], "dst_id", "src_id"), ("callees", ["CALLS"], "src_id", "dst_id"), ("references", ["REFERENCES"], "dst_id", "src_id"), ("subtypes", ["INHERITS", "IMPLEMENTS"], "dst_id", "src_id")]
    for name, labels, given, found in parts:
        x = edges.where(F.col("label").isin(labels)).select(F.col(given).alias("symbol_id"), F.col(found).alias("other_id"), "line").join(ids.select("symbol_id").distinct(), "symbol_id", "left_semi")
        own = own.unionByName(x.select("symbol_id", F.lit(name).alias("section"), "other_id", "line"))
    return own.distinct().select("*", row_rank(["symbol_id", "section"], [F.col("other_id"), F.coalesce("line", F.lit(0))])).where(F.col("rank") <= most).drop("rank")


def report(rows: list[dict], columns: list[str]) -> str:
    """A small collected aggregate as a Markdown table; null cells are empty."""
    head = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    return "\n".join(head + ["| " + " | ".join("" if r.get(c) is None else str(r[c]) for c in columns) + " |" for r in rows])


def envelope(tool: str, payload: dict, message: str = "", locale: str = "en") -> str:
    """A tool's answer; only the payload is part of the deterministic result."""
    return json.dumps({"tool": tool, "payload": payload, "message": message, "locale": locale}, sort_keys=True)
