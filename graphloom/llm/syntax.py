"""Source files that do not parse, by minimum-cost syntax repair."""

from __future__ import annotations

from hashlib import blake2b

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.chart import Repair, repair
from graphloom.llm.languages import SUFFIXES, language_of, shared_chart, tokenize

#: Causes of a repair: merge conflict markers, the end is missing, the text is another language or none, anything else.
CAUSES = ("conflict", "truncation", "mismatch", "other")
#: Share of a text's tokens beyond which edits say that it is not of its language at all.
MISMATCH = 0.1
#: Parts a core of the files to repair, as their times differ a thousandfold.
PARTS = 16


def judge(path: str | None, source: bytes | str | None, known: dict[tuple, Repair] | None = None) -> tuple[str | None, int, bool, str | None, int | None]:
    """(language, edit cost, exact, cause, line of the first edit) of one file; cost 0 and no cause for a valid one.

    An empty or null source and a suffix of no known language are no fault. Costs are least, so ``exact`` always holds.
    Merge markers tell a conflict; edits at the very end a truncation; a text that another language reads, or of which
    more than a tenth would have to be edited, a mismatch. ``known`` holds the last repair, for a text of the same tokens.
    """
    language = language_of(path)
    if language is None or not source:
        return language, 0, True, None, None
    text = source if isinstance(source, str) else bytes(source).decode("utf-8", "replace")
    tokens, lines = tokenize(language, text, path)
    chart = shared_chart(language)
    if chart.accepts(tokens):
        return language, 0, True, None, None
    known, key = {} if known is None else known, (language, *tokens)
    if key not in known:
        known.clear()
        known[key] = repair(chart, tokens)
    found = known[key]
    last = len([t for t in tokens if t not in ("NL", "DEDENT")]) - 1
    if "CONFLICT" in tokens:
        cause = "conflict"
    elif found.places[0] >= last:
        cause = "truncation"
    elif found.cost > max(MISMATCH * len(tokens), 3) or any(_reads(other, text) for other in sorted(set(SUFFIXES.values())) if other != language):
        cause = "mismatch"
    else:
        cause = "other"
    return language, found.cost, found.exact, cause, lines[min(found.places[0], len(lines) - 1)] if lines else None


def _reads(language: str, text: str) -> bool:
    """Whether the text is valid in another language, read only as far as it is."""
    tokens, _ = tokenize(language, text)
    return bool(tokens) and shared_chart(language).accepts(tokens)


def _fault(path: str | None, source: bytes | str | None) -> bytes | None:
    """Null for a file that is valid or of no known language, else a digest of its language and tokens."""
    language = language_of(path)
    if language is None or not source:
        return None
    tokens, _ = tokenize(language, source if isinstance(source, str) else bytes(source).decode("utf-8", "replace"), path)
    return None if shared_chart(language).accepts(tokens) else blake2b("\0".join((language, *tokens)).encode("utf-8", "replace"), digest_size=16).digest()


def invalid_files(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, language, edit_cost, exact, cause, line) of every file, cost 0 for valid ones.

    Every row is parsed where it lies; those that do not parse are spread by their tokens and then repaired, equal ones once. Of
    repeated scans of a file the latest counts. Files of no known language have a null language and cost 0. Rows with a
    null file_id are left out; extra columns are ignored.
    """
    rows = files.where(F.col("file_id").isNotNull()).select("file_id", "repo_id", "scanned_at", "path", "source")
    names, types = [f.name for f in rows.schema], {f.name: f.dataType.simpleString() for f in rows.schema}

    def parse(batches):
        for b in batches:
            faults = [_fault(p, s) for p, s in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            valid = pa.array([x is None for x in faults])
            source = pa.compute.if_else(valid, pa.scalar(None, b.schema.field(4).type), b.column(4))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], source, pa.array(faults, pa.binary())], [*names, "fault"])

    def mend(batches):
        known: dict[tuple, Repair] = {}
        for b in batches:
            found = [judge(p, s, known) if x else (language_of(p), 0, True, None, None) for p, s, x in zip(*(b.column(i).to_pylist() for i in (3, 4, 5)))]
            own = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *own], ["file_id", "repo_id", "scanned_at", "language", "edit_cost", "exact", "cause", "line"])

    spark = files.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS * spark.sparkContext.defaultParallelism)
    parsed = rows.mapInArrow(parse, ", ".join(f"{n} {types[n]}" for n in names) + ", fault binary")
    spread = parsed.repartition(parts, F.coalesce("fault", F.encode(F.col("file_id").cast("string"), "utf-8"))).sortWithinPartitions("fault")
    judged = spread.mapInArrow(mend, f"file_id string, repo_id string, scanned_at {types['scanned_at']}, language string, edit_cost int, exact boolean, cause string, line int")
    values = ["repo_id", "language", "edit_cost", "exact", "cause", "line"]
    last = judged.groupBy("file_id").agg(F.max(F.struct("scanned_at", *values)).alias("s"))
    return last.select("file_id", *[F.col(f"s.{v}").alias(v) for v in values])


def rates(files: DataFrame) -> DataFrame:
    """Files, invalid files and their rate per repo_id and language, with the causes counted."""
    return (
        invalid_files(files).groupBy("repo_id", "language")
        .agg(
            F.count(F.lit(1)).alias("n_files"), F.count(F.when(F.col("edit_cost") > 0, 1)).alias("n_invalid"),
            *[F.count(F.when(F.col("cause") == c, 1)).alias(f"n_{c}") for c in CAUSES],
            F.sum("edit_cost").alias("edits"), F.count(F.when(~F.col("exact"), 1)).alias("n_bounded"),
        )
        .withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
    )
