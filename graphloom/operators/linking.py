"""Resolving references across files: names to symbols, modules to files, confirmed edges, bridges, lines to symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.references import package_of


def exports(symbols: DataFrame) -> DataFrame:
    """(package, name, target_id, rank): what can be referred to, under its package and every shorter suffix of it.

    ``rank`` 0 is the whole package, n a suffix without the first n parts. Members are also known as ``Owner.name``.
    """
    parts = F.split("package", r"\.")
    base = symbols.where(F.col("package").isNotNull() & F.col("name").isNotNull())
    names = F.array_compact(F.array(F.col("name"), F.when(F.length("namespace") > 0, F.concat_ws(".", "namespace", "name"))))
    x = base.select("symbol_id", parts.alias("parts"), F.explode(names).alias("name"))
    x = x.select("symbol_id", "name", "parts", F.explode(F.sequence(F.lit(0), F.size("parts") - 1)).alias("rank"))
    return x.select(F.concat_ws(".", F.slice("parts", F.col("rank") + 1, F.size("parts"))).alias("package"), "name", F.col("symbol_id").alias("target_id"), "rank")


def link_references(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref_id, label, src_symbol_id, target_id, how): each unresolved reference's best target.

    Looked up in the package it names, then in its own one, then by suffixes of package names, shorter ones last; the least
    target id decides among equals. Self-references and unknown kinds are no edges; repeated rows count once.
    """
    label = F.create_map(*[F.lit(x) for x in ("call", "CALLS", "reference", "REFERENCES", "inherits", "INHERITS", "implements", "IMPLEMENTS")])
    known = refs.where(F.col("name").isNotNull() & F.col("src_symbol_id").isNotNull()).select("ref_id", "src_symbol_id", "name", "qualifier", "package", label[F.col("kind")].alias("label")).where(F.col("label").isNotNull()).distinct()
    ways = F.array_compact(F.array(F.when(F.col("qualifier").isNotNull(), F.struct(F.lit(0).alias("way"), package_of(F.col("qualifier")).alias("package"))), F.struct(F.lit(1).alias("way"), F.col("package").alias("package"))))
    tries = known.select("ref_id", "src_symbol_id", "name", "label", F.explode(ways).alias("w")).select("ref_id", "src_symbol_id", "name", "label", "w.way", "w.package")
    hit = tries.join(exports(symbols), ["package", "name"]).where(F.col("target_id") != F.col("src_symbol_id"))
    best = hit.groupBy("ref_id", "label", "src_symbol_id").agg(F.min(F.struct("rank", "way", "target_id")).alias("b"))
    how = F.when(F.col("b.rank") > 0, "suffix").when(F.col("b.way") == 0, "qualifier").otherwise("package")
    return best.select("ref_id", "label", "src_symbol_id", F.col("b.target_id").alias("target_id"), how.alias("how"))


def modules_to_files(symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, file_id): the file that defines each module, where only one file of the package does."""
    files = symbols.where(F.col("file_id").isNotNull()).groupBy(F.col("package").alias("module")).agg(F.min("file_id").alias("file_id"), F.max("file_id").alias("last"))
    return modules.select("module").distinct().join(files.where(F.col("file_id") == F.col("last")), "module").select("module", "file_id")


def confirmed_edges(pairs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(label, src_id, dst_id): edges for confirmed (src_name, dst_name) pairs where either name belongs to one symbol only.

    Callable targets give calls, others references.
    """
    single = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("symbol_id").alias("id"), F.min("kind").alias("kind")).where("n = 1")
    src, dst = single.select(F.col("name").alias("src_name"), F.col("id").alias("src_id")), single.select(F.col("name").alias("dst_name"), F.col("id").alias("dst_id"), "kind")
    x = pairs.distinct().join(src, "src_name").join(dst, "dst_name").where(F.col("src_id") != F.col("dst_id"))
    return x.select(F.when(F.col("kind").isin("function", "method", "constructor"), "CALLS").otherwise("REFERENCES").alias("label"), "src_id", "dst_id").distinct()


def elevated(edges: DataFrame, symbols: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges whose (source name, target name) is confirmed have provenance scip, the others keep theirs."""
    names = symbols.select("symbol_id", "name")
    x = edges.join(names.select(F.col("symbol_id").alias("src_id"), F.col("name").alias("src_name")), "src_id", "left").join(names.select(F.col("symbol_id").alias("dst_id"), F.col("name").alias("dst_name")), "dst_id", "left")
    x = x.join(pairs.select("src_name", "dst_name").distinct().withColumn("_ok", F.lit(True)), ["src_name", "dst_name"], "left")
    return x.withColumn("provenance", F.when(F.col("_ok"), F.lit("scip")).otherwise(F.col("provenance"))).drop("_ok", "src_name", "dst_name")


def bridges(native: DataFrame, consumers: DataFrame) -> DataFrame:
    """(label, src_id, dst_id, provenance, synthesized_by): calls from script symbols to native ones of the name they consume.

    ``native``: (name, symbol_id); ``consumers``: (name, symbol_id). A name that only one side has makes no edge.
    """
    x = consumers.select("name", F.col("symbol_id").alias("src_id")).distinct().join(native.select("name", F.col("symbol_id").alias("dst_id")).distinct(), "name").where(F.col("src_id") != F.col("dst_id"))
    return x.select(F.lit("CALLS").alias("label"), "src_id", "dst_id", F.lit("heuristic").alias("provenance"), F.lit("bridge").alias("synthesized_by")).distinct()


def nearest_symbol(notes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(note_id, symbol_id): the first symbol at or below a note's line in its file, else the last one above it."""
    x = notes.select("note_id", "file_id", F.col("line").alias("at")).join(symbols.where(F.col("line").isNotNull()).select("file_id", "symbol_id", "line"), "file_id")
    g = x.groupBy("note_id").agg(F.min(F.when(F.col("line") >= F.col("at"), F.struct("line", "symbol_id"))).alias("next"), F.min(F.when(F.col("line") < F.col("at"), F.struct((-F.col("line")).alias("l"), "symbol_id"))).alias("last"))
    return g.select("note_id", F.coalesce("next.symbol_id", "last.symbol_id").alias("symbol_id"))


def changed_symbols(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(hunk_id, symbol_id): symbols that a changed range of lines touches and that hold no other symbol it touches.

    ``hunks``: (hunk_id, file_id, first, last).
    """
    spans = symbols.where(F.col("end_line").isNotNull() & F.col("line").isNotNull()).select("file_id", "symbol_id", F.col("line").alias("s"), F.col("end_line").alias("e"))
    hit = hunks.select("hunk_id", "file_id", "first", "last").distinct().join(spans, "file_id").where((F.col("s") <= F.col("last")) & (F.col("e") >= F.col("first"))).select("hunk_id", "symbol_id", "s", "e")
    a, b = hit.alias("a"), hit.alias("b")
    holds = (F.col("a.hunk_id") == F.col("b.hunk_id")) & (F.col("a.symbol_id") != F.col("b.symbol_id")) & (F.col("a.s") <= F.col("b.s")) & (F.col("a.e") >= F.col("b.e")) & ((F.col("a.s") < F.col("b.s")) | (F.col("a.e") > F.col("b.e")))
    return a.join(b, holds, "left_anti").select("hunk_id", "symbol_id")
