"""The index of source files as one job: parse what changed, replace its part of the graph, link references.

The index is a versioned table of parsed fragments; nodes and edges are views of it. A run compares contents by digest, parses
only files that are new or changed, and hides what belonged to changed and vanished files in the same commit, so a run
that fails leaves the index as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.linking import link_references
from graphloom.session import checkpointed
from graphloom.sources import parse
from graphloom.sources.versioned import Manifest, VersionedTable

_PROPERTIES = "name STRING, kind STRING, package STRING, namespace STRING, line INT, end_line INT, signature STRING, docstring STRING, body STRING, search_text STRING, qualifier STRING, ref_kind STRING, text STRING"
_COLUMNS = ["record", "id", "target", "kind", "file_id", "properties", "repo_id", "digest"]


def latest_files(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, path, source, digest): each path of a repository once, as it was scanned last; null sources are empty."""
    clean = F.regexp_replace("path", r"^[./]+", "")
    rows = files.where(F.col("path").isNotNull() & F.col("repo_id").isNotNull()).select("repo_id", clean.alias("path"), "scanned_at", F.coalesce("source", F.lit(b"")).alias("source"))
    last = rows.groupBy("repo_id", "path").agg(F.max(F.struct("scanned_at", "source")).alias("s"))
    return last.select(F.concat_ws(":", "repo_id", "path").alias("file_id"), "repo_id", "path", "s.source", F.sha2("s.source", 256).alias("digest"))


def index(table: VersionedTable, files: DataFrame, providers: dict | None = None) -> Manifest:
    """Brings the index up to ``files`` (repo_id, path, source, scanned_at), a full listing, in one commit; nothing changed: no new version.

    The first run is a full index. A file that its provider can't read has its file and an error record.
    """
    now = latest_files(files)
    base = table.manifest()
    fresh = now
    if base.files:
        rows = table.rows(base.version)
        known = rows.where("record = 'file'").select("file_id", "digest")
        fresh = now.join(known, ["file_id", "digest"], "left_anti")
        stale = known.join(now.select("file_id", "digest"), ["file_id", "digest"], "left_anti").select("file_id").distinct()
        gone = rows.join(stale, "file_id", "left_semi")
        fresh = checkpointed(fresh)
        if fresh.isEmpty() and stale.isEmpty():
            return base
    found = parse.fragments(fresh, providers).join(fresh.select("file_id", "repo_id", "digest"), "file_id").select(*_COLUMNS)
    return table.exchange(gone, found) if base.files else table.exchange(found, found)


def nodes(fragments: DataFrame) -> DataFrame:
    """(label, node_id, repo_id, file_id, properties) of files, symbols, design notes and routes."""
    label = F.create_map(*[F.lit(x) for x in ("file", "File", "symbol", "Symbol", "note", "DesignNote", "route", "Route")])
    return fragments.select(label[F.col("record")].alias("label"), F.col("id").alias("node_id"), "repo_id", "file_id", "properties").where(F.col("label").isNotNull())


def edges(fragments: DataFrame) -> DataFrame:
    """(label, src_id, dst_id, provenance, ref_kind, line): edges found inside files, routes to handlers, and references resolved across files."""
    p = fragments.withColumn("p", F.from_json("properties", _PROPERTIES))
    own = p.where("record IN ('edge', 'route') AND target IS NOT NULL").select(F.col("kind").alias("label"), F.col("id").alias("src_id"), F.col("target").alias("dst_id"), F.lit("treesitter").alias("provenance"), "p.ref_kind", "p.line")
    symbols = p.where("record = 'symbol'").select(F.col("id").alias("symbol_id"), "p.name", "p.package", "p.namespace")
    refs = p.where("record = 'ref'").select(F.col("id").alias("src_symbol_id"), F.col("target").alias("name"), "kind", "p.qualifier", "p.line").distinct()
    refs = refs.withColumn("ref_id", F.xxhash64("src_symbol_id", "name", "kind", "qualifier", "line")).join(symbols.select(F.col("symbol_id").alias("src_symbol_id"), "package").distinct(), "src_symbol_id")
    linked = link_references(refs, symbols).select("label", F.col("src_symbol_id").alias("src_id"), F.col("target_id").alias("dst_id"), F.lit("heuristic").alias("provenance"), F.lit(None).cast("string").alias("ref_kind"), "ref_id")
    linked = linked.join(refs.select("ref_id", "line"), "ref_id").drop("ref_id")
    return own.unionByName(linked).groupBy("label", "src_id", "dst_id").agg(F.max("provenance").alias("provenance"), F.max("ref_kind").alias("ref_kind"), F.min("line").alias("line"))
