"""Immutable table versions: manifests of data files and deletion vectors, and the record deltas between two versions.

A version is one JSON manifest ``_versions/<n>.json`` naming immutable parquet files, the deletion vectors that hide
some of their rows, and the source version that the writer had processed. A commit creates its manifest file, failing
if another writer was first; data written by a run that dies before its commit is in no manifest and so is never read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VECTOR_SCHEMA = "file STRING, bucket BIGINT, bits BINARY"


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass
class Manifest:
    """``files``: data files; ``vectors``: folders of deletion vectors that apply; ``processed``: source version per source
    name; ``state``: folders of what was derived from this version."""

    version: int
    files: list[str] = field(default_factory=list)
    vectors: list[str] = field(default_factory=list)
    processed: dict[str, int] = field(default_factory=dict)
    state: dict[str, str] = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _name(file: str) -> str:
    """A file's last part, which is the same however its folder is written."""
    return unquote(file.rsplit("/", 1)[-1])


def list_files(spark: SparkSession, path: str) -> list[str]:
    """The parquet files of a path, qualified as the ``_metadata.file_path`` of their rows, in order."""
    return sorted(spark.read.parquet(path).inputFiles())


def positions(df: DataFrame) -> DataFrame:
    """``df``, read from parquet, with ``_file`` and ``_pos``, the position of each row in its file."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_pos"))


def vectors_of(rows: DataFrame, *by: str) -> DataFrame:
    """(file, bucket, bits, *by) bitmaps of the (``_file``, ``_pos``) rows, 32 768 positions to a bucket, combined map-side."""
    return rows.groupBy(F.col("_file").alias("file"), F.expr("bitmap_bucket_number(_pos + 1)").alias("bucket"), *by).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(_pos + 1))").alias("bits")
    )


def is_set():
    """Whether the row's ``bits`` hold its ``_pos``; a missing bitmap holds none."""
    bit = F.expr("CAST(bitmap_bit_position(_pos + 1) AS INT)")
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("getbit", byte, bit % 8) == 1, F.lit(False))


class VersionedTable:
    """A table below ``root``; all versions stay readable."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self, version: int | None = None) -> Manifest:
        """A version's manifest, the newest if none is given; version 0 is the empty table before any commit."""
        version = self.version() if version is None else version
        if version == 0:
            return Manifest(0)
        fs, p = _fs(self.spark, f"{self.root}/_versions/{version:020d}.json")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def version(self) -> int:
        fs, p = _fs(self.spark, f"{self.root}/_versions")
        if not fs.exists(p):
            return 0
        return max([int(s.getPath().getName()[:20]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")], default=0)

    def commit(self, manifest: Manifest) -> Manifest:
        """Publishes a manifest under its version; raises CommitConflict if that version exists."""
        fs, p = _fs(self.spark, f"{self.root}/_versions/{manifest.version:020d}.json")
        _, temporary = _fs(self.spark, f"{self.root}/_versions/.{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        out.write(json.dumps(asdict(manifest), sort_keys=True).encode())
        out.close()
        if fs.exists(p) or not fs.rename(temporary, p):
            fs.delete(temporary, False)
            raise CommitConflict(f"version {manifest.version} of {self.root} exists")
        return manifest

    def append(self, df: DataFrame, processed: dict[str, int] | None = None, expected: int | None = None) -> Manifest:
        """Adds the rows of ``df`` and records what was processed for them, in one commit on version ``expected``."""
        base = self.manifest(expected)
        part = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(part)
        files = list_files(self.spark, part) if _fs(self.spark, part)[0].exists(_fs(self.spark, part)[1]) else []
        return self.commit(Manifest(base.version + 1, sorted({*base.files, *files}), base.vectors, base.processed | (processed or {})))

    def replace(self, df: DataFrame, processed: dict[str, int], expected: int) -> Manifest:
        """A version of the rows of ``df`` alone, with what was processed for them, in one commit on version ``expected``."""
        part = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(part)
        return self.commit(Manifest(expected + 1, list_files(self.spark, part), [], self.manifest(expected).processed | processed))

    def exchange(self, gone: DataFrame, df: DataFrame, processed: dict[str, int] | None = None) -> Manifest:
        """Hides the rows of ``gone`` (``_file``, ``_pos``) and adds those of ``df`` in one commit."""
        base = self.manifest()
        part = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(part)
        vectors = [*base.vectors, self.write_vectors(gone)] if base.files else []
        return self.commit(Manifest(base.version + 1, sorted({*base.files, *list_files(self.spark, part)}), vectors, base.processed | (processed or {})))

    def adopt(self, files: list[str], vectors: list[str] | None = None, processed: dict[str, int] | None = None) -> Manifest:
        """A version of files written elsewhere, which nobody changes any more."""
        base = self.manifest()
        return self.commit(Manifest(base.version + 1, sorted(files), vectors or [], base.processed | (processed or {})))

    def write_vectors(self, rows: DataFrame) -> str:
        """Stores the deletion vectors of (``_file``, ``_pos``) rows; they hide nothing before a manifest names them."""
        path = f"{self.root}/vectors/{uuid.uuid4().hex}"
        vectors_of(rows).write.parquet(path)
        return path

    def delete(self, rows: DataFrame) -> Manifest:
        """Hides (``_file``, ``_pos``) rows in a new version; data files stay as they are."""
        base = self.manifest()
        return self.commit(Manifest(base.version + 1, base.files, [*base.vectors, self.write_vectors(rows)], base.processed))

    def _vectors(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], VECTOR_SCHEMA)
        return self.spark.read.schema(VECTOR_SCHEMA).parquet(*folders).groupBy("file", "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))

    def _hidden(self, rows: DataFrame, folders: list[str], name: str) -> DataFrame:
        """``rows`` with a flag: hidden by the vectors of these folders."""
        if not folders:
            return rows.withColumn(name, F.lit(False))
        keyed = rows.withColumn("_bucket", F.expr("bitmap_bucket_number(_pos + 1)"))
        joined = keyed.join(self._vectors(folders), (F.col("_file") == F.col("file")) & (F.col("_bucket") == F.col("bucket")), "left")
        return joined.withColumn(name, is_set()).drop("file", "bucket", "bits", "_bucket")

    def _rows(self, files: list[str], like: list[str]) -> DataFrame:
        if files:
            return positions(self.spark.read.parquet(*files))
        empty = self.spark.createDataFrame([], self.spark.read.parquet(*like[:1]).schema) if like else self.spark.createDataFrame([], "_none INT")
        return empty.select("*", F.lit("").alias("_file"), F.lit(0).cast("bigint").alias("_pos"))

    def rows(self, version: int | None = None) -> DataFrame:
        """The visible rows of a version, with ``_file`` and ``_pos``."""
        m = self.manifest(version)
        return self._hidden(self._rows(m.files, m.files), m.vectors, "_h").where(~F.col("_h")).drop("_h")

    def changes(self, since: int | Manifest, until: int | Manifest | None = None) -> DataFrame:
        """Record deltas between two versions or manifests, with ``_change`` insert or delete.

        Found by diffing the manifests alone: rows of added files appear, rows of removed files disappear, and rows of
        kept files change only where their deletion vectors differ. Kept files that no vector names aren't read.
        """
        a, b = (m if isinstance(m, Manifest) else self.manifest(m) for m in (since, until))
        both, old, new = sorted({*a.files} & {*b.files}), sorted({*a.files} - {*b.files}), sorted({*b.files} - {*a.files})
        like = a.files or b.files
        added = self._hidden(self._rows(new, like), b.vectors, "_h").where(~F.col("_h")).drop("_h").withColumn("_change", F.lit("insert"))
        removed = self._hidden(self._rows(old, like), a.vectors, "_h").where(~F.col("_h")).drop("_h").withColumn("_change", F.lit("delete"))
        out = added.unionByName(removed) if old else added
        if both and a.vectors != b.vectors:
            vectors = self.spark.read.schema(VECTOR_SCHEMA).parquet(*a.vectors, *b.vectors)
            named = {_name(r["file"]) for r in vectors.select("file").distinct().collect()}  # no more than the manifests name
            both = [f for f in both if _name(f) in named]
        if both and a.vectors != b.vectors:
            touched = self._hidden(self._hidden(self._rows(both, like), a.vectors, "_was"), b.vectors, "_is").where(F.col("_was") != F.col("_is"))
            out = out.unionByName(touched.withColumn("_change", F.when(F.col("_is"), F.lit("delete")).otherwise(F.lit("insert"))).drop("_was", "_is"))
        return out


def process_new(source: VersionedTable, target: VersionedTable, name: str, work) -> Manifest | None:
    """One incremental run: ``work`` gets the deltas since the version that ``target`` last committed for ``name``.

    Output and processed version are one commit, so a run that fails at any point is repeated from the same version and
    a finished one is never repeated. No new version: nothing is done.
    """
    base = target.manifest()
    until, since = source.version(), base.processed.get(name, 0)
    if until == since:
        return None
    return target.append(work(source.changes(since, until)), {name: until}, base.version)
