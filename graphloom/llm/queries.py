"""Queries of the operators for training data, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import code_docs, handwritten, mixture, rank_fusion, spans, syntax, tokens
from graphloom.tables import read, read_wide


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rank_fusion.leaders(read(spark, d, "candidate"))


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    return rank_fusion.borda(read(spark, d, "candidate")).drop("leads")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return code_docs.pairs(read(spark, d, "graph_node")).where(F.col("documented_at") == F.col("node_id")).select("node_id")


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return code_docs.pairs(read(spark, d, "graph_node"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_files(read_wide(spark, d, "source_file")).where(F.col("edit_cost") > 0).select("file_id")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(read_wide(spark, d, "source_file"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    files, _ = handwritten.judged(read_wide(spark, d, "source_file"), read(spark, d, "upstream_file"))
    return files.where(F.col("evidence").isNotNull()).select("file_id")


def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Files and mean score by kind (null for hand-written ones) and by what decided."""
    files, _ = handwritten.judged(read_wide(spark, d, "source_file"), read(spark, d, "upstream_file"))
    return files.groupBy("kind", "evidence").agg(F.count(F.lit(1)).alias("n_files"), F.round(F.avg("score"), 3).alias("mean_score"))


def p4_validation(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, precision and recall of the machine alone on all files of the repositories it has not seen."""
    return handwritten.validated(read_wide(spark, d, "source_file"), read(spark, d, "upstream_file"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(read_wide(spark, d, "documents")).select("doc_id", "ids")


def p8_offsets(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(read_wide(spark, d, "documents")).select("doc_id", "offsets")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(read_wide(spark, d, "documents"), read(spark, d, "mix_target"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shares(read_wide(spark, d, "documents"), read(spark, d, "mix_target"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(read_wide(spark, d, "documents"))


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_parts(read_wide(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_ranking, p2_found, p2_pairs, p3_found, p3_rates, p4_found, p4_kinds, p4_validation, p8_ids, p8_offsets, p9_mixture, p9_shares, p10_found, p10_shared)}

_RANKS = """
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id, symbol_id ORDER BY retrieved_at DESC) AS rn FROM candidate) WHERE rn = 1),
long AS (SELECT task_id, symbol_id, 1 AS s, CAST(degree AS DOUBLE) AS v FROM last UNION ALL SELECT task_id, symbol_id, 2, CASE WHEN isnan(task_signal) THEN NULL ELSE task_signal END FROM last
  UNION ALL SELECT task_id, symbol_id, 3, -CAST(graph_distance AS DOUBLE) FROM last UNION ALL SELECT task_id, symbol_id, 4, anchor_strength FROM last),
ranks AS (SELECT *, count(v) OVER (PARTITION BY task_id, s) AS m, count(*) OVER (PARTITION BY task_id, s, v) AS tied, rank() OVER (PARTITION BY task_id, s ORDER BY v DESC NULLS LAST) - 1 AS better FROM long)
"""
_WINDOWS = """w AS (SELECT doc_id, i, md5(substr(text, i + 1, 160)) AS h FROM (SELECT doc_id, text, unnest(range(length(text) - 159)) AS i FROM documents WHERE length(text) >= 160)),
  several AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), k AS (SELECT w.* FROM w SEMI JOIN several USING (h))"""
ORACLE = {
    "p10_found": f"WITH {_WINDOWS}, d AS (SELECT DISTINCT doc_id, h FROM k) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p10_shared": f"""WITH {_WINDOWS}, p AS (SELECT doc_id, i, coalesce(max(i + 160) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM k),
        c AS (SELECT doc_id, sum(i + 160 - greatest(i, done)) AS n FROM p GROUP BY doc_id)
        SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(n, 0)::BIGINT AS shared_chars, round(coalesce(coalesce(n, 0) / nullif(length(text), 0), 0), 6) AS shared_share FROM documents LEFT JOIN c USING (doc_id)""",
    "p1_found": f"WITH {_RANKS} SELECT task_id, symbol_id FROM ranks GROUP BY task_id, symbol_id HAVING bool_and(v IS NOT NULL AND better < 5)",
    "p1_ranking": f"""WITH {_RANKS}, p AS (SELECT task_id, symbol_id, round(sum(CASE WHEN v IS NULL THEN greatest((m - 1) / 2, 0) ELSE m - (better + (tied + 1) / 2) END), 6) AS points FROM ranks GROUP BY task_id, symbol_id)
        SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY points DESC, symbol_id) AS rank FROM p""",
}
