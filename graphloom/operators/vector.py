"""Exact nearest neighbours in blocks, chunk collapse, and the hashing encoder."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.tables import row_rank

#: Queries and rows of a block, about: a block of queries meets a block of rows in one matrix product.
QUERY_BLOCK, ROW_BLOCK = 512, 8192
#: Rows that an index is fitted on, cells it has at most, and cells that a query looks into.
SAMPLE, CELLS, PROBES = 20_000, 256, 24
SEED = 11


def _unit(x: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    m = np.array(x.tolist(), dtype=np.float64)
    length = np.sqrt((m * m).sum(axis=1))
    return m / np.where(length == 0, 1, length)[:, None], length > 0


def _best(k: int, same: list[str]):
    """The ``k`` nearest rows of ``a`` to each query of ``b``, from one product of both blocks."""

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "ref_id", "chunk", "distance"]
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in columns})
        x, x_ok = _unit(a["embedding"])
        y, y_ok = _unit(b["embedding"])
        d = np.round(1 - y @ x.T, 6)
        d[:, ~x_ok] = d[~y_ok] = np.inf
        for c in same:
            d[b[c].to_numpy()[:, None] != a[c].to_numpy()[None, :]] = np.inf
        ids, chunks, queries = a["ref_id"].to_numpy(), a["chunk"].to_numpy(), b["query_id"].to_numpy()
        worst = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.full((len(d), 1), np.inf)
        q, r = np.nonzero((d <= worst) & np.isfinite(d))  # equal distances may be more than k
        order = np.lexsort((chunks[r], ids[r], d[q, r], q))
        q, r = q[order], r[order]
        first = np.searchsorted(q, q, "left")
        keep = np.arange(len(q)) - first < k
        q, r = q[keep], r[keep]
        return pd.DataFrame({"query_id": queries[q], "ref_id": ids[r], "chunk": chunks[r], "distance": d[q, r]})

    return product


_FOUND = "query_id long, ref_id long, chunk long, distance double"


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, same: list[str] | None = None) -> DataFrame:
    """(query_id, ref_id, chunk, distance, rank): the ``k`` rows of least cosine distance to each query, exactly.

    ``rows``: (ref_id, chunk, embedding, *same); ``queries``: (query_id, embedding, *same); ``same`` columns must be equal.
    Blocks have a fixed size whatever the tables' sizes; each pair of blocks keeps its best k per query, and the pairs' lists are
    merged; ties go by ref_id, chunk. Null vectors and vectors of length 0 are left out; distances are rounded to 6
    decimals before they are ordered.
    """
    same = same or []
    rows, queries = rows.where(F.col("embedding").isNotNull()), queries.where(F.col("embedding").isNotNull())
    n_rows, n_queries = (max(1, -(-x.count() // size)) for x, size in ((rows, ROW_BLOCK), (queries, QUERY_BLOCK)))
    r = rows.withColumn("rb", F.pmod(F.xxhash64("ref_id", "chunk"), F.lit(n_rows)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    q = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_queries)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    q = q.select("query_id", F.col("embedding").alias("vector"), *same, "qb", "rb").withColumnRenamed("vector", "embedding")  # a column of its own where both tables are one
    found = r.groupBy("rb", "qb").cogroup(q.groupBy("rb", "qb")).applyInPandas(_best(k, same), _FOUND)
    return found.select("*", row_rank(["query_id"], [F.col("distance"), F.col("ref_id"), F.col("chunk")])).where(F.col("rank") <= k)


def fit_cells(rows: DataFrame, cells: int = CELLS, sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """Unit centres of at most ``cells`` cells, by k-means on the ``sample`` rows of least hash; none for an empty table."""
    some = rows.where(F.col("embedding").isNotNull()).orderBy(F.xxhash64("ref_id", "chunk", F.lit(SEED)), "ref_id", "chunk").limit(sample).select("embedding").toPandas()  # at most SAMPLE vectors
    if not len(some):
        return np.zeros((0, 1))
    x, ok = _unit(some["embedding"])
    x = x[ok]
    rng = np.random.default_rng(SEED)
    centres = x[rng.permutation(len(x))[: max(1, min(cells, len(x) // 16))]]
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        length = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(length[:, None] > 0, sums / np.where(length == 0, 1, length)[:, None], centres)
    return centres


def in_cells(df: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """``df`` with ``cell``: one row for each of the ``probes`` cells whose centres are nearest to its vector. Every row has a cell."""
    shared = df.sparkSession.sparkContext.broadcast(centres)  # CELLS vectors

    @F.pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        x, _ = _unit(v)
        return pd.Series(np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :probes].tolist())

    return df.where(F.col("embedding").isNotNull()).withColumn("cell", F.explode(cells("embedding")))


def nearest_by_index(rows: DataFrame, queries: DataFrame, k: int = 10, probes: int = PROBES) -> DataFrame:
    """Like ``nearest``, but a query meets only the rows of its ``probes`` nearest cells; some neighbours may be missed.

    The index holds every row; only its centres are from a sample. A cell with many rows is cut into blocks of a fixed
    size, so no cell meets in one task.
    """
    centres = fit_cells(rows)
    if not len(centres):
        return nearest(rows, queries, k)
    indexed = in_cells(rows, centres)
    sizes = indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.ceil(F.col("n") / ROW_BLOCK).cast("int").alias("blocks"))
    small = F.broadcast(sizes)  # one row a cell
    r = indexed.join(small, "cell").withColumn("rb", F.pmod(F.xxhash64("ref_id", "chunk"), F.col("blocks")).cast("int")).drop("blocks")
    q = in_cells(queries, centres, probes).join(small, "cell").withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    q = q.select("query_id", F.col("embedding").alias("vector"), "cell", "rb").withColumnRenamed("vector", "embedding")  # a column of its own where both tables are one
    found = r.groupBy("cell", "rb").cogroup(q.groupBy("cell", "rb")).applyInPandas(_best(k, []), _FOUND)
    return found.select("*", row_rank(["query_id"], [F.col("distance"), F.col("ref_id"), F.col("chunk")])).where(F.col("rank") <= k)


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_queries, recall): share of the exact neighbours that were found."""
    hit = exact.select("query_id", "ref_id").join(found.select("query_id", "ref_id").distinct().withColumn("_f", F.lit(1)), ["query_id", "ref_id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("n_queries"), F.round(F.coalesce(F.count("_f") / F.count(F.lit(1)), F.lit(0.0)), 6).alias("recall"))


def one_model(embeddings: DataFrame, model: str, dim: int) -> DataFrame:
    """The stored vectors (kind, model, embedding, ...), refused if any of them is of another model or size than the encoder's."""
    other = embeddings.where(~F.col("model").eqNullSafe(F.lit(model)) | (F.size("embedding") != dim)).limit(1).count()
    if other:
        raise ValueError(f"stored vectors are not all of model {model} with {dim} dimensions")
    return embeddings


def semantic_candidates(hits: DataFrame, symbols: DataFrame, limit: int) -> DataFrame:
    """(query_id, symbol_id, semantic_rank): neighbours (query_id, ref_id, distance) fetched beyond the limit, each symbol at its
    nearest chunk, tests left out, the first ``limit`` ranked anew from 0. ``symbols``: (ref_id, symbol_id, is_test)."""
    kept = collapsed(hits).drop("rank").join(symbols.where(~F.col("is_test")).select("ref_id", "symbol_id"), "ref_id")
    ranked = kept.select("query_id", "symbol_id", row_rank(["query_id"], [F.col("distance"), F.col("symbol_id")], "k")).where(F.col("k") <= limit)
    return ranked.select("query_id", "symbol_id", (F.col("k") - 1).alias("semantic_rank"))


def collapsed(hits: DataFrame) -> DataFrame:
    """(query_id, ref_id, distance, rank): each reference once, at its nearest chunk."""
    best = hits.groupBy("query_id", "ref_id").agg(F.min("distance").alias("distance"))
    return best.select("*", row_rank(["query_id"], [F.col("distance"), F.col("ref_id")]))


def hashed_vector(text: str | None, dim: int = 256) -> list[float]:
    """A text as signed counts of its hashed words and word parts, scaled to length 1; zeros for an empty text."""
    out = np.zeros(dim)
    for word in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", text or ""):
        h = hashlib.blake2b(word.lower().encode(), digest_size=8).digest()
        out[int.from_bytes(h[:4], "big") % dim] += 1.0 if h[4] & 1 else -1.0
    length = float(np.sqrt(out @ out))
    return (out / length if length else out).tolist()


def hashing_encoder(dim: int = 256):
    """The encoder that needs no model, as a vectorised function of a text column."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashed_vector(t, dim))

    return encode
