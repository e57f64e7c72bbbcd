"""Long exact spans shared between records.

Every span of ``length`` code points holds, at the same place in each of its copies, a window of ``WINDOW`` code points
picked by its own content alone (the least hash of ``length - WINDOW + 1`` neighbours). Count-min sketches of the picked
windows, one per partition, are merged and say which windows may be repeated; they never say too few. A second pass
groups exactly those windows, and the text around each decides whether the span reaches ``length``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.heavy_keys import salted_pair
from graphloom.session import checkpointed

#: Least shared span in code points.
LENGTH = 160
#: Code points of a picked window.
WINDOW = 96
#: Rows of the count-min sketch, and counters per segment of a row.
DEPTH, SEGMENT = 4, 1 << 16
#: Counters of a sketch row at most (2 MB of the broadcast bitmap a row); from 8 windows a counter on, more pass than need be.
WIDEST = 1 << 24

#: Code points hashed at once.
TOGETHER = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _power_arrays(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            up, down = np.full(size, _BASE), np.full(size, _INVERSE)
            up[0] = down[0] = 1
            _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def window_hashes(text: str, window: int) -> np.ndarray:
    """64-bit hash of every window of ``window`` code points, from prefix sums modulo 2^64."""
    points = _mixed(_points(text).astype(np.uint64) + np.uint64(1))
    if len(points) < window:
        return np.zeros(0, np.uint64)
    up, down = _power_arrays(len(points) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * down[: len(points)], dtype=np.uint64)])
        n = len(points) - window + 1
        return _mixed((sums[window:] - sums[:n]) * up[:n])


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each ``width`` neighbours, by doubling."""
    pick, have = (np.minimum if least else np.maximum), 1
    while have < width:
        step = min(have, width - have)
        x = pick(x[: len(x) - step], x[step:])
        have += step
    return x


def picked(text: str, length: int = LENGTH, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the windows that are least in some ``length`` code points; equal least ones are all picked."""
    _, at, h = picked_of([text], length, window)
    return at, h


def picked_of(texts: list[str], length: int = LENGTH, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, position, hash) of the picked windows of several texts, charted as one array.

    Stretches of ``length`` that reach over the end of a text count for none of its windows, so every text has what it has alone.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = "".join(texts)
    if len(joined) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = window_hashes(joined, window)
    width = length - window + 1
    low = _sliding(h, width, True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    inside = np.zeros(len(joined) + 1, np.int64)  # 1 where a whole stretch of its text begins
    whole = sizes >= length
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, ends[whole] - length + 1, -1)
    low = np.where(np.cumsum(inside)[: len(low)] > 0, low, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    reach = _sliding(np.concatenate([pad, low, pad]), width, False)
    at = np.flatnonzero((reach == h) & (h > 0))
    of = np.searchsorted(ends, at, "right")
    return of, at - starts[of], h[at]


def _groups(texts: list[str]) -> list[list[int]]:
    """Numbers of the texts, in runs of about ``TOGETHER`` code points; a longer text is a run of its own."""
    out: list[list[int]] = [[]]
    size = 0
    for i, t in enumerate(texts):
        if out[-1] and size + len(t) > TOGETHER:
            out.append([])
            size = 0
        out[-1].append(i)
        size += len(t)
    return out


def _buckets(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mixed(hashes + np.uint64(row + 1) * _BASE) & np.uint64(width - 1)).astype(np.int64)


def repeated_bitmap(texts: DataFrame, width: int, length: int, window: int) -> list[bytes]:
    """Per sketch row the bits of the counters that reach 2, from sketches of all windows of all texts.

    Each partition keeps one sketch of saturating counters; its non-empty segments are compressed and merged by
    (row, segment). What reaches the driver, and the tasks of the next pass, is ``DEPTH * width / 8`` bytes.
    """
    depth, segment = DEPTH, min(SEGMENT, width)

    def sketch(batches):
        rows = np.zeros((depth, width), np.uint8)
        for b in batches:
            texts = b.column(0).to_pylist()
            for group in _groups(texts):
                of, _, h = picked_of([texts[i] for i in group], length, window)
                order = np.lexsort((h, of))  # within one text a window counts once
                of, h = of[order], h[order]
                own = h[np.append(True, (of[1:] != of[:-1]) | (h[1:] != h[:-1]))[: len(h)]]
                for r in range(depth):
                    at, n = np.unique(_buckets(own, r, width), return_counts=True)
                    rows[r, at] = np.minimum(rows[r, at] + np.minimum(n, 2), 2).astype(np.uint8)
        parts = [(r, s, zlib.compress(x.tobytes(), 1)) for r in range(depth) for s in range(width // segment) if (x := rows[r, s * segment : (s + 1) * segment]).any()]
        for i in range(0, len(parts), 256):
            yield pa.RecordBatch.from_pylist([{"r": r, "s": s, "c": c} for r, s, c in parts[i : i + 256]], pa.schema([("r", pa.int32()), ("s", pa.int32()), ("c", pa.binary())]))

    def merge(key: tuple, it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:  # a segment of every partition, one batch at a time
        total = np.zeros(segment, np.uint8)
        for pdf in it:
            for c in pdf["c"]:
                total = np.minimum(total + np.frombuffer(zlib.decompress(c), np.uint8), 2)
        yield pd.DataFrame({"r": [key[0]], "s": [key[1]], "bits": [np.packbits(total >= 2, bitorder="little").tobytes()]})

    merged = texts.select("text").mapInArrow(sketch, "r int, s int, c binary").groupBy("r", "s").applyInPandas(merge, "r int, s int, bits binary")
    out = [bytearray(width // 8) for _ in range(depth)]
    for row in merged.collect():  # DEPTH * width / 8 bytes, 8 MB at most
        out[row["r"]][row["s"] * segment // 8 : (row["s"] + 1) * segment // 8] = row["bits"]
    return [bytes(x) for x in out]


def classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id): documents with equal text share the least doc_id as their class; texts below LENGTH are left out."""
    keyed = documents.where(F.length("text") >= LENGTH).select("doc_id", F.sha2("text", 256).alias("h"))
    firsts = keyed.groupBy("h").agg(F.min("doc_id").alias("class_id"))
    left, right = salted_pair(keyed, firsts, "h", ["doc_id"])
    return left.join(right, ["h", "_salt"]).select("doc_id", "class_id")


def repeated_windows(texts: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """(h, id, pos): the picked windows of ``texts`` (id, text) that stand in at least two of them, found by two passes.

    The first counts all windows in sketches, one a partition, that are merged and broadcast as bits; the second groups
    exactly those that the bits let through. These are rows of three numbers: however many pass a sketch
    that is narrow for its corpus, they cost a fraction of the text, and none is lost.
    """
    spark = texts.sparkSession
    points = texts.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    expected = 2 * points // (length - window + 2) + 1
    width = min(WIDEST, max(SEGMENT, 1 << (2 * expected - 1).bit_length()))
    bitmap = spark.sparkContext.broadcast(repeated_bitmap(texts, width, length, window))  # DEPTH * width / 8 bytes, 8 MB at most

    def second(batches):
        bits = [np.frombuffer(x, np.uint8) for x in bitmap.value]
        for b in batches:
            ids, contents = np.array(b.column(0).to_pylist(), np.int64), b.column(1).to_pylist()
            for group in _groups(contents):
                of, at, h = picked_of([contents[i] for i in group], length, window)
                keep = np.ones(len(h), bool)
                for r in range(DEPTH):
                    k = _buckets(h, r, width)
                    keep &= (bits[r][k >> 3] >> (k & 7) & 1).astype(bool)
                if keep.any():
                    numbers = h[keep].view(np.int64), ids[np.array(group, np.int64)[of[keep]]], at[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in numbers], ["h", "id", "pos"])

    kept = checkpointed(texts.mapInArrow(second, "h bigint, id bigint, pos bigint"))
    several = kept.groupBy("h").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x < y").select("h")
    one, two = salted_pair(kept, several, "h", ["id", "pos"])
    return one.join(two, ["h", "_salt"], "left_semi").select("h", "id", "pos")


def occurrences(texts: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """(h, id, pos, before, after): repeated windows with up to ``length - window`` code points before them, backwards, and
    ``length`` from them on. Only texts that hold one meet their positions, in a join on id."""
    context = length - window
    places = repeated_windows(texts, length, window).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("places"))  # one text's windows

    def cut(batches):
        for b in batches:
            for i, text, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                at = [p["pos"] for p in found]
                for j in range(0, len(at), 4096):
                    part = at[j : j + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([p["h"] for p in found[j : j + 4096]], pa.int64()), pa.array([i] * len(part), pa.int64()), pa.array(part, pa.int64()),
                            pa.array([text[max(0, x - context) : x][::-1] for x in part], pa.string()), pa.array([text[x : x + length] for x in part], pa.string()),
                        ],
                        ["h", "id", "pos", "before", "after"],
                    )

    return texts.select("id", "text").join(places, "id").mapInArrow(cut, "h bigint, id bigint, pos bigint, before string, after string")


def heads(documents: DataFrame, members: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, text): one text for all its copies, written once."""
    firsts = members.where(F.col("doc_id") == F.col("class_id")).select("doc_id")
    return checkpointed(documents.where(F.length("text") >= length).join(firsts, "doc_id").select(F.col("doc_id").alias("id"), "text").distinct())


def links(documents: DataFrame, members: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """(a, b): pairs of different texts that share a span of ``length``. One text stands for all its copies."""
    found = checkpointed(occurrences(heads(documents, members, length), length, window))
    a, b = salted_pair(found, found, "h", ["id", "pos"])
    pairs = a.alias("a").join(b.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a._salt") == F.col("b._salt")) & (F.col("a.id") < F.col("b.id")) & (F.substring("a.after", 1, window) == F.substring("b.after", 1, window)))

    @F.pandas_udf("int")
    def common(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for s, t in zip(x, y):
            n = min(len(s), len(t))
            if s[:n] != t[:n]:
                low = 0
                while n - low > 1:  # the longest common prefix lies in [low, n)
                    mid = (low + n) // 2
                    low, n = (mid, n) if s[:mid] == t[:mid] else (low, mid)
                n = low
            out.append(n)
        return pd.Series(out, dtype="int32")

    reach = pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), (common("a.before", "b.before") + common("a.after", "b.after")).alias("n"))
    return reach.where(F.col("n") >= length).select("a", "b").distinct()


def covering(documents: DataFrame, members: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """(id, s, e): stretches [s, e) of texts that stand in another text, without naming pairs.

    A window whose whole context is the same in several texts covers that context. For all others, and once for each such
    context, every stretch of ``length`` around the window is hashed (128 bits), and the stretches that several texts hold
    are covered: work grows with the distinct contexts, not with the pairs that share them.
    """
    found = occurrences(heads(documents, members, length), length, window)
    found = checkpointed(found.select("h", "id", (F.col("pos") - F.length("before")).alias("s"), F.concat(F.reverse("before"), "after").alias("text"), F.xxhash64("before", "after").alias("c")))
    contexts = found.groupBy("c", "h", "text").agg(F.min("id").alias("x"), F.max("id").alias("y"), F.count(F.lit(1)).alias("k"))
    alike = contexts.where("x < y").select("c", F.col("text").alias("_t"))
    left, right = salted_pair(found, alike, "c", ["id", "s"])
    marked = left.join(right, (left["c"] == right["c"]) & (left["_salt"] == right["_salt"]) & (F.col("text") == F.col("_t")), "left")
    marked = checkpointed(marked.select("id", "s", "text", F.col("_t").isNotNull().alias("whole")))
    spans = marked.where("whole").select("id", "s", (F.col("s") + F.length("text")).alias("e"))
    starts = F.posexplode(F.transform(F.sequence(F.lit(1), F.length("text") - length + 1), lambda i: F.substring("text", i, F.lit(length)))).alias("i", "g")
    digest = [F.xxhash64("g").alias("g1"), F.xxhash64("g", F.lit(1)).alias("g2")]
    single = marked.where(~F.col("whole")).select("id", "s", starts).select("id", (F.col("s") + F.col("i")).alias("s"), *digest).distinct()
    shared = contexts.where("x < y").select("x", "y", starts).select("x", "y", *digest)
    held = single.select(F.col("id").alias("x"), F.col("id").alias("y"), "g1", "g2").unionByName(shared).groupBy("g1", "g2").agg(F.min("x").alias("x"), F.max("y").alias("y")).where("x < y").select("g1", "g2")
    one, two = salted_pair(single, held, "g1", ["id", "s"])
    edges = one.join(two, ["g1", "g2", "_salt"], "left_semi").select("id", "s", (F.col("s") + length).alias("e"))
    return spans.unionByName(edges).distinct()


def shared_pairs(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: pairs of documents that share at least ``LENGTH`` consecutive code points.

    Null, empty and short texts share nothing. Copies are compared once and expanded at the end, into every pair that
    the result must name; repeated rows of a doc_id count once.
    """
    docs = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    members = checkpointed(classes(docs).distinct())
    found = links(docs, members)
    of_a = members.select(F.col("class_id").alias("a"), F.col("doc_id").alias("x"))
    of_b = members.select(F.col("class_id").alias("b"), F.col("doc_id").alias("y"))
    across = found.join(of_a, "a").join(of_b, "b").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
    one, two = salted_pair(members, members.select("class_id", F.col("doc_id").alias("y")), "class_id", ["doc_id"])
    within = one.join(two, ["class_id", "_salt"]).where(F.col("doc_id") < F.col("y")).select(F.col("doc_id").alias("doc_id_a"), F.col("y").alias("doc_id_b"))
    return across.unionByName(within).where("doc_id_a < doc_id_b").distinct()


def shared_parts(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share): how much of each document stands in another one.

    Every code point within a shared span of at least ``LENGTH`` counts once. A document with a copy is shared
    whole; null and empty texts have 0 of 0, share 0.
    """
    docs = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    members = checkpointed(classes(docs).distinct())
    spans = covering(docs, members)
    past = Window.partitionBy("id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max("e").over(past), F.lit(0))
    fresh = F.greatest(F.col("e") - F.greatest(F.col("s"), done), F.lit(0))
    covered = spans.withColumn("n", fresh).groupBy(F.col("id").alias("class_id")).agg(F.sum("n").alias("n"))
    copies = members.groupBy("class_id").agg(F.count_distinct("doc_id").alias("k"))
    left, right = salted_pair(members, copies.join(covered, "class_id", "left"), "class_id", ["doc_id"])
    known = left.join(right, ["class_id", "_salt"]).select("doc_id", "k", "n")
    size = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    out = docs.select("doc_id", size.alias("n_chars")).distinct().join(known, "doc_id", "left")
    shared = F.when(F.col("k") > 1, F.col("n_chars")).otherwise(F.coalesce("n", F.lit(0)))
    return out.select("doc_id", "n_chars", shared.cast("bigint").alias("shared_chars"), F.round(F.coalesce(F.try_divide(shared, F.col("n_chars")), F.lit(0.0)), 6).alias("shared_share"))
