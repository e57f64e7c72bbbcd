import random

from graphloom.llm import rank_fusion as R

SCHEMA = "task_id string, symbol_id string, degree long, task_signal double, graph_distance int, anchor_strength double, retrieved_at timestamp_ntz, points double"
NAMES = list(R.SCORES)


def table(at, seed=1, tasks=(("hot", 300), ("a", 7), ("b", 1))):
    rng = random.Random(seed)

    def maybe(x):
        return None if rng.random() < 0.15 else x

    rows = []
    for t, n in tasks:
        for i in range(n):
            rows.append((t, f"s{i:04d}", maybe(rng.choice([1, 5, 100_000])), maybe(rng.choice([float("nan"), -9.5, 0.0, -0.0, rng.random()])), maybe(rng.randint(0, 4)), maybe(round(rng.random(), 1)), at(1), 0.0))
    return rows + [r[:6] + (at(2),) + r[7:] for r in rows[::5]] + [(None, "x", 1, 1.0, 1, 1.0, at(1), 0.0), ("a", None, 1, 1.0, 1, 1.0, at(1), 0.0)]


def brute(rows, weights=None):
    last = {}
    for r in sorted(rows, key=lambda r: r[6]):
        if r[0] and r[1]:
            last[r[:2]] = [None if x is None or x != x else (float(x) if R.SCORES[n] else -float(x)) for n, x in zip(NAMES, r[2:6])]
    points, better = {}, {}
    for (t, s), values in last.items():
        others = [v for (u, _), v in last.items() if u == t]
        total, counts = 0.0, []
        for k, n in enumerate(NAMES):
            present = [v[k] for v in others if v[k] is not None]
            m = len(present)
            if values[k] is None:
                p, c = max((m - 1) / 2, 0), None
            else:
                c = sum(x > values[k] for x in present)
                p = m - (c + (present.count(values[k]) + 1) / 2)
            total += (weights or {}).get(n, 1.0) * p
            counts.append(c)
        points[t, s], better[t, s] = round(total, 6), counts
    return points, better


def test_ranking_matches_brute_force(spark, at):
    rows = table(at)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for weights in (None, {"degree": 2.0, "task_signal": 0.0}):
        points, _ = brute(rows, weights)
        got = R.borda(df, weights).collect()
        assert {(r["task_id"], r["symbol_id"]): r["points"] for r in got} == points
        for t in ("hot", "a", "b"):
            order = sorted((k for k in points if k[0] == t), key=lambda k: (-points[k], k[1]))
            assert {(r["task_id"], r["symbol_id"]): r["rank"] for r in got if r["task_id"] == t} == {k: i + 1 for i, k in enumerate(order)}


def test_leaders_match_brute_force(spark, at):
    rows = table(at, 2, (("a", 40), ("b", 9), ("c", 3)))
    _, better = brute(rows)
    got = {(r["task_id"], r["symbol_id"]) for r in R.leaders(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k for k, c in better.items() if all(x is not None and x < 5 for x in c)}


def test_range_of_a_score_does_not_matter(spark, at):
    rows = table(at, 3, (("a", 20),))
    scaled = [(r[0], r[1], r[2], None if r[3] is None else r[3] * 1e6 + 5, r[4], None if r[5] is None else r[5] / 1000, r[6], r[7]) for r in rows]
    a = {(r["symbol_id"], r["rank"]) for r in R.borda(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert a == {(r["symbol_id"], r["rank"]) for r in R.borda(spark.createDataFrame(scaled, SCHEMA)).collect()}


def test_empty_and_all_missing(spark, at):
    assert R.borda(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("t", s, None, float("nan"), None, None, at(1), 1.0) for s in ("b", "a")]
    assert [(r["symbol_id"], r["points"], r["rank"]) for r in R.borda(spark.createDataFrame(rows, SCHEMA)).orderBy("rank").collect()] == [("a", 0.0, 1), ("b", 0.0, 2)]
    assert R.leaders(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_a_hot_task_and_a_hot_value_are_cut(spark, at):
    """A third of the rows in one task, most of them with one value: no task of the join's shuffle holds them all."""
    rows = [("hot" if i % 3 == 0 else f"t{i % 97}", f"s{i:05d}", 1, 0.5 if i % 2 else None, i % 7, 0.1 * (i % 10), at(1), 0.0) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    points, better = brute([r for r in rows if r[0] == "hot"])
    got = {(r["task_id"], r["symbol_id"]): (r["points"], r["leads"]) for r in R.borda(df).where("task_id = 'hot'").collect()}
    assert {k: v[0] for k, v in got.items()} == points
    assert {k: v[1] for k, v in got.items()} == {k: sum(x is not None and x < 5 for x in c) for k, c in better.items()}
    long = R.score_ranks(R.candidates(df))
    left, _ = R.salted_pair(long.withColumn("_k", R.F.xxhash64("task_id", "score", "value")), long.withColumn("_k", R.F.lit(0).cast("bigint")).limit(1), "_k", ["symbol_id"])
    assert left.where("task_id = 'hot' AND score = 'degree'").select("_salt").distinct().count() > 4
