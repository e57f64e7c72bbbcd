from collections import Counter

import numpy as np

from graphloom.llm import mixture as M

DOC = "doc_id long, text string, source string, copy int"


def docs(spark):
    rows = [(i, "some words of a text " * (1 + i % 5), "Issue " if i % 2 else "issue", 9) for i in range(600)] + [(1000 + i, "a little text of some words", "read-me", 9) for i in range(20)] + [(2000, None, "issue", 1), (2001, "", "issue", 1), (2002, "text", None, 1), (2003, "text", "other", 1)]
    return spark.createDataFrame(rows, DOC).repartition(5)


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_caps_and_determinism(spark):
    t = targets(spark, [("issue", 0.9, 1), ("read_me", 0.1, 3), ("wiki", 0.0, 4)])
    rows = M.mixture(docs(spark), t, shards=8).collect()
    total, by = sum(r["n_tokens"] for r in rows), Counter()
    for r in rows:
        by[r["source"]] += r["n_tokens"]
    longest = max(r["n_tokens"] for r in rows)
    assert abs(by["issue"] - 0.9 * total) <= 2 * longest and abs(by["read_me"] - 0.1 * total) <= 2 * longest
    copies = Counter((r["doc_id"]) for r in rows)
    assert max(n for d, n in copies.items() if d < 1000) == 1 and max(n for d, n in copies.items() if d >= 1000) <= 3
    assert not {2000, 2001, 2002, 2003} & set(copies)
    for s in range(8):
        assert sorted(r["position"] for r in rows if r["shard"] == s) == list(range(1, 1 + sum(r["shard"] == s for r in rows)))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.mixture(docs(spark).repartition(2), t, shards=8).collect()))


def test_shards_have_like_shares(spark):
    t = targets(spark, [("issue", 0.5, 1), ("read_me", 0.5, 200)])
    rows = M.mixture(docs(spark), t, shards=4).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["n_tokens"]
    assert max(sizes.values()) < 1.4 * min(sizes.values())


def test_report(spark):
    got = {r["source"]: r for r in M.shares(docs(spark), targets(spark, [("issue", 0.9, 1), ("read_me", 0.1, 3), ("wiki", 0.0, 4)])).collect()}
    assert abs(got["issue"]["actual_share"] - 0.9) < 0.01 and got["wiki"]["taken_tokens"] == 0 and got["read_me"]["most_copies"] <= 3


def test_sources_without_text_and_empty_tables(spark):
    t = targets(spark, [("issue", 0.5, 1), ("nothing", 0.5, 1)])
    assert {r["source"] for r in M.mixture(docs(spark), t, shards=2).collect()} == {"issue"}
    assert M.mixture(docs(spark).limit(0), t, shards=2).count() == 0
    assert M.shares(docs(spark).limit(0), t).count() == 2


def test_tree_is_exact():
    rng = np.random.default_rng(1)
    for shards in (1, 3, 8):
        q = np.array([100, 7, 0, 53])
        out = M.split_quotas(q, shards, rng)
        assert (out.sum(axis=0) == q).all() and (out >= 0).all() and out.sum(axis=1).max() - out.sum(axis=1).min() <= shards


def test_plan_uses_the_tightest_source():
    assert M.plan({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.5, 4)}) == {"a": (0, 40), "b": (4, 0)}
    assert M.plan({}, {"a": (1.0, 1)}) == {}
