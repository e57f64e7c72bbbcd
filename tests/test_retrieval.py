import math

import pandas as pd

from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom import schema as S
from graphloom.operators import anchors, candidates, evaluation, expand, pack

CAND = "task_id string, symbol_id string, repo_id string, kind string, ref_kind string, provenance string, graph_distance int, degree long, is_leaf boolean, task_signal double, anchor boolean, anchor_strength double, source_strength double, semantic_rank int, churn int, is_test boolean, file_id string, retrieved_at timestamp_ntz"


def cand(i, at, **x):
    row = dict(task_id="t", symbol_id=i, repo_id="r", kind="function", ref_kind=None, provenance=None, graph_distance=1, degree=0, is_leaf=False, task_signal=0.0, anchor=False, anchor_strength=0.0, source_strength=0.5, semantic_rank=None, churn=0, is_test=False, file_id="r:f", retrieved_at=at(1)) | x
    return tuple(row.values())


def test_state_takes_the_last_row_and_drops_nan(spark, at):
    df = spark.createDataFrame([cand("a", at, task_signal=float("nan"), retrieved_at=at(2)), cand("a", at, task_signal=1.0), cand(None, at)], CAND)
    assert [(r["symbol_id"], r["task_signal"]) for r in candidates.candidate_state(df).collect()] == [("a", None)]


def test_score_is_the_weighted_sum(spark, at):
    df = spark.createDataFrame([cand("a", at, ref_kind="define", provenance="scip", degree=20, task_signal=0.4, anchor=True, anchor_strength=0.8, semantic_rank=1, churn=20, graph_distance=0, is_leaf=True, is_test=True)], CAND)
    got = candidates.scored(candidates.candidate_state(df)).first()["score"]
    assert math.isclose(got, round(3 * 1 * 0.9 + 2.5 * 0.4 + 0.6 + 2 * 1 * 0.8 - 0.5 + 0.5 + 3.5 * 0.8 - 2 + 2 + 0.5 + 1, 6), abs_tol=1e-6)


def test_null_features_are_neutral(spark, at):
    row = cand("a", at, kind=None, graph_distance=None, degree=None, is_leaf=None, task_signal=None, anchor=None, anchor_strength=None, source_strength=None, churn=None, is_test=None, file_id=None)
    got = candidates.scored(candidates.candidate_state(spark.createDataFrame([row], CAND))).first()["score"]
    assert math.isclose(got, round(3 * 0.3 + 2 * 0.25 + 0.5 * 0.4 + 2 * 0.5, 6), abs_tol=1e-6)


def test_define_beats_read_and_ties_break_by_id(spark, at):
    df = spark.createDataFrame([cand("b", at, ref_kind="read"), cand("a", at, ref_kind="read"), cand("c", at, ref_kind="define")], CAND)
    got = candidates.ranked(candidates.scored(candidates.candidate_state(df))).orderBy("rank").collect()
    assert [r["symbol_id"] for r in got] == ["c", "a", "b"]


def test_container_sinks_when_its_member_ranks(spark, at):
    df = spark.createDataFrame([cand("py::p::::C#1", at, kind="class", anchor=True, anchor_strength=0.5), cand("py::p::C::m#2", at), cand("py::p::::D#3", at, kind="class", anchor=True, anchor_strength=0.5)], CAND)
    got = {r["symbol_id"]: r["container_penalty"] for r in candidates.demoted(candidates.scored(candidates.candidate_state(df))).collect()}
    assert got == {"py::p::::C#1": 1.5, "py::p::C::m#2": 0.0, "py::p::::D#3": 0.0}


pool = st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["", "o1", "o2"]), st.booleans(), st.one_of(st.none(), st.integers(0, 30))), max_size=40)


def chosen(rows, n, profile):
    frame = pd.DataFrame(rows, columns=["file_id", "owner", "container", "semantic_rank"]).assign(symbol_id=[f"s{i:02d}" for i in range(len(rows))])
    frame["container"] = frame["container"].astype(bool)
    return candidates.diverse_order(frame, n, profile).tolist()


@given(pool, st.integers(0, 12))
@settings(max_examples=60, deadline=None)
def test_a_longer_selection_begins_with_the_shorter(rows, guard):
    rows = [(f"f{f}", o or None, c, r) for f, o, c, r in rows]
    profile = S.Profile(guard_ranks=guard)
    longest = chosen(rows, 30, profile)
    assert len(longest) == len(set(longest)) == min(30, len(rows))
    if not any(c for _, _, c, _ in rows) and len(rows) > 15:
        for n in (1, 3, 7, 15):
            short = chosen(rows, n, profile)
            assert short == longest[:n] or len({f for f, *_ in rows}) < 3  # few files leave slots open, which are filled by score
    named = [(r, i) for i, (_, _, c, r) in enumerate(rows) if r is not None]
    if named and not any(c for _, _, c, r in rows if r is not None):
        assert longest[0] == min(named)[1]


def test_selection_by_hand():
    plain = S.Profile()
    one_file = [("f", None, False, None)] * 9
    assert chosen(one_file, 9, plain) == list(range(9))
    mixed = [("f", None, False, None)] * 3 + [("g", None, False, None)] * 3
    assert chosen(mixed, 6, plain) == [0, 1, 3, 2, 4, 5]  # one file may hold ceil(0.6 * slot) of the first ten slots
    ranked = [("a", None, False, None), ("b", None, False, 1), ("c", None, False, 0), ("d", None, False, None)]
    assert chosen(ranked, 4, plain) == [2, 0, 1, 3]  # the model's best first, then half of the slots
    assert chosen(ranked, 4, S.Profile(guard_ranks=2)) == [2, 1, 0, 3]
    assert chosen([("a", None, True, None)] * 3 + [("b", None, False, None)] * 3, 6, plain) == [0, 3, 4, 5, 1, 2]
    assert chosen([], 4, plain) == []


def test_noisy_or_folds_in_order_with_caps(spark):
    rows = [("t", "a", "lexical", 0.9), ("t", "a", "explicit", 0.5), ("t", "a", "explicit", 0.4), ("t", "b", "semantic", 2.0)]
    got = {r["symbol_id"]: (r["strength"], r["sources"]) for r in anchors.noisy_or(spark.createDataFrame(rows, "task_id string, symbol_id string, source string, strength double")).collect()}
    assert got == {"a": (0.9, ["explicit", "lexical"]), "b": (0.9, ["semantic"])}


SYMS = "symbol_id string, name string, kind string, file_id string, line int, is_test boolean, search_text string, namespace string"


def test_explicit_names(spark):
    syms = spark.createDataFrame(
        [("py::p::::runTask#1", "runTask", "function", "r:a.py", 1, False, "", ""), ("py::p::Job::cancel#2", "cancel", "method", "r:a.py", 2, False, "", "Job"), ("py::p::Task::cancel#3", "cancel", "method", "r:a.py", 3, False, "", "Task"), ("py::q::::runTask#4", "runTask", "class", "r:b.py", 3, False, "", "")], SYMS
    )
    tasks = spark.createDataFrame([("t", "Job.cancel fails when runTask is busy, see https://x.y/cancel"), ("u", None), ("v", "")], "task_id string, text string")
    got = {(r["task_id"], r["symbol_id"]): r["strength"] for r in anchors.explicit(tasks, syms)[0].collect()}
    assert got == {("t", "py::p::Job::cancel#2"): 1.0, ("t", "py::q::::runTask#4"): round(1 / math.sqrt(2), 6), ("t", "py::p::::runTask#1"): round(0.5 / math.sqrt(2), 6)}


def test_hop_decay(spark):
    edges = spark.createDataFrame([("CALLS", "mid", "a", "scip", None, 1), ("CALLS", "top", "mid", "scip", None, 1)], "label string, src_id string, dst_id string, provenance string, ref_kind string, line int")
    syms = spark.createDataFrame([(i, i, "class", f"r:{i}.py", 1, False, "", "") for i in ("a", "mid", "top")], SYMS)
    a = spark.createDataFrame([("t", "a", 0.9)], "task_id string, symbol_id string, strength double")
    got = {r["symbol_id"]: (r["distance"], r["source_strength"]) for r in expand.expanded(a, edges, syms, with_files=False).collect()}
    assert got == {"a": (0, 0.9), "mid": (1, 0.54), "top": (2, 0.324)}


def test_budget_degrades_skips_and_keeps_cheaper_items(spark):
    rows = [("t", 1, "a", "x" * 200, 0, "full"), ("t", 2, "b", "y" * 4000, 1, "full"), ("t", 3, "c", "z" * 40, 1, "full")]
    items = spark.createDataFrame([(t, s, i, b, d, tier, "n" * 60, None, None, None, 1) for t, s, i, b, d, tier in rows], "task_id string, slot int, symbol_id string, body string, graph_distance int, tier string, name string, signature string, docstring string, file_id string, line int")
    got = sorted((r["slot"], r["detail_level"], r["tokens"]) for r in pack.assembled(items, 62).collect())
    assert got == [(1, "full", 50), (3, "full", 10)]


def test_tiers(spark):
    groups = spark.createDataFrame([("t", f"f{i}", i) for i in range(1, 10)], "task_id string, file_id string, pos int")
    p = spark.createDataFrame([("t", "f2", 0.9), ("t", "f3", 0.3), ("t", "f4", 0.1), ("t", "f5", 0.4)], "task_id string, file_id string, relevance double")
    pins = spark.createDataFrame([("t", "f7")], "task_id string, file_id string")
    got = {r["file_id"]: r["tier"] for r in pack.tiered(groups, p, pins).collect()}
    assert got == {"f1": "stub", "f2": "full", "f3": "stub", "f4": "dropped", "f5": "stub", "f6": "dropped", "f7": "full", "f8": "dropped", "f9": "dropped"}


def test_metrics(spark):
    got = evaluation.metrics(spark.createDataFrame([("t", x, i + 1) for i, x in enumerate("xbay")], "task_id string, symbol_id string, rank int"), spark.createDataFrame([("t", x) for x in "abcd"] + [("u", "a")], "task_id string, symbol_id string"), [3])
    rows = {r["task_id"]: r for r in got.collect()}
    assert (rows["t"]["recall"], rows["t"]["precision"], rows["t"]["reciprocal_rank"]) == (0.5, round(2 / 3, 6), 0.5)
    assert (rows["u"]["recall"], rows["u"]["precision"], rows["u"]["hit"]) == (0.0, 0.0, False)


def test_variants_and_replay(spark):
    specs = spark.createDataFrame([(1, "Fix \\_it\\_", "a\u200bb"), (2, "T", None)], "spec_id int, title string, description string")
    assert sorted(map(tuple, evaluation.task_variants(specs).collect())) == [(1, "full", "Fix _it_\n\nab"), (1, "title", "Fix _it_"), (2, "full", "T"), (2, "title", "T")]
    got = evaluation.replayed(spark.createDataFrame([("t", ["x", "b", "a", "x"])], "task_id string, symbol_ids array<string>"), spark.createDataFrame([("t", "a")], "task_id string, symbol_id string"), [2, 3]).collect()
    assert {(r["k"], r["recall"], r["reciprocal_rank"]) for r in got} == {(2, 0.0, 0.0), (3, 1.0, round(1 / 3, 6))}


def test_outline_folds_bodies():
    from graphloom.operators.render import outlined

    assert outlined("a\ndef f():\n  1\n  2\nb", [(2, 4)]) == "a\ndef f():\n… 3-4\nb"
    assert outlined(None, []) == "" and outlined("x", [(1, 1)]) == "x"


def test_phrases_add_to_lexical_evidence(spark):
    from graphloom.operators import search

    rows = [("both", "access_token", "r:a.py"), ("left", "access", "r:b.py"), ("right", "tokens", "r:c.py"), ("far", "tokens_of_access", "r:d.py")]
    s = spark.createDataFrame([(i, n, f, None, None, None, None) for i, n, f in rows], "symbol_id string, name string, file_id string, namespace string, signature string, docstring string, body string")
    index = search.postings(s)
    terms = spark.createDataFrame([(1, t) for t in ("access", "token", "ledger", "winch", "harbor", "signal", "basket", "drawer", "lantern", "cache")], "task_id long, term string")
    phrases = spark.createDataFrame([(1, "access token"), (1, "token ledger")], "task_id long, phrase string")
    found = search.phrase_hits(index, phrases)
    assert {(r["symbol_id"], r["n"]) for r in found.collect()} == {("both", 1), ("far", 1)}
    assert search.phrase_hits(index, phrases, limit=2).count() == 0
    hits = search.term_hits(index, terms.select("term"))
    plain = {r["symbol_id"]: r["strength"] for r in search.lexical_anchors(hits, terms).collect()}
    more = {r["symbol_id"]: r["strength"] for r in search.lexical_anchors(hits, terms, found).collect()}
    assert more["both"] == min(0.8, round(plain["both"] + 0.3, 6)) > plain["both"] and more["left"] == plain["left"]
    alone = search.lexical_anchors(hits.where("symbol_id <> 'far'"), terms, found)
    assert {r["symbol_id"]: r["strength"] for r in alone.collect()}["far"] == 0.3


def test_deep_paths_are_found_by_long_suffixes(spark):
    from graphloom.operators import search

    path = "/".join(f"p{i}" for i in range(15)) + "/a.py"
    files = spark.createDataFrame([("r:" + path,)], "file_id string")
    suffixes = spark.createDataFrame([(path,), (path[3:],), ("x/a.py",)], "suffix string")
    assert {r["suffix"] for r in search.files_by_suffix(files, suffixes).collect()} == {path, path[3:]}
    assert [r["suffix"] for r in search.missing_paths(files, suffixes).collect()] == ["x/a.py"]
