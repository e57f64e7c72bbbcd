import random

import numpy as np

from graphloom.llm import spans as S

DOC = "doc_id long, text string, lang string, h string, pos long"


def brute(rows, length=S.LENGTH):
    where = {}
    for i, t in dict(rows).items():
        for k in range(len(t or "") - length + 1):
            where.setdefault(t[k : k + length], set()).add(i)
    pairs = {(a, b) for s in where.values() for a in s for b in s if a < b}
    shared = {}
    for i, t in dict(rows).items():
        m = bytearray(len(t or ""))
        for k in range(len(m) - length + 1):
            if len(where[t[k : k + length]]) > 1:
                m[k : k + length] = b"\1" * length
        shared[i] = sum(m)
    return pairs, shared


def text(rng, n):
    return "".join(rng.choice("abcdefg é日\n") for _ in range(n))


def table():
    rng = random.Random(5)
    base = text(rng, 900)
    rows = [(1, base), (2, base), (3, text(rng, 300) + base[100:260] + text(rng, 50)), (4, base[100:259] + text(rng, 300)), (5, base[400:560]), (6, "x" * 400), (7, "x" * 170), (8, "x" * 159), (9, None), (10, ""), (11, text(rng, 5000) + base[740:] + text(rng, 90)), (12, base[740:900])]
    block = text(rng, 200)
    return rows + [(20 + i, text(rng, rng.randint(0, 300)) + block + text(rng, rng.randint(0, 300))) for i in range(12)] + [(40, block[:60] + "!" + block[61:]), (41, "abc" * 100), (42, "bca" * 100)]


def test_pairs_and_parts_match_brute_force(spark):
    rows = table()
    df = spark.createDataFrame([(i, t, "en", "h", 1) for i, t in rows + rows[:4]], DOC).repartition(4)
    pairs, shared = brute(rows)
    assert {tuple(r) for r in S.shared_pairs(df).collect()} == pairs
    got = {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in S.shared_parts(df).collect()}
    assert got == {i: (len(t or ""), shared[i]) for i, t in rows}


def test_picked_windows_meet_in_every_shared_span():
    rng = random.Random(6)
    for _ in range(30):
        span = text(rng, S.LENGTH)
        a, b = text(rng, rng.randint(0, 200)) + span + text(rng, 40), text(rng, rng.randint(0, 200)) + span + text(rng, 70)
        pa, ha = S.picked(a)
        pb, hb = S.picked(b)
        in_a = {(p - a.index(span), h) for p, h in zip(pa.tolist(), ha.tolist()) if 0 <= p - a.index(span) <= S.LENGTH - S.WINDOW}
        in_b = {(p - b.index(span), h) for p, h in zip(pb.tolist(), hb.tolist()) if 0 <= p - b.index(span) <= S.LENGTH - S.WINDOW}
        assert in_a & in_b


def test_hashes_depend_on_content_only():
    a, b = S.window_hashes("xyz" + "q" * 5 + "hello world", 11), S.window_hashes("hello world", 11)
    assert a[-1] == b[0] and len(np.unique(S.window_hashes("ab" * 50, 10))) == 2 and S.window_hashes("ab", 3).size == 0


def test_sketch_overestimates_only(spark):
    rng = random.Random(7)
    texts = [text(rng, 400) for _ in range(40)]
    texts += texts[:5]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(6)
    width = 1 << 12
    bits = [np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little") for x in S.repeated_bitmap(df, width, S.LENGTH, S.WINDOW)]
    for t in texts[:5]:
        h = S.picked(t)[1]
        assert all(bits[r][S._buckets(h, r, width)].all() for r in range(S.DEPTH))


def test_a_third_of_all_rows_are_copies(spark):
    rng = random.Random(8)
    base = text(rng, 400)
    rows = [(i, base if i % 3 == 0 else text(rng, 300)) for i in range(90)]
    got = {tuple(r) for r in S.shared_pairs(spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOC)).collect()}
    same = list(range(0, 90, 3))
    assert got == {(a, b) for a in same for b in same if a < b}


def test_empty_table(spark):
    df = spark.createDataFrame([], DOC)
    assert S.shared_pairs(df).count() == 0 and S.shared_parts(df).count() == 0


def test_a_saturated_sketch_loses_nothing(spark, monkeypatch):
    """With 64 counters a row nearly every window passes; rows of numbers pass, and the results stay the same."""
    monkeypatch.setattr(S, "SEGMENT", 64)
    monkeypatch.setattr(S, "WIDEST", 64)
    rows = table()
    df = spark.createDataFrame([(i, t, "en", "h", 1) for i, t in rows], DOC).repartition(3)
    pairs, shared = brute(rows)
    assert {tuple(r) for r in S.shared_pairs(df).collect()} == pairs
    assert {r["doc_id"]: r["shared_chars"] for r in S.shared_parts(df).collect()} == shared


def test_boilerplate_in_many_texts_is_covered_without_pairs(spark):
    rng = random.Random(9)
    header = text(rng, 420)
    rows = [(i, text(rng, 30 + i % 7) + header + text(rng, 250)) for i in range(60)]
    got = {r["doc_id"]: r["shared_chars"] for r in S.shared_parts(spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOC)).collect()}
    assert got == brute(rows)[1]
