import random

from graphloom.llm import handwritten as H

FILE = "file_id string, repo_id string, path string, language string, source binary, scanned_at timestamp_ntz, kind string"
UP = "upstream_id long, lib_name string, path string, source binary"
WORDS = "basket ledger winch harbor signal route cache token drawer lantern".split()


def code(rng):
    return "\n".join(f"def {rng.choice(WORDS)}_{rng.choice(WORDS)}_{i}(x):\n    '''Reads the {rng.choice(WORDS)} before it is gone.'''\n    if x is None:\n        return {rng.randint(0, 99)}\n    return load_{rng.choice(WORDS)}(x)\n" for i in range(8))


def test_labels_of_giveaways():
    rng = random.Random(1)
    plain = code(rng)
    assert H.weak_label("src/a.py", plain, 0.0) is None
    assert H.weak_label("src/a.py", "# Code generated by tool. DO NOT EDIT.\n" + plain, 0.0) == "generated"
    assert H.weak_label("src/a.py", plain + "\n# checks that @generated files are left alone\n", 0.0) is None
    assert H.weak_label("src/vendor_portal/a.py", plain, 0.0) is None
    assert H.weak_label("node_modules/x/a.js", plain, 0.0) == "vendored"
    assert H.weak_label("src/a.py", plain, 0.9) == "vendored"
    assert H.is_data("X = [\n" + "    1, 22, 333, 4444, 5,\n" * 40 + "]\n") and not H.is_data(plain)
    assert H.is_data("id,at,note\n" + "".join(f"{i},2024-01-{i % 28 + 1:02d} 10:00,some words here\n" for i in range(40)))
    assert H.is_minified("!function(a,b){" + "var c=a.x;b[c]=function(d){return d>>3&1};" * 30 + "}(c,r);", "javascript")


def test_masking_leaves_headers_out_of_the_features():
    rng = random.Random(2)
    plain = code(rng)
    a, b = H.features("src/a.py", plain), H.features("src/a.py", "# Code generated by tool. DO NOT EDIT.\n" + plain, masked=True)
    assert (a[0] == b[0]).all() and abs(a[1] - b[1]).max() < 1e-9
    assert len(H.features("src/a.py", "# Code generated by tool. DO NOT EDIT.\n" + plain)[0]) > len(a[0])
    assert H.features("", "")[0].size == 0


def test_threshold_errs_least():
    import numpy as np

    assert H.threshold(np.array([0.4, 0.3, -0.6, -0.7]), np.array([1, 1, -1, -1]), 0.5) == 0.0
    assert H.threshold(np.array([0.4, -0.22, -0.31, -0.7]), np.array([1, 1, -1, -1]), 0.5) == -0.25
    assert H.threshold(np.array([0.4]), np.array([1]), 0.5) == 0.0


def test_machine_separates_held_out_rows():
    rng = random.Random(3)
    rows = []
    for i in range(160):
        y = 1 if i % 2 else -1
        text = code(rng) if y < 0 else "".join(f"const K{rng.randint(0, 9)}{j} = {rng.randint(0, 9999)};\n" for j in range(40))
        rows.append((*H.features(f"src/{rng.choice(WORDS)}.py", text), y))
    m = H.train(rows[:100])
    assert sum((m.score(k, v) > 0) == (y > 0) for k, v, y in rows[100:]) / 60 > 0.95


def table(spark, at):
    rng = random.Random(4)
    lib = code(rng)
    rows = [(f"r{i % 12}:src/{i}.py", f"r{i % 12}", f"src/{i}.py", "python", code(rng).encode(), at(1), None) for i in range(60)]
    rows += [(f"r{i % 12}:gen/{i}.py", f"r{i % 12}", f"gen/{i}.py", "python", ("# @generated by x\n" * (i % 2) + "".join(f"K_{j} = field(name='{rng.choice(WORDS)}', number={j})\n" for j in range(60))).encode(), at(1), None) for i in range(40)]
    rows += [("r1:util/copy.py", "r1", "util/copy.py", "python", (lib + "\nextra = 1\n").encode(), at(1), None), ("r1:e.py", "r1", "e.py", None, None, None, None), (None, None, None, None, b"x", at(1), None)]
    return spark.createDataFrame(rows + rows[:3], FILE), spark.createDataFrame([(1, "lib", "lib.py", lib.encode())], UP)


def test_files_are_told_apart(spark, at):
    files, up = table(spark, at)
    out, fit = H.judged(files, up)
    got = {r["file_id"]: r["kind"] for r in out.collect()}
    assert len(got) == 102 and got["r1:util/copy.py"] == "vendored" and got["r1:e.py"] is None
    assert all(got[k] is None for k in got if ":src/" in k)
    assert sum(got[k] is not None for k in got if ":gen/" in k) >= 20
    assert fit.n_train > 0 and -0.5 <= fit.threshold <= 0.5


def test_the_machine_decides_outside_its_margin(spark, at):
    """Above the threshold its score alone finds a file; below, only inside the margin, an exact check confirms."""
    files, up = table(spark, at)
    out, fit = H.judged(files, up)
    rows = out.collect()
    for r in rows:
        assert (r["evidence"] == "machine") == (r["score"] > fit.threshold)
        assert r["evidence"] in (None, "machine") or -H.MARGIN < r["score"] <= fit.threshold
        assert (r["kind"] is None) == (r["evidence"] is None)


def test_a_giveaway_beyond_the_margin_finds_nothing(spark, at, monkeypatch):
    files, up = table(spark, at)
    nothing = H.Fitted(H.Machine(H.np.zeros(H.DIMENSIONS), -2.0), {}, 0.0, 0)
    monkeypatch.setattr(H, "fitted", lambda *a: nothing)
    assert all(r["kind"] is None for r in H.judged(files, up)[0].collect())
    monkeypatch.setattr(H, "fitted", lambda *a: H.Fitted(H.Machine(H.np.zeros(H.DIMENSIONS), -0.5), {}, 0.0, 0))
    got = {r["file_id"]: (r["kind"], r["evidence"]) for r in H.judged(files, up)[0].collect()}
    assert got["r1:util/copy.py"] == ("vendored", "copy")
    assert {k for k, v in got.items() if v[1] == "header"} == {f"r{i % 12}:gen/{i}.py" for i in range(1, 40, 2)}


def test_validation_covers_all_files_of_held_out_repositories(spark, at, monkeypatch):
    monkeypatch.setattr(H, "TRAINING_FILES", 40)
    files, up = table(spark, at)
    out, fit = H.judged(files, up)
    labels = {r["file_id"]: r["label"] for r in H.labelled(H._cleaned(files), H.released_lines(up)).collect()}
    rows = [r for r in out.collect() if H.held_out(r["repo_id"])]
    tp, fp, fn = (sum(f(r["score"] > fit.threshold, labels[r["file_id"]] is not None) for r in rows) for f in (lambda a, b: a and b, lambda a, b: a and not b, lambda a, b: b and not a))
    got = {r["figure"]: r["value"] for r in H.validated(files, up).collect()}
    assert got["n_validation"] == len(rows) > 0 and got["accuracy"] == (len(rows) - fp - fn) / len(rows)
    assert got["precision"] == tp / max(1, tp + fp) and got["recall"] == tp / max(1, tp + fn)


def test_copies_equal_brute_force_where_one_line_is_everywhere(spark, at):
    rng = random.Random(5)
    libs = {i: code(rng) + "\nshared_line_of_all(1)\n" for i in range(4)}
    up = spark.createDataFrame([(i, "lib", "x.py", t.encode()) for i, t in libs.items()], UP)
    texts = {f"f{i}": (libs[i % 4] if i % 3 == 0 else code(rng)) + "\nshared_line_of_all(1)\n" for i in range(60)}
    rows = spark.createDataFrame([(k, sorted(H.line_hashes(t))) for k, t in texts.items()], "file_id string, lines array<bigint>")
    got = {r["file_id"]: r["copied"] for r in H.copied_shares(rows, H.released_lines(up)).collect()}
    usual = {h for h in set().union(*map(H.line_hashes, libs.values())) if 2 * sum(h in H.line_hashes(t) for t in libs.values()) > 4}
    for k, t in texts.items():
        own = H.line_hashes(t)
        want = max(len(own & (H.line_hashes(l) - usual)) for l in libs.values()) / len(own)
        assert abs(got.get(k, 0.0) - want) < 1e-9


def test_empty_tables(spark):
    out, fit = H.judged(spark.createDataFrame([], FILE), spark.createDataFrame([], UP))
    assert out.count() == 0 and fit.n_train == 0


def test_all_files_train_whatever_the_blocks(spark, at, monkeypatch):
    """Every file outside held-out repositories and every release trains; blocks and the order of sums change no bit."""
    files, up = table(spark, at)
    rows, released = H._cleaned(files), H.released_lines(up)
    first = H.fitted(rows, up, released)
    monkeypatch.setattr(H, "TRAINING_FILES", 16)
    monkeypatch.setattr(H, "PACKED_FILES", 7)
    second = H.fitted(rows, up, released)
    own = {r["file_id"]: r["repo_id"] for r in rows.collect()}
    assert first.n_train == second.n_train == 1 + sum(not H.held_out(x) for x in own.values())
    assert (first.machine.weights == second.machine.weights).all() and first.machine.bias == second.machine.bias and first.threshold == second.threshold
    table_ = H.training_table(rows, up, released)
    assert sum(r["n"] for r in table_.where("unseen").collect()) == sum(H.held_out(x) for x in own.values())


def test_the_fit_is_the_minimum():
    """No slope is left beyond the tolerance, and steps to any side raise the value."""
    import numpy as np

    rng = random.Random(6)
    rows = [(*H.features("a.py", code(rng) if i % 3 else f"K = {i}\n" * 30), 1 if i % 3 == 0 else -1) for i in range(60)]
    m = H.train(rows)
    costs, own = np.array([H.cost_of(20, 40)]), [(np.array([y]), H.packed([(k, v)])) for k, v, y in rows]

    def value(w):
        return H.slopes(own, w[None], costs, {0})[0, -1] / H.PARTS + w @ w / 120

    best = np.append(m.weights, m.bias)
    assert value(best) < 0.1 * value(np.zeros(H.DIMENSIONS + 1))
    for scale in (0.5, 0.8, 1.25, 2.0):
        assert value(best) < value(scale * best)
