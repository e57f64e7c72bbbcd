import json

from graphloom.llm import code_docs as D

GOOD = "Collects every row that is still held and hands it back."


def own(language="python", name="run_all", docstring=None, body=None, search_text=None, signature="def run_all(x)"):
    return D.own_documentation(language, name, signature, docstring, body, search_text)[1]


def test_places_of_documentation():
    assert own(docstring=GOOD) >= 5
    assert own(body=f'    """{GOOD}"""\n    return 1') >= 5
    assert own(body=f"    r'''{GOOD}'''\n    return 1") >= 5
    assert own(search_text=f"# {GOOD}\ndef run_all(x):\n    return 1") >= 5
    assert own(search_text=f'def run_all(x):\n    """{GOOD}"""\n    return 1') >= 5
    assert own("java", "runAll", search_text=f"/**\n * {GOOD}\n */\nint runAll() {{\n}}", signature="int runAll()") >= 5
    assert own("csharp", "RunAll", search_text=f"/// <summary>{GOOD}</summary>\nint RunAll() {{\n}}", signature="int RunAll()") >= 5


def test_what_does_not_count():
    for text in ("", "   ", "TODO: write down what this function really does here", "noqa: D103 and some more words after it", ":param x: the thing to use for it\n:return: the other thing", "@param x the thing to use for it\n@return", "run_all function.", "Run all", "---------", "Auto-generated method stub", "No description.", "Description goes here.", "N/A", "eslint-disable-next-line no-unused-vars and friends"):
        assert own(docstring=text) < 5, text
    assert own(body=f'    def inner(x):\n        """{GOOD}"""\n    return 1') == 0
    assert own(body=f"    x = 1\n    # {GOOD}\n    return x") == 0
    assert own(search_text=f"# {GOOD}\n\ndef run_all(x):\n    return 1") == 0
    code = "\n".join("// " + x for x in ("for (const item of x) {", "    load(item);", "}", 'let key = "many words that are only text";', "return key;"))
    assert own("javascript", "run", search_text=f"{code}\nfunction run() {{}}", signature="function run()") == 0
    assert own("java", "run", body=f'"""{GOOD}"""', signature="int run()") == 0


def test_the_name_does_not_count():
    assert D.words_besides("Run all the rows", "run_all") == 2
    assert D.words_besides("run_all() runs run all rows", "run_all") == 2
    assert D.words_besides("Liest alle Zeilen, überspringt ğüş", "x") == 5


NODE = "label string, node_id string, op string, properties string, search_text string, repo_id string, file_id string, indexed_at_commit string, changed_at timestamp_ntz, words int"


def node(i, at, kind="function", op="upsert", text="def f(x):\n    return 1", **p):
    props = None if op == "delete" else json.dumps({"name": i.split("::")[-1].split("#")[0], "kind": kind, "package": i.split("::")[1], "namespace": i.split("::")[2], "signature": "def f(x)", **p})
    return ("Symbol", i, op, props, text, "r", "r:f", "c", at, 0)


def test_latest_state_repeats_and_kinds(spark, at):
    rows = [
        node("python::p::::f#1", at(1), docstring=GOOD), node("python::p::::f#1", at(2), docstring=None), node("python::p::::g#2", at(1)), node("python::p::::g#2", at(2), docstring=GOOD), node("python::p::::g#2", at(2), docstring=GOOD),
        node("python::p::::h#3", at(1), docstring=GOOD), node("python::p::::h#3", at(2), op="delete", text=None), node("python::p::::C#4", at(1), kind="class", docstring=GOOD), node("python::p::::k#5", at(1), docstring=GOOD, signature=None, body=None, text=None),
    ]
    got = D.pairs(spark.createDataFrame(rows, NODE)).collect()
    assert sorted(r["node_id"] for r in got) == ["python::p::::g#2", "python::p::::k#5"]
    assert D.pairs(spark.createDataFrame([], NODE)).count() == 0


def test_declaration_documents_its_definition_by_overload(spark, at):
    sig = {"one": "int f(int x)", "two": "int f(const std::string& s)"}
    rows = [
        node("cpp::p::C::f#1", at(1), signature=sig["one"], text=f"/// {GOOD}\nint f(int x);"),
        node("cpp::p::C::f#2", at(1), signature="int f(int count)", text="int f(int count) { return 1; }"),
        node("cpp::p::C::f#3", at(1), signature=sig["two"], text="int f(const std::string& s) { return 2; }"),
    ]
    got = {r["node_id"]: r["documented_at"] for r in D.pairs(spark.createDataFrame(rows, NODE)).collect()}
    assert got == {"cpp::p::C::f#1": "cpp::p::C::f#1", "cpp::p::C::f#2": "cpp::p::C::f#1"}


def test_odd_rows(spark, at):
    rows = [
        ("Symbol", "x", "upsert", "{bad json", None, "r", None, None, at(1), 0), ("Symbol", "y", "upsert", json.dumps({"kind": "function", "docstring": GOOD}), None, None, None, None, at(1), 0),
        (None, None, None, None, None, None, None, None, None, None), ("Symbol", "z", None, json.dumps({"kind": "function", "docstring": GOOD}), "", "r", "f", "c", None, 1),
    ]
    got = D.pairs(spark.createDataFrame(rows, NODE)).collect()
    assert [(r["node_id"], r["code"]) for r in got] == [("y", None)]


def test_long_texts_are_read_whole():
    assert own(docstring="x = 1;\n" * 3 + "\n".join(f"Sentence number {i} of a very long text." for i in range(5000))) > 20_000
