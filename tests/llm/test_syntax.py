import itertools
import random
import tracemalloc

import numpy as np
import pytest

from graphloom.llm import least_cost as by_spans
from graphloom.llm.chart import BRACKETS, END, Grammar, SharedChart, greedy, repair
from graphloom.llm.least_cost import least_cost
from graphloom.llm.languages import SUFFIXES, grammar, shared_chart, tokenize
from graphloom.llm.syntax import invalid_files, judge, rates

VALID = {
    "a.py": "import os\n\n@dec\nasync def f(a, *b, c: int = 1, **d) -> int:\n    '''x'''\n    if (y := a) and not b:\n        return [i for i in b if i]\n    else:\n        x, *z = d\n    try:\n        await g(*b, **d)\n    except (A, B) as e:\n        raise X from e\n    finally:\n        pass\n    with a as p, b as q: print(f'{x}')\n    return lambda v, w=1: {1: 2, **d}[::2]\n\nmatch = 3\n",
    "a.js": "import a, { b as c } from './x';\nexport default class A extends B {\n  static x = 1;\n  get y() { return this.#z?.[0] ?? `t${a}` }\n}\nconst f = async ({ a, b = 1 }, ...c) => { for (const [k, v] of c) if (!k) continue\n  return a ? b : /[/]x/g.test(v) }\nlabel: while (i-- > 0) { try { g() } catch { break label } }\n!function(c,r){var z=c.b;return z?z:{y:z}}(c,r)\n",
    "a.ts": "import type { A } from './a';\nexport interface B<T extends A = A> extends C { readonly x?: T[]; [k: string]: unknown; f(a: number): void }\ntype U = 'a' | { [K in keyof B]: B[K] };\nenum E { A = 1, B }\nexport abstract class D<T> implements C { private constructor(public readonly a: string, b?: number) { super(); }\n  abstract m(): Promise<Map<string, T>>;\n}\nlet z = (x as any)!.y<string>(1);\nfunction g(this: D<any>, a: unknown): a is string { return a! }\n",
    "A.java": "package a.b;\nimport static java.util.List.*;\n@X(value = 1) public final class A<T extends B & C> extends D<T> implements E {\n  private static final int[] Y = {1, 2};\n  A(int... xs) throws Ex { this.x = xs; }\n  <R> R f(Map<String, List<R>> m) { for (var e : m.entrySet()) { switch (e) { case 1: break; default: } }\n    try (var r = open()) { return (R) m.get(\"a\").stream().map(x -> x + 1).map(A::g).toList(); } catch (IOException | Err e) { throw new Err(e); } finally { } }\n  enum K { P, Q(1) { void z() {} }; int v; }\n  record R2(int a) { }\n  char c = '{';\n}\n",
    "a.go": "package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype S struct {\n\tA int `json:\"a\"`\n\t*B\n}\n\nfunc (s *S) F(a, b int, c ...string) (n int, err error) {\n\tfor i, v := range c {\n\t\tif x, ok := m[v]; ok && i > 0 {\n\t\t\tdefer func() { recover() }()\n\t\t}\n\t}\n\tswitch t := q.(type) {\n\tcase int, string:\n\t\tch <- t\n\t}\n\treturn len([]int{1, 2}), &S{A: 1}\n}\n",
    "a.rs": "use std::{fmt, io::{self, Read}};\n#[derive(Debug)]\npub struct S<'a, T: Clone> where T: Copy { pub a: &'a [T], b: Option<Box<dyn Fn(i32) -> i32>> }\nimpl<'a, T> S<'a, T> {\n    pub fn f(&mut self, x: &str) -> Result<(), E> {\n        let v = vec![1, g(2)];\n        let r = match v.len() { 0 | 1 => { 1 }, n if n > 3 => n, _ => h(|a, b| a + b)?, };\n        if let Some(q) = x.chars().next() { return Err(E::X { a: 1 }); }\n        for i in 0..10 { v[i] = 'c' as u8; }\n        Ok(())\n    }\n}\nmacro_rules! m { ($x:expr) => { $x + 1 } }\n",
    "A.cs": "using System;\nnamespace A.B;\n[X(1)] public sealed partial class C<T> : D, IE where T : class, new() {\n  private readonly int[] _x = new[] { 1, 2 };\n  public string P { get; private set; } = \"a\";\n  public async Task<int> F(ref int a, params string[] b) { foreach (var i in b) { if (i is null) { continue; } }\n    var s = @\"a\\\"; var t = $\"{a}\"; using var z = Open(); return await G(x => x?.Y ?? 1); }\n  public static C<T> operator +(C<T> a, C<T> b) => a;\n}\n",
    "a.cpp": "#include <x>\nnamespace n { template <typename T, int N = 3> class A : public B<T> {\npublic:\n  explicit A(int x) : x_(x), y_{1} {}\n  virtual ~A() = default;\n  const std::string& f(const std::vector<int>& v) const override { for (const auto& i : v) { g(i); } auto l = [&](int a) -> int { return a ? *p : -1; }; return static_cast<T>(v)[0]; }\nprivate:\n  std::map<int, std::vector<int>> m_;\n  static const char c = '(';\n};\nstd::ostream& operator<<(std::ostream& o, const A<int>& a) { return o << a.x_; }\n}\nint main(int argc, char** argv) { unsigned long n = 0; if (n > 1 && argv[0] != nullptr) return 1; delete[] argv; }\n",
}


@pytest.mark.parametrize("path", VALID)
def test_valid_files_cost_nothing(path):
    assert judge(path, VALID[path].encode()) == (judge(path, b"")[0], 0, True, None, None)
    assert judge(path, ("\ufeff" + VALID[path].replace("\n", "\r\n")).encode())[1] == 0


@pytest.mark.parametrize("path", VALID)
def test_broken_files_are_flagged(path):
    text = VALID[path]
    lines = text.split("\n")
    at = len(lines) * 2 // 3
    conflict = "\n".join([*lines[:at], "<<<<<<< HEAD", "=======", ">>>>>>> other", *lines[at:]])
    assert judge(path, conflict.encode())[3] == "conflict"
    for other, code in VALID.items():
        if other != path and not {other, path} <= {"a.js", "a.ts"}:
            assert judge(path, code.encode())[1] > 0, other
    assert judge(path, b"id,opened at,note\n1,2024-03-02 03:30,\"some words\n")[1] > 0
    assert judge(path, b"Dear all, this is only a text of some words.\nIt goes on.\n")[1] > 0
    assert judge(path, b"<!doctype html>\n<html><body>x</body></html>\n")[1] > 0


def test_truncation_and_old_dialects():
    assert judge("x.go", b"package a\n\nfunc F() int {\n\tif x == nil {\n\t\treturn")[1] in (2, 3)
    assert judge("x.go", b"package a\n\nfunc F() int {\n\tif x == nil {\n\t\treturn")[3] == "truncation"
    assert judge("x.java", b"class A {\n    int f() {\n        g(1);\n")[1:4] == (2, True, "truncation")
    assert judge("x.py", b"def f(x):\n    print 'a'\n")[1] > 0
    assert judge("x.js", b"const x: number = 1;\n")[3] == "mismatch"
    assert judge("x.js", b"const a = 'never closed;\nf();\n")[1] > 0


def test_odd_inputs():
    for source in (None, b"", b"\n\n", b"   "):
        assert judge("a.py", source)[1] == 0
    assert judge(None, b"def (")[1] == 0 and judge("a.unknown", b"def (")[1] == 0
    assert judge("a.js", b"[" + b"1, " * 20_000 + b"1];\n")[1] == 0
    assert judge("a.py", b"x = 1\xff\n")[1] > 0


def recognised(g, tokens):
    """A plain chart recogniser with origins, which shares nothing."""
    columns = [set() for _ in range(len(tokens) + 2)]
    columns[0].add((g.start[0], 0))
    for i, token in enumerate([*tokens, END]):
        column, before = columns[i], -1
        while len(column) != before:
            before = len(column)
            for q, o in list(column):
                for b, to in g.calls[q].items():
                    column.add((g.start[b], i))
                    if g.nullable[b]:
                        column.add((to, o))
                if g.final[q]:
                    column |= {(to, o2) for q2, o2 in columns[o] for b, to in g.calls[q2].items() if b == g.owner[q]}
                if token in g.before and g.loose_end in g.term[q]:
                    column.add((g.term[q][g.loose_end], o))
        columns[i + 1] = {(g.term[q][token], o) for q, o in column if token in g.term[q]}
    return any(o == 0 and g.owner[q] == 0 and g.final[q] for q, o in columns[len(tokens)])


def brute(g, tokens, alphabet, most):
    """Least edits, by trying all of them; a bracket is no replacement and is not replaced."""
    pairs = {*BRACKETS, *BRACKETS.values()}
    seen = {tuple(tokens)}
    for cost in range(most + 1):
        if any(recognised(g, list(t)) for t in seen):
            return cost
        more = set()
        for t in seen:
            for i in range(len(t) + 1):
                more |= {t[:i] + (a,) + t[i:] for a in alphabet}
                if i < len(t):
                    more |= {t[:i] + (a,) + t[i + 1 :] for a in alphabet if not {a, t[i]} & pairs} | {t[:i] + t[i + 1 :]}
        seen = more
    return most + 1


def test_repairs_are_least_on_short_texts():
    g = Grammar("s = item*\nitem = 'x' ';' | '{' item* '}' | '(' expr ')' ';'\nexpr = 'x' ('+' 'x')*")
    shared, alphabet = SharedChart(g), ["x", ";", "{", "}", "(", ")", "+"]
    for n in range(1, 4):
        for t in itertools.product([*alphabet, "ERR"], repeat=n):
            want, got = brute(g, t, alphabet, 2), repair(shared, list(t))
            assert got.exact and len(got.places) == got.cost and (got.cost == want or want == 3 <= got.cost), (t, want, got)
    rng = random.Random(2)
    for _ in range(25):
        t = [rng.choice([*alphabet, "ERR"]) for _ in range(5)]
        want, got = brute(g, t, alphabet, 2), repair(shared, t)
        assert got.exact and (got.cost == want or want == 3 <= got.cost), (t, want, got)


def test_repairs_undo_edits_at_any_distance():
    """Two faults far apart cost two edits; without steps left the cost is an upper bound and says so."""
    for path, text in VALID.items():
        language = judge(path, b"")[0]
        tokens, _ = tokenize(language, text, path)
        broken = ["ERR", *tokens, "ERR"]
        got = repair(shared_chart(language), broken)
        assert got.exact and got.cost == 2, (path, got)
        bound = repair(shared_chart(language), broken, 0)
        assert bound.cost >= 2 and (bound.cost == 2 or not bound.exact)


def test_sentences_hold_brackets_in_pairs():
    """The bound of the search rests on it: whatever leads to a state has the same open brackets."""
    step = {a: (i, 1) for i, a in enumerate(BRACKETS)} | {b: (i, -1) for i, b in enumerate(BRACKETS.values())}
    for language in sorted(set(SUFFIXES.values())):
        g = grammar(language)
        for begin in g.start:
            open_, todo = {begin: (0,) * len(BRACKETS)}, [begin]
            while todo:
                q = todo.pop()
                assert not g.final[q] or not any(open_[q]), language
                for token, to in [*g.term[q].items(), *((None, to) for to in g.calls[q].values())]:
                    k, d = step.get(token, (0, 0))
                    now = tuple(x + d * (i == k) for i, x in enumerate(open_[q]))
                    if to not in open_:
                        open_[to] = now
                        todo.append(to)
                    assert open_[to] == now, (language, token)


def test_forms_that_are_valid():
    for path, text in {
        "a.jsx": "const A = () => <div className='x'>{items.map((i) => <li key={i}>it's {i}</li>)}</div>;\n", "a.tsx": "export function A({ x }: P) {\n  return (\n    <Foo bar={x} baz='1'>\n      <>hi</>\n    </Foo>\n  );\n}\n",
        "a.cpp": "#ifdef A\nint f(int a) {\n#else\nint f(long a) {\n#endif\n  return 1;\n}\n#if 0\nint g( {\n#endif\n",
        "a.cs": "class A { void F() { var q = from x in xs where x.A > 1 orderby x.B descending, x.C select new { x.A, B = 2 }; var t = await G(); if (t is not null and string s) { } var u = t with { A = 1 }; var z = t switch { > 1 => 2, { Length: 3 } => 4, _ => 5 }; } int P { get; init; } }",
        "a.java": "class A { sealed interface S permits B, C {} record B(int x) implements S {} int f(Object o) { if (o instanceof String s && s.length() > 1) { return 1; } return switch (o) { case B(int x) when x > 1 -> x; case String s -> { yield 2; } default -> 3; }; } }",
        "a.py": "match x:\n    case [1, *r] as z if r:\n        pass\n    case {'a': 1, **k}:\n        pass\ntype X[T] = list[T]\nmatch = type(x)\ncase, (a, *b) = 1, (2, 3)\na.b[1].c = d = yield\nfor a, (b, c) in x: del a, b[1]\n",
    }.items():
        assert judge(path, text.encode())[1] == 0, path


def test_forms_that_are_not():
    for path, text in [
        ("a.py", "const LIMIT = 5;\n"), ("a.py", "let x = 1\n"), ("a.py", "f() = 1\n"), ("a.py", "x + 1 = 2\n"), ("a.py", "if x:\n\ty = 1\n        z = 2\n"), ("a.java", "class A { void f() { thorw new X(); } }"),
        ("a.jsx", "const A = <div><b></div>;"), ("a.ts", "const A = <div><b></b></div>;"), ("b.cs", "class A { void F() { foo bar baz; } }"), ("a.cpp", "#if 1\nint f( {\n#else\nint f() {}\n#endif\n"),
    ]:
        assert judge(path, text.encode())[1] > 0, (path, text)


def test_shared_item_sets_accept_the_same():
    g = Grammar("s = item*\nitem = 'x' ';' | '{' item* '}' | '(' expr ')' ';'\nexpr = 'x' ('+' 'x')* opt\nopt = '!'?", ";", ("}", "<end>"))
    shared = SharedChart(g)
    for n in range(6):
        for t in itertools.product(["x", ";", "{", "}", "(", "+", ")"], repeat=n):
            assert shared.accepts(list(t)) == recognised(g, list(t)), t
    rng = random.Random(1)
    for path, text in VALID.items():
        language = judge(path, b"")[0]
        tokens, lines = tokenize(language, text)
        assert len(tokens) == len(lines) and "ERR" not in tokens
        for _ in range(3):
            t = list(tokens)
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(t))
                t[i : i + rng.randint(0, 2)] = rng.sample(tokens, rng.randint(0, 2))
            assert shared_chart(language).accepts(t) == recognised(grammar(language), t), (path, t)
    with pytest.raises(ValueError):
        SharedChart(Grammar("s = s 'x' | 'x'"))


def test_rows_and_rates(spark, at):
    rows = [("f1", "r", "a.py", b"x = (", at(1)), ("f1", "r", "a.py", b"x = (", at(2)), ("f2", "r", "a.py", b"x = 1", at(1)), ("f3", "q", None, None, None), (None, "q", "a.py", b"x = (", at(1))]
    df = spark.createDataFrame([(*r, 7) for r in rows], "file_id string, repo_id string, path string, source binary, scanned_at timestamp_ntz, edit_cost int")
    got = {r["file_id"]: r["edit_cost"] > 0 for r in invalid_files(df).collect()}
    assert got == {"f1": True, "f2": False, "f3": False}
    assert [(r["n_files"], r["n_invalid"], r["rate"]) for r in rates(df).where("language = 'python'").collect()] == [(2, 1, 0.5)]
    assert invalid_files(df.limit(0)).count() == 0


def test_costs_by_spans_are_least_and_beyond_the_search():
    """Texts that the search gives up get their least cost by spans, with as many edits named; a left-out end counts nothing."""
    text = "s = item*\nitem = 'x' ';' | '{' item* '}' | '(' expr ')' ';' | '#' 'x' '+' expr item\nexpr = 'x' ('+' 'x')* opt\nopt = '!'?"
    rng = random.Random(3)
    for loose in ((), (";", ("}", END))):
        g, alphabet = Grammar(text, *loose), ["x", ";", "{", "}", "(", ")", "+", "#", "!"]
        shared = SharedChart(g)
        for k in range(60):
            t = [rng.choice([*alphabet, "ERR"]) for _ in range(rng.randint(1, 4) if k < 20 else rng.randint(5, 14))]
            found, got = least_cost(shared, t), repair(shared, t, 10**9)
            assert got.exact and len(found) == got.cost == repair(shared, t, 0).cost and all(0 <= x <= len(t) for x in found), (t, found, got)
            if k < 20:
                want = brute(g, t, alphabet, 2)
                assert len(found) == want or want == 3 <= len(found), (t, found, want)
    long = [rng.choice(["{", ")", "+", "x", "("]) for _ in range(330)]
    assert len(least_cost(shared, long)) > 127  # in wider numbers


def test_a_text_of_another_kind_has_an_exact_cost():
    other = "Dear all,\n\nplease find (below the minutes of [our meeting; it was long.\n- coffee, 3 cups }\n* tea: none!\nRegards\n" * 3
    for path in VALID:
        tokens, _ = tokenize(judge(path, b"")[0], other, path)
        _, cost, exact, _, _ = judge(path, other)
        assert exact and 0 < cost <= greedy(shared_chart(judge(path, b"")[0]), tokens).cost, path
    assert judge("a.js", "function f() { x")[1:3] == (1, True)  # '}' alone: the ';' before it may be left out


def test_spans_of_a_long_text_do_not_fill_the_memory(monkeypatch):
    """Beyond ``HELD`` bytes the costs of spans lie in a file; a cost over 127 needs no wider numbers where the tokens tell of it."""
    chart, tokens = shared_chart("python"), ["ID", "ID", "BOP"] * 100
    want = least_cost(chart, tokens)
    monkeypatch.setattr(by_spans, "HELD", 100_000, raising=False)
    tracemalloc.start()
    found = least_cost(chart, tokens)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == want and peak < 4_000_000, peak


def test_costs_by_spans_hang_on_no_size(monkeypatch):
    """Lengths made together, pieces and kinds of numbers change nothing; broken stretches cost an edit each at least."""
    rng = random.Random(4)
    for language in ("python", "javascript"):
        chart = shared_chart(language)
        alphabet = sorted(chart.g.tokens)
        for n in (1, 2, 15, 16, 17, 33, 50):
            tokens = [rng.choice([*alphabet[:12], "ID", "ID", "ERR"]) for _ in range(n)]
            want = least_cost(chart, tokens)
            assert chart.automaton.broken(tokens).sum() <= len(want)
            for group, piece, limits in ((1, 64, by_spans.LIMITS), (3, 4096, by_spans.LIMITS[1:]), (16, 256, ((9, np.uint8), by_spans.LIMITS[2]))):
                with monkeypatch.context() as m:
                    m.setattr(by_spans, "GROUP", group)
                    m.setattr(by_spans, "PIECE", piece)
                    m.setattr(by_spans, "LIMITS", limits)
                    assert len(least_cost(chart, tokens)) == len(want), (language, tokens, group)
