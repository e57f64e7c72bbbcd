"""Error-correcting chart parsing: the least number of token edits that makes a token sequence a sentence.

Grammars are written as extended rules and compiled to one minimal automaton per nonterminal. A column of the chart is a
set of items (state, what waits for it); equal columns are one object, shared by all places and texts, so a valid text
is read by one lookup a token. Edits are weighted steps between columns: inserting a token stays at its place, deleting one
stays in its column, replacing one does neither, 1 each. The cheapest way through (place, column) is found best first,
under a lower bound on what the rest must cost: brackets that nothing closes and tokens that no rule knows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

END = "<end>"
#: Brackets come in pairs in every sentence. An edit inserts or deletes one; it is not replaced by another token.
BRACKETS = {"(": ")", "[": "]", "{": "}", "INDENT": "DEDENT"}
_OPENING, _CLOSING = list(BRACKETS), list(BRACKETS.values())
_OPEN = {a: (i, 1) for i, a in enumerate(BRACKETS)} | {b: (i, -1) for i, b in enumerate(BRACKETS.values())}
#: Steps of the search for one text; beyond it the cost is found by spans (``least_cost``), as exactly and for any text.
WORK = 40_000
#: Greedy cost from which only a tenth of these steps is spent: such a text is of another kind, and the spans find its cost.
HOPELESS = 16
FAR = 10**6

_SYMBOL = re.compile(r"\s*(?:'([^']+)'|(\$?\w+)|([()|?*+]))")


class Grammar:
    """Rules ``name = body``, one a line (a body may go on over indented lines). Quoted words and upper-case names are
    tokens, ``$names`` are macros put in place, ``( ) | ? * +`` have their usual meaning. The first rule is the start."""

    def __init__(self, text: str, loose_end: str | None = None, before: tuple[str, ...] = (), soft: tuple[str, ...] = ()):
        #: Token ``loose_end`` may be left out before one of ``before``; tokens ``soft`` stand wherever an ID may.
        self.loose_end, self.before, self.soft = loose_end, frozenset(before), tuple(soft)
        rules: dict[str, str] = {}
        for line in re.sub(r"\n[ \t]+", " ", text.strip()).split("\n"):
            if line.strip():
                name, _, body = line.partition("=")
                rules[name.strip()] = body
        self._macros = {k: v for k, v in rules.items() if k.startswith("$")}
        names = [k for k in rules if not k.startswith("$")]
        self.number = {k: i for i, k in enumerate(names)}
        self.term: list[dict[str, int]] = []
        self.calls: list[dict[int, int]] = []
        self.final: list[bool] = []
        self.owner: list[int] = []
        self.start = [self._compile(i, rules[k]) for i, k in enumerate(names)]
        self.tokens = frozenset(t for x in self.term for t in x)
        self._analyse(len(names))

    # -- compilation: rule text to NFA to DFA
    def _compile(self, owner: int, body: str) -> int:
        edges: list[list[tuple]] = []

        def new() -> int:
            edges.append([])
            return len(edges) - 1

        def parse(tokens: list, stop: bool) -> tuple[int, int]:
            a, b = new(), new()
            x = a
            while tokens and tokens[0] != ")":
                t = tokens.pop(0)
                if t == "|":
                    edges[x].append((None, b))
                    x = a2 = new()
                    edges[a].append((None, a2))
                    continue
                if t == "(":
                    s, e = parse(tokens, True)
                    tokens.pop(0)
                else:
                    s, e = new(), new()
                    edges[s] += [(t, e), *[(("t", w), e) for w in self.soft if t == ("t", "ID")]]
                if tokens and tokens[0] in ("?", "*", "+"):
                    o = tokens.pop(0)
                    s2, e2 = new(), new()
                    edges[s2].append((None, s))
                    edges[e].append((None, e2))
                    if o in "?*":
                        edges[s2].append((None, e2))
                    if o in "*+":
                        edges[e].append((None, s))
                    s, e = s2, e2
                edges[x].append((None, s))
                x = e
            edges[x].append((None, b))
            return a, b

        def scan(text: str) -> list:
            out: list = []
            for m in _SYMBOL.finditer(text.rstrip()):
                if m[1]:
                    out.append(("t", m[1]))
                elif m[3]:
                    out.append(m[3])
                elif m[2].startswith("$"):
                    out += ["(", *scan(self._macros[m[2]]), ")"]
                elif m[2] in self.number:
                    out.append(("n", self.number[m[2]]))
                else:
                    out.append(("t", m[2]))
            return out

        first, last = parse(scan(body), False)

        def closure(states: frozenset) -> frozenset:
            seen, todo = set(states), list(states)
            while todo:
                for label, to in edges[todo.pop()]:
                    if label is None and to not in seen:
                        seen.add(to)
                        todo.append(to)
            return frozenset(seen)

        ids: dict[frozenset, int] = {}
        moves: list[dict[tuple, int]] = []
        final: list[bool] = []

        def state(s: frozenset) -> int:
            if s not in ids:
                ids[s] = len(moves)
                moves.append({})
                final.append(last in s)
                todo.append(s)
            return ids[s]

        todo: list[frozenset] = []
        state(closure(frozenset([first])))
        while todo:
            s = todo.pop()
            reached: dict[tuple, set] = {}
            for q in s:
                for label, to in edges[q]:
                    if label is not None:
                        reached.setdefault(label, set()).add(to)
            for label, to in reached.items():
                moves[ids[s]][label] = state(closure(frozenset(to)))
        group = [int(f) for f in final]  # states that the same sequences lead to the end fall together
        while True:
            numbers: dict[tuple, int] = {}
            finer = [numbers.setdefault((group[q], frozenset((label, group[to]) for label, to in moves[q].items())), len(numbers)) for q in range(len(moves))]
            if len(numbers) == len(set(group)):
                break
            group = finer
        base = len(self.term)
        for g in range(len(numbers)):
            q = finer.index(g)
            self.term.append({name: base + finer[to] for (kind, name), to in moves[q].items() if kind == "t"})
            self.calls.append({name: base + finer[to] for (kind, name), to in moves[q].items() if kind == "n"})
            self.final.append(final[q])
            self.owner.append(owner)
        return base + finer[0]

    def _analyse(self, n: int) -> None:
        far = FAR
        size = len(self.term)
        self.nullable = [False] * n
        self.least = [far] * n  # tokens of the shortest sentence
        self.finish = [0 if f else far for f in self.final]  # tokens to insert from a state to a final one
        changed = True
        while changed:
            changed = False
            for q in range(size):
                best = self.finish[q]
                for t in self.term[q].values():
                    best = min(best, 1 + self.finish[t])
                for a, t in self.calls[q].items():
                    best = min(best, self.least[a] + self.finish[t])
                if best < self.finish[q]:
                    self.finish[q], changed = best, True
            for a in range(n):
                if self.finish[self.start[a]] < self.least[a]:
                    self.least[a], changed = self.finish[self.start[a]], True
        self.nullable = [x == 0 for x in self.least]
        #: Tokens to insert from a state to a final one, by mode here and there. Mode 1: the loose end was left out, one of ``before`` must follow.
        self.closing = [[[0 if f and a == b else far for b in (0, 1)] for f in self.final] for a in (0, 1)]
        changed = True
        while changed:
            changed = False
            for q in range(size):
                ways = [[[1, self.closing[0][to]] for to in self.term[q].values()], [[1, self.closing[0][to]] for t, to in self.term[q].items() if t in self.before]]
                if self.loose_end in self.term[q]:
                    ways[0].append([0, self.closing[1][self.term[q][self.loose_end]]])
                for a, to in self.calls[q].items():
                    ways[0] += [[self.closing[0][self.start[a]][m], self.closing[m][to]] for m in (0, 1)]
                    if self.nullable[a]:
                        ways[1].append([0, self.closing[1][to]])
                for m in (0, 1):
                    best = [min([self.closing[m][q][b], *(x + way[b] for x, way in ways[m])]) for b in (0, 1)]
                    if best != self.closing[m][q]:
                        self.closing[m][q], changed = best, True


class _ItemSet:
    """A column: the items after some token, the open brackets before it, and the columns after each next token."""

    __slots__ = ("accepts", "changes", "depth", "items", "missing", "next")

    def __init__(self, items: list[tuple[int, int]], accepts: bool, depth: tuple[int, ...]):
        self.items, self.accepts, self.depth = items, accepts, depth
        self.next: dict[str, _ItemSet | None] = {}
        self.changes: tuple[list, list] | None = None
        self.missing: int | None = None


class SharedChart:
    """The chart with columns shared by all places and texts of one grammar.

    An item keeps, in place of its origin, the set of items that wait for it there. Equal sets are one object, so the set
    after a token depends on the set before and the token alone and is charted once. Grammars must not be left-recursive,
    and their sentences hold brackets in pairs.
    """

    #: Columns kept; beyond that the chart starts anew, which changes no result.
    KEPT = 60_000

    def __init__(self, grammar: Grammar):
        self.g = grammar
        self.order = self._left_corner_order()
        self.automaton = None  # of least_cost, made where it is needed
        self._reset()

    def _reset(self) -> None:
        self.waiting: list[tuple] = [()]
        self.numbers: dict[frozenset, int] = {frozenset(): 0}
        self.sets: dict[frozenset, _ItemSet] = {}
        self.least: dict[int, tuple[int, int]] = {0: (0, 0 if END in self.g.before else FAR)}
        self.begin = self._set(frozenset([(self.g.start[0], 0)]), (0,) * len(BRACKETS))

    def _left_corner_order(self) -> list[int]:
        g, order, mark = self.g, [], {}

        def visit(a: int) -> None:
            if mark.get(a) == 1:
                raise ValueError("the grammar is left-recursive")
            if a in mark:
                return
            mark[a] = 1
            todo, seen = [g.start[a]], {g.start[a]}
            while todo:
                for b, t in g.calls[todo.pop()].items():
                    visit(b)
                    if g.nullable[b] and t not in seen:
                        seen.add(t)
                        todo.append(t)
            mark[a] = 2
            order.append(a)

        for a in range(len(g.start)):
            visit(a)
        return order[::-1]

    def _set(self, kernel: frozenset, depth: tuple[int, ...]) -> _ItemSet:
        found = self.sets.get(kernel)
        if found is not None:
            return found
        g, items = self.g, set()
        todo = list(kernel)
        while todo:
            x = todo.pop()
            if x in items:
                continue
            items.add(x)
            q, c = x
            if g.final[q]:
                todo += self.waiting[c]
            todo += [(t, c) for b, t in g.calls[q].items() if g.nullable[b]]
        wanted: dict[int, set] = {}
        for q, c in items:
            for b, t in g.calls[q].items():
                wanted.setdefault(b, set()).add((t, c))
        for a in self.order:
            if a not in wanted:
                continue
            who = frozenset(wanted[a])
            c = self.numbers.get(who)
            if c is None:
                c = self.numbers[who] = len(self.waiting)
                self.waiting.append(tuple(who))
            own = [g.start[a]]
            while own:
                q = own.pop()
                if (q, c) in items:
                    continue
                items.add((q, c))
                for b, t in g.calls[q].items():
                    wanted.setdefault(b, set()).add((t, c))
                    if g.nullable[b]:
                        own.append(t)
        found = self.sets[kernel] = _ItemSet(list(items), any(c == 0 and g.owner[q] == 0 and g.final[q] for q, c in items), depth)
        return found

    def _after(self, at: _ItemSet, token: str) -> _ItemSet | None:
        if token in at.next:
            return at.next[token]
        term = self.g.term
        kernel = {(s, c) for q, c in at.items if (s := term[q].get(token)) is not None}
        if token in self.g.before and (loose := self._after(at, self.g.loose_end)):
            kernel |= {(s, c) for q, c in loose.items if (s := term[q].get(token)) is not None}
        depth = at.depth
        if kernel and token in _OPEN:
            i, step = _OPEN[token]
            depth = (*depth[:i], depth[i] + step, *depth[i + 1 :])
        at.next[token] = self._set(frozenset(kernel), depth) if kernel else None
        return at.next[token]

    def changes(self, at: _ItemSet) -> tuple[list[_ItemSet], list[tuple[str, _ItemSet]]]:
        """The distinct columns after inserting one token that is no bracket, and those after each bracket."""
        if at.changes is None:
            term = self.g.term
            plain: dict[int, _ItemSet] = {}
            brackets = []
            for t in sorted({t for q, _ in at.items for t in term[q]}):
                to = self._after(at, t)
                if t in _OPEN:
                    brackets.append((t, to))
                else:
                    plain.setdefault(id(to), to)
            at.changes = list(plain.values()), brackets
        return at.changes

    def _left(self, c: int) -> tuple[int, int]:
        """Tokens to insert after an item whose waiters are ``c`` is complete, in either mode. Waiters are older than what waits for them."""
        todo = [c]
        while todo:
            x = todo[-1]
            if x in self.least:
                todo.pop()
                continue
            open_ = [w for _, w in self.waiting[x] if w not in self.least]
            if open_:
                todo += open_
                continue
            self.least[x] = tuple(min(self.g.closing[m][q][b] + self.least[w][b] for q, w in self.waiting[x] for b in (0, 1)) for m in (0, 1))
            todo.pop()
        return self.least[c]

    def completion(self, at: _ItemSet) -> int:
        """The least number of tokens to insert after a column for the text to end."""
        if at.missing is None:
            at.missing = 0 if at.accepts else min(self.g.closing[0][q][b] + self._left(c)[b] for q, c in at.items for b in (0, 1))
        return at.missing

    def accepts(self, tokens: list[str]) -> bool:
        """Whether the tokens are a sentence as they are."""
        if len(self.sets) > self.KEPT:
            self._reset()
        at = self.begin
        for t in tokens:
            known = at.next
            at = known[t] if t in known else self._after(at, t)
            if at is None:
                return False
        if at.accepts:
            return True
        loose = self._after(at, self.g.loose_end) if END in self.g.before else None
        return bool(loose and loose.accepts)


@dataclass
class Repair:
    """``cost``: edits needed, the least number if ``exact`` (``greedy`` gives an upper bound); ``places``: token positions of the edits."""

    cost: int = 0
    places: list[int] = field(default_factory=list)
    exact: bool = True


def repair(chart: SharedChart, tokens: list[str], work: int = WORK) -> Repair:
    """The cheapest repair of a token sequence: the least number of edits. After ``work`` steps of this search the spans take over.

    Ways are explored by their least possible total: edits so far, plus one for each bracket that the rest leaves without
    a partner and for each token that no rule knows. Among ways of one total those that got farthest come first, so the place where
    the text fails is tried before all others. At the end the cheapest insertions complete the text. A column
    behind the insertion of a plain token is left by its next token or another insertion alone, because deleting
    and replacing may as well come before it. A greedy reading bounds the cost from above; the search ends where both meet.
    """
    if len(chart.sets) > chart.KEPT:
        chart._reset()
    n, known, after = len(tokens), chart.g.tokens, chart._after
    rest = [(0,) * len(BRACKETS)] * (n + 1)  # brackets opened less those closed from each place on
    strange = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        strange[i] = strange[i + 1] + (tokens[i] not in known)
        k, step = _OPEN.get(tokens[i], (0, 0))
        rest[i] = (*rest[i + 1][:k], rest[i + 1][k] + step, *rest[i + 1][k + 1 :])
    seen: list[dict[_ItemSet, bool]] = [{} for _ in range(n + 1)]
    origin: dict[tuple[int, _ItemSet], tuple] = {}
    settled: dict[int, list[tuple[int, _ItemSet, int, bool]]] = {}
    ends: dict[int, _ItemSet] = {}
    stack: list[tuple[int, _ItemSet, int, bool]] = []
    steps = 0

    def arrive(i: int, at: _ItemSet, cost: int, free: bool, before: tuple | None, place: int | None) -> None:
        old = seen[i].get(at)
        if old is None:
            origin[(i, at)] = (before, place)
        elif old or not free:
            return
        seen[i][at] = free
        stack.append((i, at, cost, free))

    def places(i: int, at: _ItemSet) -> list[int]:
        out, key = [], (i, at)
        while key is not None:
            key, place = origin[key]
            if place is not None:
                out.append(place)
        return sorted(out)

    total = sum(map(abs, rest[0])) + strange[0]
    upper = greedy(chart, tokens)
    if upper.cost > HOPELESS:
        work //= 10
    arrive(0, chart.begin, 0, True, None, None)
    while total not in ends and total < upper.cost and steps <= work:
        own = settled[total] = []
        edits = [(*x, more) for more in (1, 2) for x in settled.get(total - more, ())]
        edits.sort(key=lambda x: x[0])
        while (stack or edits) and total not in ends and steps <= work:
            if not stack:
                i, at, cost, free, more = edits.pop()
                plain, brackets = chart.changes(at)
                key, token = (i, at), tokens[i] if i < n else END
                steps += len(plain) + 1
                if i == n:
                    continue
                missing = [a + b for a, b in zip(at.depth, rest[i])]
                if more == 2:
                    for t, to in brackets:
                        k, step = _OPEN[t]
                        if missing[k] * step >= 0:
                            arrive(i, to, cost + 1, True, key, i)
                    if free and token in _OPEN and missing[_OPEN[token][0]] * _OPEN[token][1] <= 0:
                        arrive(i + 1, at, cost + 1, True, key, i)
                    continue
                for to in plain:
                    arrive(i, to, cost + 1, False, key, i)
                if free and token not in _OPEN and token in known:
                    arrive(i + 1, at, cost + 1, True, key, i)
                    for to in plain:
                        arrive(i + 1, to, cost + 1, True, key, i)
                continue
            i, at, cost, free = stack.pop()
            steps += 1
            own.append((i, at, cost, free))
            if i == n:
                ends.setdefault(cost + chart.completion(at), at)
                continue
            key, token = (i, at), tokens[i]
            if total > cost + strange[i]:  # some bracket has no partner: edits that give it one
                for k, (a, b) in enumerate(zip(at.depth, rest[i])):
                    if a + b:
                        to = after(at, (_CLOSING if a + b > 0 else _OPENING)[k])
                        if to:
                            arrive(i, to, cost + 1, True, key, i)
                        if free and token in _OPEN and _OPEN[token] == (k, 1 if a + b > 0 else -1):
                            arrive(i + 1, at, cost + 1, True, key, i)
            if token not in known and free:
                arrive(i + 1, at, cost + 1, True, key, i)
                plain, _ = chart.changes(at)
                steps += len(plain)
                for to in plain:
                    arrive(i + 1, to, cost + 1, True, key, i)
            to = after(at, token)
            if to:
                arrive(i + 1, to, cost, True, key, None)
        if total not in ends:
            if stack or edits:  # out of steps: this total is not ruled out
                break
            total += 1
    if ends and min(ends) <= min(upper.cost, total):
        least = min(ends)
        found = places(n, ends[least])
        return Repair(least, found + [n] * (least - len(found)))
    if upper.cost <= total:
        return Repair(upper.cost, upper.places)
    from graphloom.llm.least_cost import least_cost

    found = least_cost(chart, tokens)
    return Repair(len(found), found)


def greedy(chart: SharedChart, tokens: list[str]) -> Repair:
    """A repair by one reading: where the text fails, a token is inserted or replaced if the reading can then go on, else deleted."""
    at, found, n, after = chart.begin, [], len(tokens), chart._after
    for i, token in enumerate(tokens):
        to = after(at, token)
        if to is None:
            found.append(i)
            plain, brackets = chart.changes(at)
            inserted = (x for y in (*plain, *(b for _, b in brackets)) if (x := after(y, token)))
            replaced = (x for x in plain if i + 1 == n or after(x, tokens[i + 1])) if token not in _OPEN else iter(())
            to = next(inserted, None) or next(replaced, None)
        at = to or at
    found += [n] * chart.completion(at)
    return Repair(len(found), found, False)
