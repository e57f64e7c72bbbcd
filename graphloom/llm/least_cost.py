"""The least number of edits for any text, by spans: cubic in its tokens, for what the search of ``chart.repair`` leaves open.

``cost[q][j][i]`` is the least number of edits that lead tokens ``j..i`` from the start of a nonterminal to its state ``q``.
Spans are filled by length, all spans of one length in one array: a span ends with a deleted, kept or replaced token, or
with a called nonterminal, whose start is tried at every place; insertions follow by a closure. A state of mode 1 has left
out the loose end, so that one of the tokens ``before`` must follow. Costs are bytes that stop at 127, which changes no
lesser cost; a text that costs as much is filled again in wider numbers.

Costs are kept less the edits that the tokens need anywhere: ``Automaton.broken`` cuts a text into stretches that stand in no
sentence, so each costs an edit at least and a span all those it holds, of which one may only reach into it. This leaves small
numbers to long texts. Sums over places are made for many lengths at a time, in pieces that stay in the cache, and the arrays
of a long text lie in a file: memory grows no faster than the text.
"""

from __future__ import annotations

import tempfile

import numpy as np

from graphloom.llm.chart import _OPEN, END, FAR, Grammar, SharedChart

#: Costs at which numbers of one, two and four bytes stop: two of them must fit.
LIMITS = ((127, np.uint8), (16_000, np.int16), (FAR, np.int32))
#: Numbers are kept one higher, as a span may reach into one stretch that it does not hold.
RAISED = 1
#: Lengths of which the sums are made together, and bytes of a piece.
GROUP, PIECE = 16, 16_384
#: Places below which rows are gathered for many sources at once.
SHORT = 400
#: Bytes of arrays of one text that are held in memory; those of a longer text lie in a file.
HELD = 320_000_000


class _Least:
    """For each target the least of ``row[source] + cost``. Targets with most sources come first, so that layers are prefixes."""

    def __init__(self, triples: dict[tuple[int, int], int]):
        by: dict[int, list[tuple[int, int]]] = {}
        for (s, t), x in sorted(triples.items()):
            by.setdefault(t, []).append((s, x))
        order = sorted(by, key=lambda t: (-len(by[t]), t))
        self.targets = np.array(order, np.intp)
        self.layers = []
        for r in range(len(by[order[0]]) if order else 0):
            own = [by[t][r] for t in order if len(by[t]) > r]
            self.layers.append((np.array([s for s, _ in own], np.intp), np.array([x for _, x in own])))
        self.costs: dict[int, list[np.ndarray]] = {}
        self.few: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.groups = []  # targets with about as many sources, filled up by repeating one
        at = 0
        while at < len(order):
            wide = len(by[order[at]])
            own = [t for t in order[at:] if len(by[t]) > wide * 3 // 4]
            filled = [by[t] + by[t][:1] * (wide - len(by[t])) for t in own]
            self.groups.append((np.array(own, np.intp), np.array([[s for s, _ in x] for x in filled], np.intp), np.array([[x for _, x in y] for y in filled])))
            at += len(own)

    def into(self, out: np.ndarray, rows: np.ndarray, most: int, costs: list[np.ndarray] | None = None) -> None:
        """Lowers ``out``; ``costs``: of each layer by column, in place of the constant ones."""
        if not self.layers:
            return
        if costs is None and rows.shape[1] < SHORT:
            if most not in self.few:
                self.few[most] = [(t, s, np.minimum(x, most).astype(rows.dtype)[:, :, None]) for t, s, x in self.groups]
            for t, s, x in self.few[most]:
                part = rows[s]
                part += x
                out[t] = np.minimum(out[t], part.min(axis=1))
            return
        if costs is None:
            if most not in self.costs:
                self.costs[most] = [np.minimum(x, most).astype(rows.dtype)[:, None] for _, x in self.layers]
            costs = self.costs[most]
        best = np.full((len(self.targets), rows.shape[1]), most, rows.dtype)
        for (s, _), x in zip(self.layers, costs):
            part = rows[s]
            part += x
            np.minimum(best[: len(s)], part, out=best[: len(s)])
        out[self.targets] = np.minimum(out[self.targets], best)


class Automaton:
    """A grammar's states in two modes, its nonterminals by the mode they end in, and the least insertions between states."""

    def __init__(self, g: Grammar):
        size, n = len(g.term), len(g.start)
        self.g, self.size, self.n = g, size, n
        self.owner = [*g.owner, *g.owner]
        modes = (0, 1) if g.loose_end else (0,)
        self.words: dict[tuple[int, int], set[str]] = {}
        self.calls: list[tuple[int, int, int]] = []  # (from, nonterminal, to)
        steps: dict[tuple[int, int], int] = {}

        def step(p: int, q: int, x: int) -> None:
            steps[(p, q)] = min(x, steps.get((p, q), FAR))

        for q in range(size):
            for t, to in g.term[q].items():
                self.words.setdefault((q, to), set()).add(t)
                step(q, to, 1)
                if t == g.loose_end:
                    step(q, to + size, 0)
                if g.loose_end and t in g.before:
                    self.words.setdefault((q + size, to), set()).add(t)
                    step(q + size, to, 1)
            for a, to in g.calls[q].items():
                for m in modes:
                    if g.closing[0][g.start[a]][m] < FAR:
                        self.calls.append((q, a + m * n, to + m * size))
                        step(q, to + m * size, g.closing[0][g.start[a]][m])
                if g.loose_end and g.nullable[a]:
                    step(q + size, to + size, 0)
        total = size * len(modes)
        near: list[dict[int, int]] = [{} for _ in range(total)]
        for (p, q), x in steps.items():
            near[p][q] = x
        self.insert: list[dict[int, int]] = []  # least insertions from a state to others of its nonterminal
        for p in range(total):
            got, todo = {p: 0}, [p]
            while todo:
                q = todo.pop()
                for to, x in near[q].items():
                    if got[q] + x < got.get(to, FAR):
                        got[to] = got[q] + x
                        todo.append(to)
            self.insert.append(got)
        self.total, self.heads = total, n * len(modes)
        self.closure = _Least({(p, q): x for p in range(total) for q, x in self.insert[p].items()})
        self.begin = [g.start[a % n] for a in range(self.heads)]
        ends = {(p, self.owner[p] + m * n): g.closing[p // size][p % size][m] for p in range(total) for m in modes}
        self.ends = _Least({k: x for k, x in ends.items() if x < FAR})
        unit: dict[tuple[int, int], int] = {}
        put: dict[tuple[int, int], int] = {}
        for p, a, q in self.calls:
            x = self.insert[g.start[self.owner[p]]].get(p, FAR)
            if x < FAR:
                put[(a, q)] = min(x, put.get((a, q), FAR))
                for m in modes:
                    k = (a, self.owner[p] + m * n)
                    unit[k] = min(x + ends[(q, k[1])], unit.get(k, FAR))
        self.put = _Least(put)
        d = np.full((self.heads, self.heads), FAR)
        np.fill_diagonal(d, 0)
        for (a, b), x in unit.items():
            d[a, b] = min(d[a, b], x)
        for k in range(self.heads):
            d = np.minimum(d, d[:, k, None] + d[None, k])
        self.unit = _Least({(a, b): int(d[a, b]) for a in range(self.heads) for b in range(self.heads) if d[a, b] < FAR})
        self.read = _Least(dict.fromkeys(self.words, 1))
        self.read_pairs = [[(int(s), int(t)) for s, t in zip(src, self.read.targets)] for src, _ in self.read.layers]
        # Deletions at a span's ends may as well stand in what it calls or before the whole. So a call from a start that nothing
        # leads back to needs no other place than the span's own start, and one behind a single token the place after that token.
        into: dict[int, list[tuple[int, bool]]] = {}
        for (p, q) in self.words:
            into.setdefault(q, []).append((p, False))
        for p, _, q in self.calls:
            into.setdefault(q, []).append((p, True))
        for p, q in steps:
            if steps[(p, q)] == 0:
                into.setdefault(q, []).append((p, True))
        starts = {s for s in g.start if s not in into}
        one = {q for q, x in into.items() if all(p in starts and not c for p, c in x)}
        far = sorted((c for c in self.calls if c[0] not in starts and c[0] not in one), key=lambda c: (c[1], c[0]))
        near_ = [c for c in self.calls if c[0] in one]
        far.sort(key=lambda c: (c[1], c[2]))  # calls that lead from several states to one are summed once, from the least of them
        self.far_first = np.array([k for k, c in enumerate(far) if not k or c[1:] != far[k - 1][1:]], np.intp)
        self.far_from = np.array([p for p, _, _ in far], np.intp)
        one_each = [far[k] for k in self.far_first.tolist()]
        self.far, self.edges = len(one_each), one_each + near_
        self.edge_from = np.array([p for p, _, _ in self.edges], np.intp)
        self.edge_head = np.array([a for _, a, _ in self.edges], np.intp)
        self.arrive = _Least({(k, q): 0 for k, (_, _, q) in enumerate(self.edges)})
        self.alone = [np.array([b for b in range(self.heads) if b != a and d[b, a] == 0], np.intp) for a in range(self.heads)]  # what may be all of it
        self.moves: dict[str, list[tuple[int, int]]] = {}
        for k, words in self.words.items():
            for t in words:
                self.moves.setdefault(t, []).append(k)
        free: list[set[int]] = [set() for _ in range(total)]  # what follows without a token, whoever called
        for (p, q), x in steps.items():
            if x == 0:
                free[p].add(q)
        for p, a, q in self.calls:
            free[p].add(g.start[a % n])
            for x in range(total):
                if g.final[x % size] and self.owner[x] + x // size * n == a:
                    free[x].add(q)
        self.free = free
        self.known: dict[int, tuple] = {}
        self.follows: dict[tuple[frozenset, str], frozenset] = {}
        self.own = [[p for p in range(total) if self.owner[p] == a] for a in range(n)]
        self.own_calls = [[c for c in self.calls if self.owner[c[0]] == a] for a in range(n)]
        self.own_words = [[(p, q, w) for (p, q), w in self.words.items() if self.owner[p] == a] for a in range(n)]

    def parts(self, a: int) -> tuple:
        """Of a nonterminal: its states, the insertions between them, the steps and calls by number, and their ends."""
        if a not in self.known:
            own = self.own[a]
            index = {q: x for x, q in enumerate(own)}
            insert = np.array([[self.insert[p].get(q, FAR) for q in own] for p in own])
            words = [(index[p], index[q], w) for p, q, w in self.own_words[a]]
            calls = [(index[p], b, index[q]) for p, b, q in self.own_calls[a]]
            ends = tuple(np.array([x[i] for x in words], np.intp) for i in (0, 1))
            self.known[a] = own, insert, words, calls, ends, tuple(np.array([x[i] for x in calls], np.intp) for i in (0, 1, 2))
        return self.known[a]

    def broken(self, tokens: list[str]) -> np.ndarray:
        """1 at the last token of each of the stretches, one behind the other, that are a part of no sentence; a part may begin and end in any state."""
        whole = at = frozenset(range(self.total))
        out = np.zeros(len(tokens), np.uint8)
        for i, t in enumerate(tokens):
            to = self.follows.get((at, t))
            if to is None:
                seen = {q for p, q in self.moves.get(t, ()) if p in at}
                todo = list(seen)
                while todo:
                    more = self.free[todo.pop()] - seen
                    seen |= more
                    todo += more
                if len(self.follows) > 20_000:
                    self.follows.clear()
                to = self.follows[(at, t)] = frozenset(seen)
            out[i] = not to
            at = to or whole
        return out


def _price(words: set[str], token: str) -> int:
    """Edits to read one of ``words`` where ``token`` stands."""
    return 0 if token in words else 1 if token not in _OPEN and any(w not in _OPEN for w in words) else FAR


def _room(sizes: list[int], kind: type) -> list[np.ndarray]:
    """Flat arrays; large ones in a file that is gone with them."""
    if sum(sizes) * np.dtype(kind).itemsize <= HELD:
        return [np.empty(x, kind) for x in sizes]
    with tempfile.TemporaryFile() as f:
        f.truncate(sum(sizes) * np.dtype(kind).itemsize)
        whole = np.memmap(f, kind, "r+")
    return [np.asarray(x) for x in np.split(whole, np.cumsum(sizes)[:-1])]


class _Triangle:
    """``width`` numbers for each span of a text of ``n`` tokens, by length, then place."""

    def __init__(self, n: int, width: int):
        self.n, self.width = n, width
        self.offsets = np.concatenate([[0], np.cumsum(np.arange(n + 1, 0, -1))]) * width
        self.size = int(self.offsets[-1])

    def of(self, flat: np.ndarray) -> list[np.ndarray]:
        """The part of each length."""
        return [flat[a:b] for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist())]


class _Folded:
    """As ``_Triangle``, but with as far from one length to the next in either half of them: the short ones from the start of their
    lines, the long ones to the end of the lines of those that they fill up."""

    def __init__(self, n: int, width: int):
        self.n, self.width, self.half = n, width, n // 2
        self.size = ((self.half + 1) * (n + 2) + GROUP) * width

    def of(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lines of the lengths up to the half and of those beyond; a line may go on into another one's numbers."""
        n, h, size = self.n, self.half, self.width * flat.itemsize
        short = flat[: (h + 1) * (n + 2) * self.width].reshape(h + 1, -1)
        first = flat[((n - h - 1) * (n + 2) + h + 2) * self.width :]
        return short, np.lib.stride_tricks.as_strided(first, (n - h, (n - h + GROUP - 1) * self.width), (-(n + 1) * size, flat.itemsize))


def _sums(left: list[np.ndarray], right: tuple[np.ndarray, np.ndarray], low: np.ndarray, start: int, far: int) -> None:
    """Lowers the lines of ``low``, for lengths from ``start`` on, by what spans shorter than ``start`` sum up to. What a line holds beyond its places is of no use."""
    short, long = right
    many, size = low.shape
    piece, half = PIECE // low.itemsize, len(short)
    add, least = np.add, np.minimum
    whole = np.empty((many, min(piece, size)), low.dtype)
    for x in range(0, size, piece):
        to = min(x + piece, size)
        own = np.ascontiguousarray(low[:, x:to])
        work = whole if to - x == whole.shape[1] else np.empty_like(own)
        for k in range(1, start):
            a, r, y, z = left[k][x:to], start - k, far * k + x, far * k + to
            end = min(r + many, start)
            if end <= half:
                part = add(short[r:end, y:z], a, work[: end - r])
            elif r >= half:
                part = add(long[r - half : end - half, y:z], a, work[: end - r])
            else:
                add(short[r:half, y:z], a, work[: half - r])
                add(long[: end - half, y:z], a, work[half - r : end - r])
                part = work[: end - r]
            least(own[: end - r], part, own[: end - r])
        low[:, x:to] = own


def _filled(au: Automaton, tokens: list[str], most: int, kind: type) -> tuple[np.ndarray, _Triangle]:
    """By length, place and nonterminal: the least edits that make a span a sentence of it, ``RAISED`` and less the stretches that end in it, at most ``most``."""
    n = len(tokens)
    distinct = sorted(set(tokens))
    number = {t: i for i, t in enumerate(distinct)}
    at = np.array([number[t] for t in tokens], np.intp)
    prices = [np.array([[min(_price(au.words[k], t), most) for t in distinct] for k in pairs], kind).reshape(len(pairs), -1)[:, at] for pairs in au.read_pairs]
    due = au.broken(tokens).astype(kind)
    rows = np.full((au.total, n + 1), most, kind)
    rows[au.begin] = RAISED
    empty = np.full_like(rows, most)
    au.closure.into(empty, rows, most)
    rows = empty
    first = np.full((au.heads, n + 1), most, kind)
    au.ends.into(first, rows, most)
    far, head = au.far, au.edge_head[: au.far]
    spans, folded, heads = _Triangle(n, far), _Folded(n, far), _Triangle(n, au.heads)
    flat = _room([spans.size, folded.size, heads.size], kind)
    left, lines = spans.of(flat[0]), folded.of(flat[1])  # of the states that call at any place, of what they call
    right = [lines[r > folded.half][r - (r > folded.half) * (folded.half + 1)][: far * (n + 1 - r)] for r in range(n + 1)]
    called = heads.of(flat[2])  # of the nonterminals

    def keep(length: int, rows: np.ndarray, now: np.ndarray) -> None:
        calling = np.minimum.reduceat(rows[au.far_from], au.far_first, axis=0) if far else rows[:0]
        for to, x in ((left, calling), (right, now[head]), (called, now)):
            to[length].reshape(x.shape[::-1])[:] = x.T

    keep(0, rows, first)
    before = first
    for length in range(1, n + 1):
        m = n - length + 1
        if (length - 1) % GROUP == 0:
            start, lows = length, np.full((min(GROUP, n + 1 - length), far * m), most + RAISED, kind)
            _sums(left, lines, lows, start, far)
        raw = rows[:, :m] + kind(1)  # the last token is deleted
        au.read.into(raw, rows[:, :m], most, [p[:, length - 1 :] for p in prices])
        raw -= due[length - 1 :]
        np.minimum(raw, rows[:, 1 : m + 1] + (kind(1) - due[:m]), out=raw)  # the first is
        np.minimum(raw, most, out=raw)
        if length > 1 and au.edges:
            low = lows[length - start][: far * m]
            for k in {*range(1, length - start + 1), *range(start, length)}:
                np.minimum(low, left[k][: far * m] + right[length - k][far * k :], out=low)
            near = before[au.edge_head[far:], 1 : 1 + m] + one[:, :m]
            summed = np.vstack([low.reshape(m, far).T, near])
            summed -= kind(RAISED)
            au.arrive.into(raw, np.minimum(summed, most, out=summed), most)
        own = np.full((au.heads, m), most, kind)
        au.ends.into(own, raw, most)
        now = np.full((au.heads, m), most, kind)
        au.unit.into(now, own, most)
        au.put.into(raw, now, most)
        rows = np.full((au.total, m), most, kind)
        au.closure.into(rows, raw, most)
        keep(length, rows, now)
        before = now
        if length == 1:
            one = rows[au.edge_from[far:]]
    return flat[2], heads


def _traced(au: Automaton, tokens: list[str], called: np.ndarray, heads: _Triangle, a: int) -> list[int]:
    """Places of the edits of one cheapest way, from the costs of the nonterminals: each one's states are filled again along its span."""
    out: list[int] = []
    todo = [(a, 0, len(tokens))]
    due = np.concatenate([[0], np.cumsum(au.broken(tokens), dtype=np.int64)])

    def spans(of: np.ndarray, j: int, i: int) -> np.ndarray:
        """Edits of nonterminals ``of``, a row each, for the spans from each place ``j`` on to ``i``."""
        at = np.arange(j, i)
        return called[(heads.offsets[i - at] + at * heads.width) + of[:, None]].astype(np.int64) - RAISED + (due[i] - due[at])

    while todo:
        a, j, i = todo.pop()
        line = called[heads.offsets[i - j] + j * heads.width :]
        while (same := au.alone[a][line[au.alone[a]] == line[a]]).size:
            a = int(same[0])
        own, insert, words, calls, (sources, targets), (callers, callees, into) = au.parts(a % au.n)
        called_at, which = np.unique(callees, return_inverse=True)
        raw = np.full((i - j + 1, len(own)), FAR)
        full = np.full((i - j + 1, len(own)), FAR)
        raw[0, own.index(au.begin[a])] = 0
        full[0] = np.min(raw[0][:, None] + insert, axis=0)
        prices = {t: np.array([_price(w, t) for _, _, w in words], np.int64) for t in set(tokens[j:i])}
        before = np.empty((len(calls), i - j + 1), np.int64)
        for k in range(1, i - j + 1):
            x = full[k - 1] + 1
            np.minimum.at(x, targets, full[k - 1, sources] + prices[tokens[j + k - 1]])
            if calls:
                before[:, k - 1] = full[k - 1, callers]
                np.minimum.at(x, into, np.min(before[:, :k] + spans(called_at, j, j + k)[which], axis=1))
            raw[k] = x
            full[k] = np.min(x[:, None] + insert, axis=0)
        mode = a // au.n
        k = i - j
        q = min((x for x, s in enumerate(own) if au.g.final[s % au.size] and s // au.size == mode), key=lambda x: full[k, x])
        while True:
            p = int(np.argmin(raw[k] + insert[:, q]))
            out += [j + k] * int(insert[p, q])
            q, x = p, raw[k, p]
            if k == 0:
                break
            token = tokens[j + k - 1]
            if found := next(((p, _price(w, token)) for p, to, w in words if to == q and full[k - 1, p] + _price(w, token) == x), None):
                q = found[0]
                out += [j + k - 1] * found[1]
                k -= 1
            elif full[k - 1, q] + 1 == x:
                out.append(j + k - 1)
                k -= 1
            else:
                p, b, s = next((p, b, s) for p, b, to in calls if to == q for s in np.flatnonzero(full[:k, p] + spans(np.array([b]), j, j + k)[0] == x).tolist())
                todo.append((b, j + s, j + k))
                q, k = p, s
    return sorted(out)


def least_cost(chart: SharedChart, tokens: list[str]) -> list[int]:
    """Places of the edits of a cheapest repair of any token sequence."""
    if chart.automaton is None:
        chart.automaton = Automaton(chart.g)
    au, n = chart.automaton, len(tokens)
    whole = [0, au.n] if END in chart.g.before else [0]
    for limit, kind in LIMITS:
        called, heads = _filled(au, tokens, limit, kind)
        a = min(whole, key=lambda a: called[heads.offsets[n] + a])
        if called[heads.offsets[n] + a] < limit - 3 * RAISED:  # what stopped at the limit went down by less outside
            break
    return _traced(au, tokens, called, heads, a)
