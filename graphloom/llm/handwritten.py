"""Generated, minified, vendored and data files told apart from hand-written source.

A linear support vector machine on hashed character n-grams (of the text, and of its leading comments) and path
components scores every file, and its score decides. It is fitted on all files, whose labels come from giveaways:
tool headers, package folders, generated suffixes, layout, copies of released files. Giveaway headers are masked in a
share of the training files, so that the machine also learns what such files look like without them; repositories are
split between training and validation, and the threshold is fixed on the latter. Inside the machine's margin, where it
found no clear answer, an exact check follows: a tool header or a copy of a released file confirms the file.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.languages import language_of
from graphloom.operators.heavy_keys import salted_pair
from graphloom.session import checkpointed

#: Files whose vectors lie in one block of the training table, about; all of them train the machine.
TRAINING_FILES = 4800
#: Files that are packed into one row of it at most.
PACKED_FILES = 256
#: Fitting ends where the slope has fallen to this share of its first value.
SLOPE = 1e-3
#: Steps that the search for the minimum remembers.
REMEMBERED = 10
#: Parts of 1 in which slopes are summed, so that their sum depends on no order.
PARTS = 2.0**40
#: Share of the positive training files whose leading comments are masked, in percent.
MASKED = 25
#: Hashed dimensions: a machine is one vector of this length.
DIMENSIONS = 1 << 16
GRAMS = (3, 5)
#: Share of repositories held out for validation, in percent.
HELD_OUT = 20
#: Half the width of the machine's margin: inside it the exact check follows.
MARGIN = 1.0
#: Share of a file's lines that must stand in one released file.
COPY_SHARE = 0.6
#: Distinct lines from which a file can be a released copy at all.
COPY_LINES = 5
KINDS = ("data", "generated", "minified", "vendored")
SEED = 7

_COMMENT = re.compile(r"\s*(?:/\*[\s\S]*?\*/|//[^\n]*|\#(?!\s*(?:include|define|pragma|if|ifdef|ifndef|!\[|\[))[^\n]*|<!--[\s\S]*?-->)")
_HEADER = re.compile(
    r"@generated\b|<auto-generated|auto-?generated (?:file|code|from|by)|(?:code|file|class|source) (?:was |is )?(?:automatically |auto-?)?generated\b|\bgenerated (?:by|from|with) (?:the )?[\w.-]+|do not (?:edit|modify)\b(?! the \w+ by hand, )|changes will be lost"
    r"|machine[- ](?:written|made|generated) from|edit the \w+ instead|^[\s/*#]*source: \S+\.(?:proto|thrift|idl|avsc|graphql|schema|xsd|wsdl)\s*$|otomatik (?:olarak )?oluşturul|elle değiştirmeyin|automatisch (?:generiert|erzeugt)|nicht (?:von hand )?(?:bearbeiten|ändern)|generado automáticamente|généré automatiquement|sourceMappingURL=|^/\*! \S+ v?\d",
    re.IGNORECASE | re.MULTILINE,
)
_VENDORED = re.compile(r"(?:^|/)(?:node_modules|bower_components|jspm_packages|site-packages|dist-packages|Pods|Carthage|Godeps)/|(?:^|/)(?:vendor|third_party|thirdparty|third-party|3rdparty|external|extern|deps)/[^/]+/")
_SUFFIX = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|_pb\.(?:js|d\.ts)|\.pb\.(?:go|cc|h|dart)|\.g\.cs|\.designer\.cs|\.gen\.\w+|_generated\.\w+|\.generated\.\w+|OuterClass\.java|[.-](?:min|prod|bundle)\.m?js)$")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
_NUMERAL = re.compile(r"(?<!\w)[-+]?(?:0[xX][\da-fA-F]+|\d+(?:\.\d+)?)\w?(?!\w)")


def leading_comment(text: str) -> str:
    """The comments before the first line of code."""
    at = 0
    while m := _COMMENT.match(text, at):
        at = m.end()
    return text[:at]


def is_minified(text: str, language: str | None) -> bool:
    """Script with hardly any white space or line ends outside its strings."""
    if language not in ("javascript", "typescript", None):
        return False
    body = _STRING.sub("''", text[len(leading_comment(text)) :])
    if len(body) < 200 or "function" not in body and "=>" not in body:
        return False
    return len(body) / (body.count("\n") + 1) > 200 and sum(c.isspace() for c in body) / len(body) < 0.12


def is_data(text: str) -> bool:
    """Nearly nothing but literals: numbers, strings, encoded or comma-separated lines."""
    body = text[len(leading_comment(text)) :].strip()
    if len(body) < 300:
        return False
    lines = [x.strip() for x in body.splitlines() if x.strip()]
    encoded = sum(len(x) for x in lines if len(x) >= 40 and re.fullmatch(r"[A-Za-z0-9+/=_-]+", x))
    if encoded > 0.7 * len(body):
        return True
    if len(lines) >= 8:
        commas = [x.count(",") for x in lines]
        usual = max(set(commas), key=commas.count)
        if usual >= 2 and commas.count(usual) >= 0.8 * len(lines) and not re.search(r"[;{}()\[\]=]", body) and sum(bool(re.match(r"[\"\w-]*\d", x)) for x in lines) >= 0.6 * len(lines):
            return True
    bare = _NUMERAL.sub("", _STRING.sub("", body))
    return len(re.sub(r"[\s,\[\](){}:;=&]+", "", bare)) < 0.1 * len(body)


def line_hashes(text: str) -> set[int]:
    """Hashes of the distinct lines that hold more than three signs, without indentation."""
    return {xxhash.xxh64_intdigest(s.encode()) >> 1 for x in text.splitlines() if len(s := x.strip()) > 3}


def clean(source: bytes | str | None) -> str:
    text = source if isinstance(source, str) else bytes(source or b"").decode("utf-8", "replace")
    return text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")


def header_of(text: str) -> bool:
    """Whether the leading comments say that a tool wrote the file."""
    return bool(_HEADER.search(leading_comment(text)))


def weak_label(path: str, text: str, copied: float) -> str | None:
    """The kind that a giveaway names, or None for a file without any; used for training and validation only."""
    if copied >= COPY_SHARE or _VENDORED.search(path):
        return "vendored"
    if header_of(text) and not leading_comment(text).startswith("/*!") or _SUFFIX.search(path) and not path.endswith("js"):
        return "generated"
    if is_minified(text, language_of(path)):
        return "minified"
    if is_data(text):
        return "data"
    return "generated" if _SUFFIX.search(path) or header_of(text) else None


_ONE_DIGIT = bytes.maketrans(b"123456789", b"000000000")
_DAMPED = np.log1p(np.arange(4096))
_NOTHING = (np.zeros(0, np.int64), np.zeros(0))


def grams(text: str, group: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, values) of the hashed n-grams of a text, scaled to length 1; digits count as one sign."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_ONE_DIGIT), np.uint8).astype(np.uint64)
    found = []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            if len(raw) < n:
                continue
            h = np.full(len(raw) - n + 1, n + group, np.uint64)
            for j in range(n):
                h *= np.uint64(0x100000001B3)
                h += raw[j : len(raw) - n + 1 + j]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            found.append((h >> np.uint64(48)).astype(np.int64))
    if not found:
        return _NOTHING
    counts = np.bincount(np.concatenate(found), minlength=DIMENSIONS)
    at = np.flatnonzero(counts)
    value = _DAMPED[np.minimum(counts[at], len(_DAMPED) - 1)]
    return at, value / np.sqrt(value @ value)


def features(path: str | None, text: str, masked: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, values) of a file in three groups of length 1 each: n-grams of the text without its leading comments,
    n-grams of those comments unless ``masked``, and the parts of its path, if it has one. A dimension can repeat."""
    head = leading_comment(text)
    groups = [grams(text[len(head) :].strip(), 0)]
    if not masked and head.strip():
        groups.append(grams(head.strip(), 1 << 20))
    if path:
        *folders, name = re.sub(r"^(?:\./)+", "", path.replace("\\", "/")).split("/")
        parts = [f"d:{x}" for x in folders] + [f"s:{re.sub(r'^[^._-]*', '', name)}", f"t:{name.split('.', 1)[-1]}"]
        own = np.array(sorted({xxhash.xxh64_intdigest(p) % DIMENSIONS for p in parts}), np.int64)
        groups.append((own, np.full(len(own), 1 / np.sqrt(len(own)))))
    return np.concatenate([k for k, _ in groups]), np.concatenate([v for _, v in groups])


@dataclass
class Machine:
    weights: np.ndarray
    bias: float

    def score(self, keys: np.ndarray, values: np.ndarray) -> float:
        return float(self.weights[keys] @ values + self.bias)


def packed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dimensions, values, first place of each file) of files one after another; a file without features has one of value 0."""
    found = [x if len(x[0]) else (np.zeros(1), np.zeros(1)) for x in found]
    size = np.array([len(k) for k, _ in found])
    return np.concatenate([k for k, _ in found]).astype(np.uint16), np.concatenate([v for _, v in found]).astype(np.float32), (np.cumsum(size) - size).astype(np.int32)


def slopes(rows: list[tuple[np.ndarray, tuple]], weights: np.ndarray, costs: np.ndarray, wanted: set[int]) -> np.ndarray:
    """(machine, DIMENSIONS + 2): the slope of the wanted machines over the rows, the loss last, in whole ``PARTS``.

    A row is (side of its files for each machine: 1, -1 or, if they don't train that one, 0; ``packed`` files). The loss of a file is
    the square of what it lacks to the margin, times the machine's cost of that side (``costs``: positive, negative).
    """
    out = np.zeros((len(weights), DIMENSIONS + 2))
    for side, (keys, v, at) in rows:
        k, size = keys.astype(np.intp), np.diff(at, append=len(keys))
        for m in wanted:
            if y := int(side[m]):
                w, cost = weights[m], costs[m, 0 if y > 0 else 1]
                lack = np.maximum(0.0, 1 - y * (np.add.reduceat(w[k] * v, at) + w[DIMENSIONS]))
                on = lack > 0
                if on.any():
                    each, part = np.repeat(on, size), -2 * y * cost * lack[on]
                    out[m, :DIMENSIONS] += np.bincount(k[each], weights=np.rint(np.repeat(part * PARTS, size[on]) * v[each]), minlength=DIMENSIONS)
                    out[m, DIMENSIONS] += np.rint(part * PARTS).sum()
                    out[m, -1] += np.rint(cost * lack[on] ** 2 * PARTS).sum()
    return out


def minimised(loss: Callable[[np.ndarray, set[int]], np.ndarray], sizes: np.ndarray) -> list[Machine]:
    """Linear support vector machines that minimise |w|^2 / 2n plus their losses, all by the same passes over the rows.

    ``loss``: as ``slopes`` of all rows at some weights for some machines; ``sizes``: rows n that train each. Steps follow the slopes and how they
    changed before (limited-memory BFGS), and are halved until the value falls enough.
    """
    machines = range(len(sizes))
    w = np.zeros((len(sizes), DIMENSIONS + 1))
    at = lambda x, wanted: [(f[-1] / PARTS + x[m] @ x[m] / (2 * sizes[m]), f[:-1] / PARTS + x[m] / sizes[m]) for m, f in enumerate(loss(x, wanted))]
    now = at(w, set(machines))
    first = [np.linalg.norm(g) for _, g in now]
    past: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in machines]
    step, way = [1.0] * len(sizes), [None] * len(sizes)
    open_ = {m for m in machines if first[m] > 0}
    while open_:
        tried = w.copy()
        for m in open_:
            if way[m] is None:
                way[m], step[m] = _direction(now[m][1], past[m]), 1.0
            tried[m] += step[m] * way[m]
        found = at(tried, open_)
        for m in sorted(open_):
            if found[m][0] <= now[m][0] + 1e-4 * step[m] * float(now[m][1] @ way[m]):
                past[m] = [*past[m], (tried[m] - w[m], found[m][1] - now[m][1])][-REMEMBERED:]
                w[m], now[m], way[m] = tried[m], found[m], None
                if np.linalg.norm(now[m][1]) <= SLOPE * first[m]:
                    open_.discard(m)
            elif step[m] < 1e-9:  # as low as the parts tell
                open_.discard(m)
            else:
                step[m] /= 2
    return [Machine(x[:-1], float(x[-1])) for x in w]


def _direction(slope: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Down the slope, bent by the remembered steps and changes of slope."""
    d, shares = -slope, []
    for s, y in reversed(past):
        shares.append(float(s @ d) / float(s @ y))
        d = d - shares[-1] * y
    if past:
        s, y = past[-1]
        d = d * (float(s @ y) / float(y @ y))
    for (s, y), a in zip(past, reversed(shares)):
        d = d + (a - float(y @ d) / float(s @ y)) * s
    return d


def cost_of(positive: int, negative: int, c: float = 4.0) -> list[float]:
    """Cost of a row of either side, for the mean over all: both sides weigh alike."""
    return [c / (2 * max(1, positive)), c / (2 * max(1, negative))]


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Machine:
    """A linear support vector machine of rows at hand."""
    positive = sum(y > 0 for *_, y in rows)
    costs, own = np.array([cost_of(positive, len(rows) - positive)]), [(np.array([y]), packed([(k, v)])) for k, v, y in rows]
    return minimised(lambda w, wanted: slopes(own, w, costs, wanted), np.array([len(rows)]))[0]


_TRIED = np.round(np.arange(-0.5, 0.501, 0.05) * MARGIN, 6)


def errors(scores: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positive files, negative files, then for each tried threshold the positive ones up to it and the negative ones above."""
    positive, negative = scores[y > 0], scores[y < 0]
    return np.array([len(positive), len(negative), *(np.sum(positive <= t) for t in _TRIED), *(np.sum(negative > t) for t in _TRIED)], np.int64)


def least_errors(counts: np.ndarray, share: float) -> float:
    """The tried score above which fewest files are judged wrongly where ``share`` of them are positive; of equal ones the nearest to 0.

    ``counts``: of ``errors``. Only scores inside the inner half of the margin are tried; without both classes it is 0.
    """
    positive, negative = (int(x) for x in counts[:2])
    if not positive or not negative:
        return 0.0
    missed, wrongly = counts[2 : 2 + len(_TRIED)], counts[2 + len(_TRIED) :]
    wrong = [(share * int(a) / positive + (1 - share) * int(b) / negative, abs(t), t) for a, b, t in zip(missed, wrongly, _TRIED)]
    return float(min(wrong)[2])


def threshold(scores: np.ndarray, y: np.ndarray, share: float) -> float:
    """``least_errors`` of scores at hand."""
    return least_errors(errors(scores, y), share)


def held_out(repo_id: str | None) -> bool:
    return xxhash.xxh64_intdigest(repo_id or "") % 100 < HELD_OUT


def released_lines(upstream: DataFrame) -> DataFrame:
    """(upstream_id, h): line hashes of the released files, without lines that stand in more than half of them."""

    def lines(batches):
        for b in batches:
            for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = sorted(line_hashes(clean(s)))
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(h), pa.int64()), pa.array(h, pa.int64())], ["upstream_id", "h"])

    rows = upstream.where(F.col("upstream_id").isNotNull()).select("upstream_id", "source").mapInArrow(lines, "upstream_id bigint, h bigint").distinct()
    files = rows.select(F.count_distinct("upstream_id").alias("n"))
    usual = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(files)).where((F.col("c") > 1) & (2 * F.col("c") > F.col("n")))  # one row is broadcast
    return checkpointed(rows.join(usual.select("h"), "h", "left_anti").select("upstream_id", "h"))


def copied_shares(files: DataFrame, released: DataFrame) -> DataFrame:
    """(file_id, copied): the greatest share of a file's lines that stands in one released file.

    ``files``: (file_id, lines), its distinct line hashes. Lines meet in one shuffled join; a line that much of the corpus
    shares is cut into salted shares. Files of fewer than ``COPY_LINES`` lines copy nothing; files without a released line are left out.
    """
    own = files.where(F.size("lines") >= COPY_LINES).select("file_id", F.size("lines").alias("n"), F.explode("lines").alias("h"))
    left, right = salted_pair(own, released, "h", ["file_id"])
    shared = left.join(right, ["h", "_salt"]).groupBy("file_id", "upstream_id").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    return shared.groupBy("file_id").agg(F.max(F.col("c") / F.col("n")).alias("copied"))


def _latest(rows: DataFrame, released: DataFrame) -> DataFrame:
    """(file_id, repo_id, path, source, copied) of the latest scan of every file."""

    def lines(batches):
        for b in batches:
            own = [sorted(line_hashes(clean(s))) for s in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(own, pa.list_(pa.int64()))], ["file_id", "scanned_at", "lines"])

    when = rows.schema["scanned_at"].dataType.simpleString()
    own = rows.select("file_id", "scanned_at", "path", "source").mapInArrow(lines, f"file_id string, scanned_at {when}, lines array<bigint>")
    own = checkpointed(own.groupBy("file_id").agg(F.max(F.struct("scanned_at", "lines")).alias("s")).select("file_id", "s.lines"))
    last = rows.groupBy("file_id").agg(F.max(F.struct("scanned_at", "path", "source", "repo_id")).alias("s")).select("file_id", "s.repo_id", "s.path", "s.source")
    return last.join(copied_shares(own, released), "file_id", "left").select("file_id", "repo_id", "path", "source", F.coalesce("copied", F.lit(0.0)).alias("copied"))


def _label(path: str, source: bytes | str | None, copied: float) -> str | None:
    text = clean(source)
    return weak_label(path, text, copied) if text.strip() else None


def labelled(rows: DataFrame, released: DataFrame) -> DataFrame:
    """(file_id, label) of files by their giveaways; of repeated scans the latest counts."""

    def describe(batches):
        for b in batches:
            path, source, share = (b.column(i).to_pylist() for i in (2, 3, 4))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(_label, path, source, share), pa.string())], ["file_id", "label"])

    return _latest(rows, released).mapInArrow(describe, "file_id string, label string")


def training_table(rows: DataFrame, upstream: DataFrame, released: DataFrame) -> DataFrame:
    """(label, unseen, released, n, k, v, at): the vectors of all files and released files, of a share of the positive files without leading comments.

    A row packs ``n`` files of one label. Of repeated scans the latest counts. ``unseen``: the repositories are held out. The table is
    written once, in blocks of about ``TRAINING_FILES`` files.
    """
    schema, names = "label string, unseen boolean, released boolean, n bigint, k binary, v binary, at binary", ["label", "unseen", "released", "n", "k", "v", "at"]

    def batch(groups: dict[tuple, list]) -> pa.RecordBatch:
        own = [(*key, len(found), *(x.tobytes() for x in packed(found))) for key, found in groups.items()]
        kinds = (pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in own], t) for i, t in enumerate(kinds)], names)

    def files(batches):
        for whole in batches:
            for b in (whole.slice(i, PACKED_FILES) for i in range(0, whole.num_rows, PACKED_FILES)):
                groups: dict[tuple, list] = {}
                for i, repo, path, source, share in zip(*(x.to_pylist() for x in b.columns)):
                    label = _label(path, source, share)
                    masked = label is not None and xxhash.xxh64_intdigest(i, SEED) % 100 < MASKED
                    groups.setdefault((label, held_out(repo), False), []).append(features(path, clean(source), masked))
                yield batch(groups)

    def releases(batches):
        for whole in batches:
            for b in (whole.slice(i, PACKED_FILES) for i in range(0, whole.num_rows, PACKED_FILES)):
                yield batch({("vendored", False, True): [features(None, clean(s)) for s in b.column(0).to_pylist()]})

    spark, n = rows.sparkSession, rows.count() // TRAINING_FILES + 1
    table = _latest(rows, released).mapInArrow(files, schema).union(upstream.where(F.col("upstream_id").isNotNull()).select("source").mapInArrow(releases, schema))
    return checkpointed(table.repartition(max(n, spark.sparkContext.defaultParallelism)))


def _cleaned(files: DataFrame) -> DataFrame:
    return files.where(F.col("file_id").isNotNull()).select("file_id", "repo_id", "scanned_at", F.coalesce("path", F.lit("")).alias("path"), "source")


@dataclass
class Fitted:
    """The machine, one more per kind (which of the kinds a found file is), its threshold and the files that trained it."""

    machine: Machine
    kinds: dict[str, Machine]
    threshold: float
    n_train: int


def _summed(table: DataFrame, of: Callable, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``of(rows)`` over a training table, a row as (label, packed files); beyond a few tasks they add up among themselves first."""

    def added(batches):
        total = np.zeros(shape)
        for b in batches:
            for label, k, v, at in zip(b.column(0).to_pylist(), *b.columns[1:]):
                own = (np.frombuffer(x.as_buffer(), t) for x, t in ((k, np.uint16), (v, np.float32), (at, np.int32)))
                total += of([(label, tuple(own))])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

    parts = table.select("label", "k", "v", "at").mapInArrow(added, "g binary").rdd.map(lambda r: np.frombuffer(r["g"]))
    return parts.treeReduce(lambda a, b: a + b, 1 if parts.getNumPartitions() <= 32 else 2).reshape(shape)


def fitted(rows: DataFrame, upstream: DataFrame, released: DataFrame) -> Fitted:
    """The machine for ``rows``, from all of them and all released files.

    Files of held-out repositories train nothing and fix the threshold. Without labelled files of both classes every
    score is -1, so that nothing is found.
    """
    table = training_table(rows, upstream, released)
    counts = {(r["label"], r["unseen"], r["released"]): r["count"] for r in table.groupBy("label", "unseen", "released").agg(F.sum("n").alias("count")).collect()}  # at most 20 rows
    of = lambda f: sum(x for k, x in counts.items() if f(*k))
    own = of(lambda label, unseen, release: not unseen and not release)
    positive = of(lambda label, unseen, release: not unseen and not release and label)
    if not positive or positive == own:
        return Fitted(Machine(np.zeros(DIMENSIONS), -1.0), {}, 0.0, own)
    by = {kind: of(lambda label, unseen, release, kind=kind: not unseen and label == kind) for kind in KINDS}
    kinds = [k for k in KINDS if by[k]]
    found = sum(by.values())
    costs = np.array([cost_of(found, own - positive), *(cost_of(by[k], found - by[k]) for k in kinds)])
    sides = {k: np.array([1, *(1 if k == x else -1 for x in kinds)]) for k in kinds} | {None: np.array([-1, *(0 for _ in kinds)])}
    context, fit = rows.sparkSession.sparkContext, table.where("not unseen")

    def loss(weights: np.ndarray, wanted: set[int]) -> np.ndarray:
        sent = context.broadcast(weights)  # five vectors of DIMENSIONS floats
        try:
            return _summed(fit, lambda x: slopes([(sides[label], own) for label, own in x], sent.value, costs, wanted), (len(weights), DIMENSIONS + 2))
        finally:
            sent.destroy()

    machine, *others = minimised(loss, np.array([found + own - positive, *(found for _ in kinds)]))
    single = context.broadcast(machine.weights)
    bias = machine.bias

    def judge(x: list) -> np.ndarray:
        return sum(errors(np.add.reduceat(single.value[k] * v, at) + bias, np.full(len(at), 1 if label else -1)) for label, (k, v, at) in x)

    counted = _summed(table.where("unseen"), judge, (2 + 2 * len(_TRIED),))
    everything = of(lambda label, unseen, release: not release)
    share = of(lambda label, unseen, release: not release and label) / everything
    return Fitted(machine, dict(zip(kinds, others)), least_errors(counted, share), found + own - positive)


def judged(files: DataFrame, upstream: DataFrame) -> tuple[DataFrame, Fitted]:
    """(file_id, repo_id, kind, score, evidence, unseen) of every file, and what was fitted.

    ``kind``: vendored, generated, minified, data, or null for a hand-written file. A file is found where its score is above
    the threshold, or inside the machine's margin below it where the exact check confirms it; ``evidence`` names what did
    (machine, header, copy). ``unseen``: the file's repository is held out of training. Of repeated scans the latest counts;
    null paths and sources are empty texts, an empty file is hand-written; rows with a null file_id are left out.
    """
    spark = files.sparkSession
    rows, released = _cleaned(files), released_lines(upstream)
    fit = fitted(rows, upstream, released)
    single = lambda m: (m.weights.astype(np.float32), m.bias)
    model = spark.sparkContext.broadcast((single(fit.machine), {k: single(m) for k, m in fit.kinds.items()}))  # five vectors of DIMENSIONS floats
    above = fit.threshold

    def score(batches):
        machine, kinds = Machine(*model.value[0]), {k: Machine(*m) for k, m in model.value[1].items()}
        for b in batches:
            found, scores, headers, lines = [], [], [], []
            unseen = pa.array([held_out(x) for x in b.column(1).to_pylist()], pa.bool_())
            for p, s in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                t = clean(s)
                full = bool(t.strip())
                k, v = features(p, t) if full else _NOTHING
                value = machine.score(k, v) if full else -MARGIN
                undecided = full and -MARGIN < value <= above
                header = undecided and header_of(t)
                scores.append(value)
                headers.append(header)
                lines.append(sorted(line_hashes(t)) if undecided and not header else [])
                found.append(max(kinds, key=lambda x: (kinds[x].score(k, v), x)) if kinds and value > above else None)
            own = [pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(headers, pa.bool_()), pa.array(lines, pa.list_(pa.int64())), unseen]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *own], ["file_id", "repo_id", "scanned_at", "kind", "score", "header", "lines", "unseen"])

    when = files.schema["scanned_at"].dataType.simpleString()
    scored = rows.mapInArrow(score, f"file_id string, repo_id string, scanned_at {when}, kind string, score double, header boolean, lines array<bigint>, unseen boolean")
    values = ["repo_id", "kind", "score", "header", "unseen", "lines"]
    last = scored.groupBy("file_id").agg(F.max(F.struct("scanned_at", *values)).alias("s")).select("file_id", *[F.col(f"s.{v}").alias(v) for v in values])
    last = checkpointed(last)
    copies = copied_shares(last.where(F.size("lines") > 0).select("file_id", "lines"), released).where(F.col("copied") >= COPY_SHARE)
    known = last.drop("lines").join(copies, "file_id", "left")
    evidence = F.when(F.col("score") > above, "machine").when(F.col("header"), "header").when(F.col("copied").isNotNull(), "copy")
    kind = F.when(evidence == "header", "generated").when(evidence == "copy", "vendored").otherwise(F.col("kind"))
    return known.select("file_id", "repo_id", kind.alias("kind"), "score", evidence.alias("evidence"), "unseen"), fit


def validated(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """(figure, value): the machine alone against the giveaways, over every file of the held-out repositories.

    A file is found by the machine where its score is above the threshold, without the exact check. ``recall_<kind>``: share
    of the files with that giveaway that it finds. A share of nothing is 0.
    """
    scored, fit = judged(files, upstream)
    rows = _cleaned(files)
    unseen = rows.join(scored.where("unseen").select("file_id"), "file_id", "left_semi")
    x = scored.where("unseen").join(labelled(unseen, released_lines(upstream)), "file_id", "left")
    found, giveaway = F.col("score") > fit.threshold, F.col("label").isNotNull()
    count = lambda c: F.count_if(c).cast("double")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    n, both = F.count(F.lit(1)).cast("double"), count(found & giveaway)
    figures = {
        "accuracy": share(count(found == giveaway), n), "n_train": F.lit(float(fit.n_train)), "n_validation": n, "precision": share(both, count(found)), "recall": share(both, count(giveaway)),
        **{f"recall_{k}": share(count(found & (F.col("label") == k)), count(F.col("label") == k)) for k in KINDS}, "threshold": F.lit(fit.threshold),
    }
    all_of = x.agg(F.array(*[F.struct(F.lit(k).alias("figure"), v.alias("value")) for k, v in figures.items()]).alias("f"))
    return all_of.select(F.explode("f").alias("f")).select("f.figure", "f.value")
