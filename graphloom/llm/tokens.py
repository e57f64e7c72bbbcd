"""Token ids of texts under a public byte-level BPE vocabulary, without regular expressions.

Texts of an Arrow batch become one array of code-point classes. Where a piece begins depends only on the automaton
state before each code point; each class is a function from states to states, composition of such functions is
associative, and so the states come from a blocked prefix scan over whole arrays. The pieces are merged pair by pair
once per worker and kept in a cache.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces kept merged per worker; beyond that the cache starts anew, which changes no result.
CACHE = 1 << 20
#: Code points handled at once, and the block length of the scan.
CHUNK, BLOCK = 1 << 19, 64

# White_Space of Unicode as (first, last).
_SPACES = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
# Classes: letter, number, other, blank before a non-blank, other white space before a non-blank, white space before
# white space or the end, apostrophe that opens a contraction of one or of two letters, end of a text.
L, N, O, SJ, WL, WM, A1, A2, E = range(9)
# States: no open piece, letters, numbers, others, after a joined blank, white space, contraction with 1 or 2 letters to go.
START, IN_L, IN_N, IN_O, JOINED, IN_W, C1, C2 = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece begins) by [class, state]."""
    to, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for c, run in ((L, IN_L), (N, IN_N), (O, IN_O)):
        to[c, :] = run
        begins[c, [run, JOINED]] = False
    for s, after in ((C1, START), (C2, C1)):
        to[L, s], begins[L, s] = after, False
    for c, after in ((A1, C1), (A2, C2)):
        to[c, :] = after
        to[c, [IN_O, JOINED]], begins[c, [IN_O, JOINED]] = IN_O, False
    to[SJ, :], to[WL, :], to[WM, :], to[E, :] = JOINED, START, IN_W, START
    begins[WM, IN_W] = False
    return to, begins


_TO, _BEGINS = _automaton()
_classes: np.ndarray | None = None


def class_table() -> np.ndarray:
    """Class of each code point before lookahead: L, N, O, or WM for white space."""
    global _classes
    if _classes is None:
        kind = {"L": L, "N": N}
        table = np.fromiter((kind.get(unicodedata.category(chr(i))[0], O) for i in range(0x110000)), np.uint8, 0x110000)
        for a, b in _SPACES:
            table[a : b + 1] = WM
        _classes = table
    return _classes


def classes_of(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Classes of code points with their lookahead resolved; ``ends``: positions that hold the end mark of a text."""
    base = class_table()[points]
    base[ends] = E
    after = np.append(base[1:], np.uint8(E))
    white = base == WM
    last = white & (after != WM) & (after != E)
    out = base.copy()
    out[last] = np.where(points[last] == 0x20, SJ, WL)
    at = np.flatnonzero((points == 0x27) & (base == O))
    if len(at):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        real = np.concatenate([base != E, [False, False]])
        x, y = padded[at + 1] * real[at + 1], padded[at + 2] * real[at + 2] * real[at + 1]
        one = np.isin(x, [ord(c) for c in "stmd"])
        two = ((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
        out[at[one]], out[at[two]] = A1, A2
    return out


def boundaries(classes: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each position, by a blocked scan over state functions.

    Within blocks the functions are composed side by side, the blocks' totals are composed by doubling, and each block
    then runs from its entry state, all blocks at once.
    """
    n = len(classes)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, E, np.uint8)
    grid[:n] = classes
    grid = grid.reshape(blocks, BLOCK)
    total = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for j in range(BLOCK):
        total = _TO[grid[:, j][:, None], total]
    step = 1
    while step < blocks:  # total[i] becomes the composition of blocks 0..i
        total[step:] = np.take_along_axis(total[step:], total[:-step].copy(), axis=1)
        step *= 2
    state = np.concatenate([[START], total[:-1, START]]).astype(np.uint8)
    begins = np.empty((blocks, BLOCK), bool)
    for j in range(BLOCK):
        c = grid[:, j]
        begins[:, j] = _BEGINS[c, state]
        state = _TO[c, state]
    out = begins.ravel()[:n]
    out[classes == E] = True
    return out


def pieces(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Per text its pieces and their code-point offsets, for as many texts at once as fit ``CHUNK`` code points.

    A longer text is handled whole, by itself.
    """
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK):
            size += len(texts[j]) + 1
            j += 1
        own = texts[i:j]
        joined = "\0".join(own) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.cumsum([len(t) + 1 for t in own]) - 1
        at = np.flatnonzero(boundaries(classes_of(points, ends)))
        edge = np.searchsorted(at, ends)  # the end marks are boundaries themselves
        begin = 0
        for k, t in enumerate(own):
            cut = at[begin : edge[k] + 1]
            first = ends[k] - len(t)
            offsets = cut - first
            o = offsets.tolist()
            yield [t[a:b] for a, b in zip(o, o[1:])], offsets[:-1]
            begin = edge[k] + 1
        i = j


class Bpe:
    """Pair merging by rank with a cache of whole pieces."""

    _loaded: dict[str, Bpe] = {}

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.cache: dict[str, list[int]] = {}

    @classmethod
    def load(cls, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Bpe:
        path = os.path.join(folder, vocabulary)
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: the adjacent pair of lowest rank is merged, leftmost first, until none is in the vocabulary."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        end = list(range(1, n + 1))  # part i is piece[i:end[i]]
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            end[i], alive[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def ids(self, piece: str) -> list[int]:
        found = self.cache.get(piece)
        if found is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            found = self.cache[piece] = self.merge(piece.encode())
        return found

    def encode(self, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Ids and piece offsets of each text; nothing for null and empty ones."""
        for words, offsets in pieces([t or "" for t in texts]):
            ids: list[int] = []
            get, own = self.cache.get, self.ids
            for w in words:
                ids += get(w) or own(w)
            yield ids, offsets

    def decode(self, ids: list[int]) -> str:
        if not hasattr(self, "_bytes"):
            self._bytes = {v: k for k, v in self.ranks.items()}
        return b"".join(self._bytes[i] for i in ids).decode("utf-8", "replace")


def encoded(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids, offsets): token ids of every row's whole text, and the code-point offset of each piece.

    Null and empty texts have the empty list. Strings that look like markers are ordinary text. Repeated rows stay.
    """
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches):
        bpe = Bpe.load(folder, vocabulary)
        for b in batches:
            rows = list(bpe.encode(b.column(1).to_pylist()))
            ids = pa.array([r[0] for r in rows], pa.list_(pa.int32()))
            offsets = pa.array([r[1].astype(np.int32) for r in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, offsets], [id_column, "ids", "offsets"])

    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>, offsets array<int>")


def token_counts(df: DataFrame, keep: list[str], text_column: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of every row; 0 for null and empty texts."""

    def run(batches):
        bpe = Bpe.load(folder, vocabulary)
        for b in batches:
            counts = [len(ids) for ids, _ in bpe.encode(b.column(b.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, pa.int64())], [*keep, "n_tokens"])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.select(*keep, F.col(text_column).alias("_text")).mapInArrow(run, f"{schema}, n_tokens bigint")
