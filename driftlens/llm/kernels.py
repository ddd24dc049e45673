"""Array kernels over blocks of texts: code points, words, rolling hashes.

A block is a few hundred texts laid end to end as one code-point array with
document offsets, so that every step is one numpy pass over the block instead
of a loop over words. Hashes are 64-bit polynomials taken from prefix sums
(``(P[end] - P[start]) * base**-start`` modulo 2**64) and mixed at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
#: Code points in a block; longer texts form a block of their own.
BLOCK_CHARS = 1 << 18
#: Rows of a batch that are Python strings at a time.
SLICE_ROWS = 256


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, kept per process."""
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK_CHARS + 1)
        inverse = U64(pow(int(BASE), -1, 1 << 64))
        for k, b in ((0, BASE), (1, inverse)):
            steps = np.full(size, b, U64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


class Block:
    """Texts of one block: ``cps`` code points, ``offs`` document offsets."""

    def __init__(self, texts: list[str | None]):
        own = [t or "" for t in texts]
        self.n = len(own)
        self.offs = np.zeros(self.n + 1, np.int64)
        np.cumsum(np.fromiter(map(len, own), np.int64, self.n), out=self.offs[1:])
        self.cps = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)
        self._prefix: np.ndarray | None = None
        first = np.zeros(len(self.cps) + 1, bool)
        first[self.offs] = True
        self.first = first[:-1]  # a document starts here

    def prefix(self, cps: np.ndarray | None = None) -> np.ndarray:
        """Prefix sums of the polynomial hash; ``cps`` replaces the block's own (same length)."""
        if cps is None and self._prefix is not None:
            return self._prefix
        v = (self.cps if cps is None else cps).astype(U64)
        v += U64(1)
        v *= U64(0xD6E8FEB86659FD93)
        v ^= v >> U64(32)
        v *= U64(0xD6E8FEB86659FD93)
        v *= powers(len(v) + 1)[0][: len(v)]
        out = np.zeros(len(v) + 1, U64)
        np.cumsum(v, out=out[1:])
        if cps is None:
            self._prefix = out
        return out

    def hashes(self, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
        p = self.prefix() if prefix is None else prefix
        h = (p[ends] - p[starts]) * powers(len(p))[1][starts]
        return mix(h + (ends - starts).astype(U64))

    def runs(self, member: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of member code points; never across documents nor across ``cut``."""
        edge = self.first if cut is None else self.first | cut
        before = np.empty_like(member)
        if len(member):
            before[0] = False
            before[1:] = member[:-1]
        starts = np.flatnonzero(member & (edge | ~before))
        stop = np.ones(len(member), bool)
        if len(member):
            stop[:-1] = edge[1:] | ~member[1:]
        return starts, np.flatnonzero(member & stop) + 1

    def ptr(self, starts: np.ndarray) -> np.ndarray:
        """Where each document's items begin among ascending ``starts``; n + 1 entries."""
        return np.searchsorted(starts, self.offs)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a per-code-point array for each document."""
        p = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=p[1:])
        return p[self.offs[1:]] - p[self.offs[:-1]]


def is_space(cps: np.ndarray) -> np.ndarray:
    """Members of [\\x20\\x09-\\x0D]."""
    return (cps == 32) | ((cps >= 9) & (cps <= 13))


def doc_of(ptr: np.ndarray) -> np.ndarray:
    """Document number of each item."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def segment_sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of values over [ptr[i], ptr[i+1])."""
    p = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=p[1:])
    return p[ptr[1:]] - p[ptr[:-1]]


_ODD = mix(np.arange(1, 65, dtype=U64)) | U64(1)


def ngrams(h: np.ndarray, ptr: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive items within a document, and the position of each first item."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    g = h[:m] * _ODD[0]
    for j in range(1, n):
        g = g + h[j : j + m] * _ODD[j]
    if n > 1:
        left = np.repeat(ptr[1:], np.diff(ptr))[:m] - np.arange(m)
        at = np.flatnonzero(left >= n)
    else:
        at = np.arange(m)
    return mix(g[at]), at


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def blocks(texts: list[str | None], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with at most ``most`` code points, or one text."""
    begin = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and (total + n > most or i - begin >= 4096):
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)


def text_blocks(column: pa.Array) -> Iterator[tuple[int, int, list[str | None]]]:
    """Ranges of rows and their texts; only a slice of the batch is Python strings at a time."""
    for at in range(0, len(column), SLICE_ROWS):
        texts = column.slice(at, SLICE_ROWS).to_pylist()
        for a, b in blocks(texts):
            yield at + a, at + b, texts[a:b]


def map_texts(df, text_col: str, carried: list[str], fields: list[tuple[str, str, pa.DataType]], kernel: Callable):
    """One row per row of df: the carried columns and what ``kernel(texts)`` returns for them.

    ``fields`` are (name, Spark type, Arrow type) of the kernel's columns; the
    kernel gets a list of texts (None where null) and returns a list of arrays.
    Only ``carried`` and the text reach Python, the text once: ``text_col`` may
    name a field of a carried struct (``row.text``). Rows keep their partitioning.
    """
    inner = "__text" + "_" * max((len(c) for c in carried), default=0)
    whole, _, within = text_col.partition(".")
    within = within if whole in carried else ""
    keep = df.select(*[df[c] for c in carried], *([] if within else [df[text_col].alias(inner)]))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields if f.name != inner] + [f"`{n}` {t}" for n, t, _ in fields])
    names = [*carried, *(n for n, _, _ in fields)]
    types = [t for _, _, t in fields]

    def run(batches):
        for batch in batches:
            column = batch.column(carried.index(whole)).field(within) if within else batch.column(len(carried))
            for a, b, texts in text_blocks(column):
                made = kernel(texts)
                arrays = [batch.column(i).slice(a, b - a) for i in range(len(carried))]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x, type=t, from_pandas=False) for x, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return keep.mapInArrow(run, schema)


def list_array(values: np.ndarray, ptr: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(values, type=kind))
