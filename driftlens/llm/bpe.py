"""Byte-level BPE encoding and decoding (operator 2).

``encode`` splits every whole text into pieces without a regular expression:
code points become symbols of a small automaton, the automaton's transition
functions are composed by an associative scan (a table holds the product of
any two functions), and the state before each code point says whether a piece
begins there. Pieces are slices of the UTF-8 bytes; each distinct piece is
merged once by rank and kept in a bounded cache. Pieces that the cache misses
are merged together, one array row for each.

Each piece's byte offset is retained with the number of its first id. Decoding
puts every piece's bytes at its offset, so any byte span of a text can be
decoded from the ids of the pieces that it touches (``decode_span``).

Defined results: a null text counts as empty; an empty text has no ids and no
pieces; very long texts are encoded whole; every row of the input has one row
in the output, repeated rows and ties included; an empty table gives no rows;
only the named columns are read, so extra columns of any name are ignored.
Nothing is shuffled. An id outside the vocabulary decodes to nothing.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Block, map_texts

# Symbols of the automaton and its states.
SPACE, WHITE, LETTER, NUMBER, OTHER, QUOTE1, QUOTE2 = range(7)
(S_NONE, S_SPACE, S_LETTER, S_NUMBER, S_OTHER, S_ONE_LEFT, S_TWO_LEFT, S_CLOSED) = range(8)

#: Pieces kept per Python worker; the cache is emptied when it is full.
CACHE_PIECES = 250_000
#: Longer pieces are merged one at a time with a heap, shorter ones together.
LONG_PIECE = 48


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Symbol of every code point: white space, letters (L*), numbers (N*), others."""
    import regex

    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            a, b = (x + (0x800 if x >= 0xD800 else 0) for x in (m.start(), m.end() - 1))
            out[a : b + 1] = kind
    out[0x1C:0x20] = OTHER  # white space to Python only, not by the Unicode property
    out[0xD800:0xE000] = OTHER
    out[32] = SPACE
    return out


@lru_cache(maxsize=1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The functions that the symbols generate: their product table, the table of states, ids of the symbols."""
    const = lambda s: (s,) * 8
    letter = tuple({S_TWO_LEFT: S_ONE_LEFT, S_ONE_LEFT: S_CLOSED}.get(s, S_LETTER) for s in range(8))
    quote = lambda to: tuple(S_OTHER if s in (S_OTHER, S_SPACE) else to for s in range(8))
    symbols = [const(S_SPACE), const(S_NONE), letter, const(S_NUMBER), const(S_OTHER), quote(S_ONE_LEFT), quote(S_TWO_LEFT)]
    then = lambda f, g: tuple(g[f[s]] for s in range(8))
    found = list(dict.fromkeys([tuple(range(8)), *symbols]))
    for f in found:  # grows until closed
        for g in symbols:
            if (h := then(f, g)) not in found:
                found.append(h)
    at = {f: i for i, f in enumerate(found)}
    product = np.array([[at[then(f, g)] if then(f, g) in at else 0 for g in found] for f in found], np.uint8)
    return product, np.array(found, np.uint8), np.array([at[s] for s in symbols], np.uint8)


def scan(ids: np.ndarray) -> np.ndarray:
    """Products of all prefixes: columns of blocks advance together, then block totals are scanned alike."""
    product = monoid()[0]
    m, n, width = product.shape[0], len(ids), 256
    flat = product.ravel()
    if n <= width:
        return np.fromiter(accumulate(ids.tolist(), lambda a, b: int(flat[a * m + b])), np.uint8, n)
    rows = -(-n // width)
    padded = np.zeros(rows * width, np.uint8)  # 0 is the identity
    padded[:n] = ids
    grid = np.ascontiguousarray(padded.reshape(rows, width).T).astype(np.intp)
    for j in range(1, width):
        grid[j] = flat[grid[j - 1] * m + grid[j]]
    before = np.zeros(rows, np.intp)
    before[1:] = scan(grid[-1].astype(np.uint8))[:-1]
    return flat[before * m + grid].T.reshape(-1)[:n]


def piece_starts(block: Block) -> np.ndarray:
    """Code-point positions at which a piece begins."""
    c, n = block.cps, len(block.cps)
    if not n:
        return np.zeros(0, np.int64)
    kind = class_table()[c]
    last = np.zeros(n, bool)
    last[block.offs[1:][block.offs[1:] > block.offs[:-1]] - 1] = True
    white = kind <= WHITE
    symbol = kind.copy()
    at = np.flatnonzero((c == 39) & ~last)
    if len(at):
        nxt = c[at + 1]
        one = np.isin(nxt, [115, 116, 109, 100])  # 's 't 'm 'd
        symbol[at[one]] = QUOTE1
        at = at[~last[at + 1]]
        pair = c[at + 1].astype(np.int64) << 32 | c[at + 2]
        symbol[at[np.isin(pair, [ord(x) << 32 | ord(y) for x, y in ("re", "ve", "ll")])]] = QUOTE2
    product, states, symbols = monoid()
    ids = symbols[symbol]
    # A document starts in state S_NONE whatever came before; white space gives the same state.
    lead = np.flatnonzero(block.first)
    ids[lead] = states_of_start()[symbol[lead]]
    after = states[scan(ids), S_NONE]
    before = np.empty(n, np.uint8)
    before[0] = S_NONE
    before[1:] = after[:-1]
    before[block.first] = S_NONE
    start = np.zeros(n, bool)
    # White space: the first of a run, and the last of a run that something follows.
    white_before = np.zeros(n, bool)
    white_before[1:] = white[:-1]
    white_before[block.first] = False
    white_next = np.zeros(n, bool)
    white_next[:-1] = white[1:]
    start |= white & (~white_before | (~last & ~white_next))
    for k, own in ((LETTER, (S_LETTER, S_ONE_LEFT, S_TWO_LEFT)), (NUMBER, (S_NUMBER,)), (OTHER, (S_OTHER,))):
        joined = np.zeros(8, bool)
        joined[[*own, S_SPACE]] = True
        start |= (kind == k) & ~joined[before]
    start |= block.first
    return np.flatnonzero(start)


@lru_cache(maxsize=1)
def states_of_start() -> np.ndarray:
    """For each symbol the constant function to the state that follows S_NONE."""
    _, states, symbols = monoid()
    constant = {int(f[0]): i for i, f in enumerate(states) if len(set(f.tolist())) == 1}
    product = monoid()[0]
    white = symbols[WHITE]
    return np.array([constant.get(int(states[s, S_NONE]), product[white, s]) for s in symbols], np.uint8)


class Vocabulary:
    """Ranks of a tiktoken file; ids are ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.ranks.values()) + 1
        self.bytes_of = [b""] * size
        for b, r in self.ranks.items():
            self.bytes_of[r] = b
        self.text_of = [str(i) for i in range(size)]
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.size_of = np.array([*map(len, self.bytes_of), 0], np.int64)
        self.at_of = np.r_[0, np.cumsum(self.size_of)][:-1]
        byte = np.zeros(256, np.int64)
        for i in range(256):
            byte[i] = self.ranks[bytes([i])]
        self.byte = byte
        # Rank of the union of two tokens, by sorted pair keys: all ways to split a token in two.
        keys, values = [], []
        for b, r in self.ranks.items():
            for k in range(1, len(b)):
                x, y = self.ranks.get(b[:k]), self.ranks.get(b[k:])
                if x is not None and y is not None:
                    keys.append(x << 32 | y)
                    values.append(r)
        order = np.argsort(np.array(keys, np.int64))
        keys, values = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        bits = max(10, int(len(keys)).bit_length() + 3)
        self.shift = np.uint64(64 - bits)
        slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        self.table_key = np.full((1 << bits) + 64, -1, np.int64)
        self.table_rank = np.full((1 << bits) + 64, 1 << 40, np.int64)
        self.probes = 1
        for k, v, s in zip(keys.tolist(), values.tolist(), slots.tolist(), strict=True):
            p = s
            while self.table_key[p] != -1:
                p += 1
            self.table_key[p], self.table_rank[p] = k, v
            self.probes = max(self.probes, p - s + 1)
        self.cache: dict[bytes, bytes] = {}

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        found = self.table_key[at]
        out = np.where(found == key, self.table_rank[at], 1 << 40)
        left_over = np.flatnonzero((found != key) & (found != -1))
        for _ in range(1, self.probes):
            if not len(left_over):
                break
            at[left_over] += 1
            k = self.table_key[at[left_over]]
            hit = k == key[left_over]
            out[left_over[hit]] = self.table_rank[at[left_over[hit]]]
            left_over = left_over[~hit & (k != -1)]
        return out

    def merge_one(self, piece: bytes) -> np.ndarray:
        """A heap over one long piece: lowest rank first, then leftmost."""
        import heapq

        if piece in self.ranks:
            return np.array([self.ranks[piece]], np.int32)
        n = len(piece)
        nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        rank = self.ranks.get
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or end[j] != stop or rank(piece[i:stop]) != r:
                continue
            alive[j] = False
            end[i] = end[j]
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (q := rank(piece[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (q, i, end[nxt[i]]))
            if prv[i] >= 0 and (q := rank(piece[prv[i] : end[i]])) is not None:
                heapq.heappush(heap, (q, prv[i], end[i]))
        return np.array([rank(piece[i : end[i]]) for i in range(n) if alive[i]], np.int32)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of short pieces, four bytes each: in every round each piece merges its lowest pair."""
        out: list[bytes] = [b""] * len(pieces)
        rest = []
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = r.to_bytes(4, "little")
            elif len(p) > LONG_PIECE:
                out[i] = self.merge_one(p).tobytes()
            else:
                rest.append(i)
        rest.sort(key=lambda i: len(pieces[i]))
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            self._merge_grid(pieces, some, out)
        return out

    def _merge_grid(self, pieces: list[bytes], some: list[int], out: list[bytes]) -> None:
        size = np.fromiter((len(pieces[i]) for i in some), np.int64, len(some))
        width = int(size.max())
        none = 1 << 40
        grid = np.zeros((len(some), width), np.int64)
        grid[np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(pieces[i] for i in some), np.uint8)]
        rows = np.array(some)
        pair = np.full((len(some), width), none, np.int64)
        if width > 1:
            inside = np.arange(1, width) < size[:, None]
            r, c = np.nonzero(inside)
            pair[r, c] = self.pair_rank(grid[r, c], grid[r, c + 1])
        while len(rows):
            best = pair.argmin(1)
            low = pair[np.arange(len(rows)), best]
            done = low >= none
            if done.any():
                final = grid[done].astype(np.int32)
                for i, row, n in zip(rows[done].tolist(), final, size[done].tolist(), strict=True):
                    out[i] = row[:n].tobytes()
                go = ~done
                rows, grid, pair, size, best, low = rows[go], grid[go], pair[go], size[go], best[go], low[go]
                if not len(rows):
                    break
            k = np.arange(len(rows))
            grid[k, best] = low
            # What follows the merged pair moves left by one.
            col = np.arange(width - 1)
            shift = col > best[:, None]
            grid[:, :-1] = np.where(shift, grid[:, 1:], grid[:, :-1])
            moved = np.where(col >= best[:, None], pair[:, 1:], pair[:, :-1])
            pair[:, :-1] = moved
            pair[:, -1] = none
            size = size - 1
            right = best + 1 < size
            pair[k, best] = none
            if right.any():
                q = k[right]
                pair[q, best[right]] = self.pair_rank(grid[q, best[right]], grid[q, best[right] + 1])
            left = best > 0
            if left.any():
                q = k[left]
                pair[q, best[left] - 1] = self.pair_rank(grid[q, best[left] - 1], grid[q, best[left]])
            most = int(size.max())
            if most < width // 2:
                width = most
                grid, pair = grid[:, :width].copy(), pair[:, :width].copy()

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian int32 bytes, through the cache."""
        cache = self.cache
        got = list(map(cache.get, pieces))
        if None in got:
            missing = list({p for p, g in zip(pieces, got, strict=True) if g is None})
            made = dict(zip(missing, self.merge_many(missing), strict=True))
            if len(cache) + len(made) > CACHE_PIECES:
                cache.clear()
            if len(made) <= CACHE_PIECES:
                cache.update({p: v for p, v in made.items() if len(p) <= 256})
            got = [made[p] if g is None else g for p, g in zip(pieces, got, strict=True)]
        return got

    def decode(self, ids: np.ndarray, first: np.ndarray, offsets: np.ndarray) -> bytes:
        """Bytes of ids: piece i has the ids from first[i] on, and its bytes stand at offsets[i] (counted from offsets[0])."""
        n = len(self.bytes_of)
        known = (ids >= 0) & (ids < n)
        own = np.where(known, ids, n)  # an unknown id is empty
        size = self.size_of[own]
        upto = np.r_[0, np.cumsum(size)]
        # Where each id's bytes go: at its piece's offset, after the ids of the piece before it.
        piece = np.searchsorted(first, np.arange(len(ids)), "right") - 1
        to = offsets[piece] - offsets[0] + upto[:-1] - upto[first][piece] if len(ids) else upto[:0]
        out = np.zeros(int((to + size).max(initial=0)), np.uint8)
        step = np.arange(upto[-1]) - np.repeat(upto[:-1], size)
        out[np.repeat(to, size) + step] = self.flat[np.repeat(self.at_of[own], size) + step]
        return out.tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_block(texts: list[str | None], vocab: Vocabulary):
    """For each text: its bytes, its ids (int32 array), and of its pieces the byte offsets and the numbers of their first ids."""
    block = Block(texts)
    starts = piece_starts(block)
    c = block.cps
    width = np.ones(len(c), np.int64)
    width += c >= 0x80
    width += c >= 0x800
    width += c >= 0x10000
    at = np.zeros(len(c) + 1, np.int64)
    np.cumsum(width, out=at[1:])
    raw = "".join(t or "" for t in texts).encode("utf-8", "surrogatepass")
    begin = at[starts]
    cuts = begin.tolist()
    pieces = list(map(raw.__getitem__, map(slice, cuts, [*cuts[1:], len(raw)])))
    got = vocab.ids(pieces)
    number = np.zeros(len(got) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) // 4, out=number[1:])
    ids = np.frombuffer(b"".join(got), np.int32)
    ptr = block.ptr(starts)
    edge = at[block.offs]
    for i in range(block.n):
        a, b = ptr[i], ptr[i + 1]
        yield raw[edge[i] : edge[i + 1]], ids[number[a] : number[b]], begin[a:b] - edge[i], number[a:b] - number[a]


def encode(docs: DataFrame, path: str, id_cols: list[str], text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per row: id_cols, ids array<int>, piece_offsets and piece_ids array<int>, n_tokens.

    A piece's offset is the byte at which it begins, its piece_ids entry the
    number of its first id. With ``digests`` the arrays are replaced by SHA-256
    digests of the joined decimal ids and of the bytes that decoding them at
    their pieces' offsets gives, n_pieces, and whether these are the text's bytes.
    """

    def arrays(texts):
        ids, offs, first, n = [], [], [], []
        for _, own, at, begin in encode_block(texts, vocabulary(path)):
            ids.append(own)
            offs.append(at.astype(np.int32))
            first.append(begin.astype(np.int32))
            n.append(len(own))
        return [pa.array(x, pa.list_(pa.int32())) for x in (ids, offs, first)] + [n]

    def hashed(texts):
        vocab = vocabulary(path)
        n, sha_ids, sha_text, pieces, whole = [], [], [], [], []
        for raw, own, at, begin in encode_block(texts, vocab):
            back = vocab.decode(own, begin, at)
            n.append(len(own))
            sha_ids.append(hashlib.sha256(",".join(map(vocab.text_of.__getitem__, own.tolist())).encode()).hexdigest())
            sha_text.append(hashlib.sha256(back).hexdigest())
            pieces.append(len(at))
            whole.append(back == raw)
        return [n, sha_ids, sha_text, pieces, whole]

    if digests:
        fields = [("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string()), ("n_pieces", "bigint", pa.int64()), ("round_trip", "boolean", pa.bool_())]
        return map_texts(docs, text_col, id_cols, fields, hashed)
    fields = [(name, "array<int>", pa.list_(pa.int32())) for name in ("ids", "piece_offsets", "piece_ids")]
    return map_texts(docs, text_col, id_cols, [*fields, ("n_tokens", "bigint", pa.int64())], arrays)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", offsets_col: str = "piece_offsets", first_col: str = "piece_ids", out: str = "text") -> DataFrame:
    """Adds the text of what ``encode`` returned; invalid UTF-8 becomes U+FFFD; a null array gives null."""
    return decode_span(tokens, path, None, None, ids_col, offsets_col, first_col, out)


def decode_span(tokens: DataFrame, path: str, begin: int | None, end: int | None, ids_col: str = "ids", offsets_col: str = "piece_offsets", first_col: str = "piece_ids", out: str = "text") -> DataFrame:
    """Adds the text of the bytes from ``begin`` up to ``end``; only the pieces that they touch are decoded."""

    @F.pandas_udf("string")
    def back(ids, offsets, first):
        import pandas as pd  # the workers that encode don't need it

        vocab, made = vocabulary(path), []
        for own, at, nth in zip(ids, offsets, first, strict=True):
            if own is None or at is None or nth is None or not len(at):
                made.append(None if own is None or at is None or nth is None else "")
                continue
            a = 0 if begin is None else max(0, int(np.searchsorted(at, begin, "right")) - 1)
            b = len(at) if end is None else max(a, int(np.searchsorted(at, end, "left")))
            if a == b:
                made.append("")
                continue
            some = np.asarray(own)[nth[a] : (nth[b] if b < len(nth) else None)]
            data = vocab.decode(some, np.asarray(nth[a:b], np.int64) - nth[a], np.asarray(at[a:b], np.int64))
            made.append(data[max(0, (begin or 0) - at[a]) : None if end is None else end - at[a]].decode("utf-8", "replace"))
        return pd.Series(made, dtype=object)

    return tokens.withColumn(out, back(F.col(ids_col), F.col(offsets_col), F.col(first_col)))


def op2_byte_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip of every document."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, path, ["doc_id"], digests=True)
