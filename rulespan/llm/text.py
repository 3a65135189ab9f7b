"""Vectorised words, lines and n-grams of Arrow text columns.

A word is a longest run of ASCII letters, digits and underscores and of bytes of
non-ASCII characters; ASCII and Latin-1 letters fold to lower case.  Hashes are polynomials
over bytes, modulo 2^64, read off one prefix sum and then mixed: no work is done
per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
GRAM_BITS = 52
MAX_DOCS = 1 << (64 - GRAM_BITS)
CHUNK_BYTES = (2 << 20) - 4096

_rng = np.random.default_rng(20240607)
_RAW = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_FOLD = _RAW.copy()
_FOLD[ord("A") : ord("Z") + 1] = _RAW[ord("a") : ord("z") + 1]
WORD = np.zeros(256, bool)
WORD[128:] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_":
    WORD[_c] = True
SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\r\x0b\x0c")] = True
_pow = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) <= n:
        m = 1 << int(n).bit_length()
        inv = U(pow(int(BASE), -1, 1 << 64))
        for i, b in ((0, BASE), (1, inv)):
            a = np.full(m, b, U)
            a[0] = 1
            _pow[i] = np.cumprod(a, dtype=U)
    return _pow[0], _pow[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0xFF51AFD7ED558CCD)
    return h ^ (h >> U(32))


def as_array(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts on end, and where each begins; a null is an empty text."""
    a = as_array(column)
    if a.null_count:
        a = pc.fill_null(a, "" if pa.types.is_string(a.type) or pa.types.is_large_string(a.type) else b"")
    kind = np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else np.int32
    bufs = a.buffers()
    if len(a) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(bufs[1], kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def pieces(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` bytes of text (or one text) and MAX_DOCS rows."""
    n = batch.num_rows
    if not n:
        return
    length = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(length, dtype=np.int64)
    at = 0
    while at < n:
        base = end[at - 1] if at else 0
        to = int(np.searchsorted(end, base + most, "right"))
        to = min(max(to, at + 1), at + MAX_DOCS, n)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """h: hash of each word; start, end: its bytes; doc: its row; first: the first word of each row, and the count."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray = WORD, table: np.ndarray = _FOLD):
        n = len(buf)
        self.buf, self.offs, self.rows = buf, offs, len(offs) - 1
        m = is_word[buf]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        begins = m.copy()
        begins[1:] &= ~m[:-1] | edge[1:n]
        ends = m.copy()
        ends[:-1] &= ~m[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.prefix = prefix_hash(folded(buf) if table is _FOLD else buf, table)
        self.h = self.span(self.start, self.end)
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.rows), self.count)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return span_hash(self.prefix, start, end)


def folded(buf: np.ndarray) -> np.ndarray:
    """Latin-1 capitals (C3 80 to C3 9E in UTF-8) as small letters, 20 hex further."""
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    lead = lead[buf[lead + 1] < 0x9F]
    if not len(lead):
        return buf
    buf = buf.copy()
    buf[lead + 1] += 0x20
    return buf


def prefix_hash(buf: np.ndarray, table: np.ndarray = _RAW) -> np.ndarray:
    power, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, U)
    v = table[buf]
    v *= power[: len(buf)]
    np.cumsum(v, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U))


def words(column) -> Words:
    return Words(*flat(column))


_STEP = [U(x | 1) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def ngrams(h: np.ndarray, doc: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each n-gram. short: a row of fewer than n words has one gram of all its words."""
    if n == 1:
        return mix(h + U(n)), doc
    if len(h) < n:
        g, d = np.empty(0, U), np.empty(0, np.int64)
    else:
        m = len(h) - n + 1
        ok = doc[:m] == doc[n - 1 :]
        g = np.full(m, U(n), U)
        for j in range(n):
            g = (g ^ h[j : j + m]) * _STEP[j % 5]
            g ^= g >> U(31)
        g, d = g[ok], doc[:m][ok]
    if short and len(h):
        count = np.bincount(doc)
        few = np.flatnonzero((count > 0) & (count < n))
        if len(few):
            first = np.searchsorted(doc, few)
            s = np.full(len(few), U(n), U)
            for j in range(n - 1):
                has = count[few] > j
                at = np.minimum(first + j, len(h) - 1)
                s = np.where(has, ((s ^ h[at]) * _STEP[j % 5]) ^ (s >> U(31)), s)
            g, d = np.concatenate([g, mix(s)]), np.concatenate([d, few])
    return mix(g), d


def doc_sets(g: np.ndarray, doc: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 52-bit grams of each row, sorted within the row; and where each row begins. One flat sort."""
    assert rows <= MAX_DOCS
    key = np.sort((doc.astype(U) << U(GRAM_BITS)) | (g >> U(64 - GRAM_BITS)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    first = np.searchsorted(key, np.arange(rows + 1, dtype=U) << U(GRAM_BITS)) if rows < MAX_DOCS else np.append(np.searchsorted(key, np.arange(rows, dtype=U) << U(GRAM_BITS)), len(key))
    return key & U((1 << GRAM_BITS) - 1), first


def run_lengths(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return sorted_keys, np.empty(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return sorted_keys[at], np.diff(np.append(at, len(sorted_keys)))


def shard_of(gram: np.ndarray, shards: int) -> np.ndarray:
    """Monotone in the 52-bit gram, so that sorted grams fall into runs."""
    return ((gram >> U(GRAM_BITS - 32)) * U(shards)) >> U(32)


def shard_runs(sorted_grams: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    if not len(sorted_grams):
        return
    s = shard_of(sorted_grams, shards)
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    for a, b in zip(at, np.append(at[1:], len(s))):
        yield int(s[a]), slice(int(a), int(b))
