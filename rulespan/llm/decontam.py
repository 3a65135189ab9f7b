"""Benchmark decontamination by latent semantic retrieval.

Terms are all words of the benchmark.  The corpus is cut into passages of ``BLOCK`` words. A is the passages'
TF-IDF matrix over the terms, its columns scaled to about one norm (by the root of the
document frequency), so that its leading singular vectors follow words that keep
company and not words that are frequent.  One pass over all documents gathers the document
frequencies, a second one, for a random matrix O, the products A'(AO) by terms,
from which the driver takes the leading right singular vectors (randomised SVD in its single-pass
form): work of the size terms x rank, whatever the corpus.  Products are blocked: the few terms that at least
``DENSE_SHARE`` of the passages have are multiplied as dense matrices, the others row by row.

A third pass projects windows of WINDOW_BLOCKS blocks, each a block after the
other, takes off the projection of as many words of an average passage, and compares every one with every item by cosine.  A window dilutes short items, so that
the cosine alone misses some; besides, every window is a candidate that can have ``TERM_SHARE`` of an item's content,
found by the words that are rarest in the corpus: nothing that the decision would accept is left out
(prefix filtering).  Candidates are decided by the longest common
subsequence of words, over the window's words and the item's: a leak if it covers ``lcs_share``
of the item; a paraphrase if it covers ``paraphrase_share`` and the answer - the last quarter
of the item, four words at least - is there by ``answer_share``. In either case half of the
item's content must be in the subsequence, so that function words alone never decide: content are the
words that at most ``max_item_share`` of the items have, and all words of an item that has none of those.

Items of more than ITEM_WORDS words are cut into equal parts, each searched as an item;
a leak of a part is one of the item.  The items are held by every worker: more than
``max_items`` rows, or ``max_words`` words, are searched in batches of about so many, all rows of an item in one; what is content is settled over all of them.

Defined cases: null and empty texts and items match nothing; items and documents
may have ids of any type; repeated rows give their rows each; further columns
pass through ``drop_contaminated`` and are ignored elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rulespan.llm.text import U, pieces, run_lengths, words
from rulespan.shared import input_bytes, read_parquet_dir, remove_dir, ship, work_dir

BLOCK, WINDOW_BLOCKS, ITEM_WORDS = 32, 3, 64
RANK, OVERSAMPLE = 256, 32
COSINE, LCS_SHARE, PARAPHRASE_SHARE, ANSWER_SHARE, TERM_SHARE = 0.5, 0.6, 0.45, 0.75, 0.5
MAX_ITEM_SHARE, MAX_ITEMS, MAX_WORDS = 0.1, 200_000, 2_000_000
DENSE_SHARE = 0.04
LUT_BITS = 20
TERM_BLOCK = 128
MORE, POSTINGS = 4, 1 << 20
COSINES, MADE = 1 << 22, 10_000
GROUPS, WINDOWS = 256, 512  # so many rows of a matrix stay in a core's cache


@dataclass
class Parts:
    """item: id of each part; tokens: its word hashes; terms: all words, sorted; content: those that decide; df: passages that have each term."""

    item: list
    tokens: list
    terms: np.ndarray
    content: np.ndarray
    df: np.ndarray | None = None

    def __post_init__(self):
        self.lut = np.zeros(1 << LUT_BITS, bool)
        self.lut[(self.terms >> U(64 - LUT_BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return find(self.terms, self.lut, h)


def find(terms: np.ndarray, lut: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where h has a term, which one)."""
    at = np.flatnonzero(lut[(h >> U(64 - LUT_BITS)).astype(np.int64)])
    if not len(at):
        return at, at
    i = np.minimum(np.searchsorted(terms, h[at]), len(terms) - 1)
    hit = terms[i] == h[at]
    return at[hit], i[hit]


class Prefixes:
    """By each part's rarest content terms: the windows that can have TERM_SHARE of its content positions.

    Of c positions the window must have ``need``; the index holds the rarest terms that take up c - need + more positions or all,
    and a window without ``least`` of those cannot have the share."""

    def __init__(self, parts: Parts, more: int = MORE):
        term, part, weight = [], [], []
        self.least = np.zeros(len(parts.tokens), np.int64)
        df = np.zeros(len(parts.content)) if parts.df is None else parts.df[np.searchsorted(parts.terms, parts.content)]
        rank = np.argsort(np.argsort(df, kind="stable"), kind="stable")
        for k, t in enumerate(parts.tokens):
            i = np.minimum(np.searchsorted(parts.content, t), len(parts.content) - 1)
            i, n = np.unique(i[parts.content[i] == t], return_counts=True)
            order = np.argsort(rank[i])
            i, n = i[order], n[order]
            held, c = np.cumsum(n), int(n.sum())
            need = max(1, math.ceil(TERM_SHARE * c))
            m = int(np.searchsorted(held, min(c, c - need + more))) + 1
            i, n, held = i[:m], n[:m], int(held[m - 1])
            self.least[k] = need - (c - held)
            term.append(i)
            part.append(np.full(len(i), k))
            weight.append(n)
        term, part, weight = (np.concatenate(x) for x in (term, part, weight))
        order = np.argsort(term, kind="stable")
        used, first = np.unique(term[order], return_index=True)
        self.terms, self.first = parts.content[used], np.append(first, len(order))
        self.part, self.weight = part[order], weight[order]
        self.number = np.full(len(parts.terms), -1, np.int32)
        self.number[np.searchsorted(parts.terms, self.terms)] = np.arange(len(used))

    def windows(self, block, i, base) -> tuple[np.ndarray, np.ndarray]:
        """(first block of the window, part) of each candidate, in order. block, i: of the words that are terms, and which ones; base: the first block of each row."""
        i = self.number[i]
        key = unique(block[i >= 0] * len(self.terms) + i[i >= 0])
        block, i = key // max(1, len(self.terms)), key % max(1, len(self.terms))
        many = np.cumsum(self.first[i + 1] - self.first[i])
        got, lo, n = [np.empty(0, np.int64)], 0, len(self.least)
        while len(block) and lo <= block[-1]:  # windows that begin in the blocks lo to hi, of about so many postings
            x = int(np.searchsorted(block, lo))
            y = min(int(np.searchsorted(many, (many[x - 1] if x else 0) + POSTINGS)), len(block) - 1)
            hi = max(lo, int(block[y]))
            x, y = np.searchsorted(block, [lo, hi + WINDOW_BLOCKS])
            got.append(self._pairs(block[x:y], i[x:y], base, n, lo, hi))
            lo = hi + 1
        pairs = np.concatenate(got)
        return pairs // n, pairs % n

    def _pairs(self, block, i, base, n, lo, hi) -> np.ndarray:
        count = self.first[i + 1] - self.first[i]
        at = np.repeat(self.first[i] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        key, weight = self.part[at] + np.repeat(block, count) * n, self.weight[at]
        start = np.repeat(base[np.searchsorted(base, block, "right") - 1], count)
        block = np.repeat(block, count)
        keys, weights = [], []
        for k in range(WINDOW_BLOCKS):
            ok = (block - k >= np.maximum(start, lo)) & (block - k <= hi)
            keys.append(key[ok] - k * n)
            weights.append(weight[ok])
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        return key[np.bincount(inverse, np.concatenate(weights), len(key)) >= self.least[key % n]]


def cut(t: np.ndarray) -> list:
    return np.array_split(t, -(-len(t) // ITEM_WORDS)) if len(t) else []


def item_texts(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", benchmark["text"].cast("string").alias("text")).filter("text is not null")


def read_items(benchmark: DataFrame, max_items: int | None = MAX_ITEMS, max_item_share: float = MAX_ITEM_SHARE, common: np.ndarray | None = None) -> Parts:
    """common: the words that aren't content, where benchmark is a batch of the items."""
    rows = item_texts(benchmark)
    rows = (rows if max_items is None else rows.limit(max_items + 1)).toArrow()
    if max_items is not None and rows.num_rows > max_items:
        raise ValueError(f"more than {max_items} benchmark items: raise max_items, or search in batches")
    item, tokens = [], []
    ids = rows.column("item_id").to_pylist()
    w = words(rows.column("text")) if rows.num_rows else None
    for k, name in enumerate(ids):
        for part in cut(w.h[w.first[k] : w.first[k + 1]]):
            item.append(name)
            tokens.append(part)
    if not tokens:
        return Parts([], [], np.empty(0, U), np.empty(0, U))
    owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    u, inv = np.unique(np.concatenate(tokens), return_inverse=True)
    if common is not None:
        good = ~np.isin(u, common)
        return Parts(item, tokens, u, u[good])
    pairs = np.unique(inv.astype(np.int64) * len(tokens) + owner)
    share = np.bincount(pairs // len(tokens), minlength=len(u))
    good = share <= max(2, max_item_share * len(tokens))
    bare = np.bincount(owner, weights=good[inv], minlength=len(tokens)) == 0
    good[inv[bare[owner]]] = True
    return Parts(item, tokens, u, u[good])


def common_words(benchmark: DataFrame, max_item_share: float = MAX_ITEM_SHARE) -> np.ndarray:
    """The words that read_items leaves out of the content, over any number of items. At most ITEM_WORDS / max_item_share come to the driver."""

    def over_parts(of):
        def run(batches):
            for batch in batches:
                for b in pieces(batch, "text"):
                    w = words(b.column("text"))
                    h, n = of([p for k in range(w.rows) for p in cut(w.h[w.first[k] : w.first[k + 1]])])
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64())], names=["h", "n"])

        return item_texts(benchmark).select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))

    def shares(parts):
        u, n = np.unique(np.concatenate([np.unique(p) for p in parts] or [np.empty(0, U)]), return_counts=True)
        return [None, *u.view(np.int64).tolist()], [len(parts), *n.tolist()]

    counts = over_parts(shares)
    total = counts.filter("h is null").collect()[0].n
    often = np.array([r.h for r in counts.filter(F.col("h").isNotNull() & (F.col("n") > max(2, max_item_share * total))).collect()], np.int64).view(U)

    def bare(parts):
        h = np.unique(np.concatenate([p for p in parts if np.isin(p, often).all()] or [np.empty(0, U)]))
        return h.view(np.int64).tolist(), [1] * len(h)

    return np.setdiff1d(often, np.array([r.h for r in over_parts(bare).collect()], np.int64).view(U))


def item_batches(benchmark: DataFrame, max_items: int, max_words: int = MAX_WORDS):
    """The parts of all items, in batches of about max_items and max_words; an item's rows are in one."""
    size = item_texts(benchmark).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.split("text", r"\W+"))).alias("words")).collect()[0]
    batches = max(-(-size.n // max_items), -(-(size.words or 0) // max_words))
    if batches <= 1:
        yield read_items(benchmark, max_items)
        return
    common = common_words(benchmark)
    for k in range(batches):
        yield read_items(benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == k), None, common=common)


def blocks_of(w, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block of each word in at, first block of each row and the end)."""
    per = -(-w.count // BLOCK)
    base = np.concatenate([[0], np.cumsum(per)])
    d = w.doc[at]
    return base[d] + (at - w.first[:-1][d]) // BLOCK, base


def unique(keys: np.ndarray) -> np.ndarray:
    """Sorted; np.unique hashes integers, which takes some ten times as long."""
    return run_lengths(np.sort(keys))[0]


def add_groups(out: np.ndarray, group: np.ndarray, size: np.ndarray, rows: np.ndarray, pick: np.ndarray) -> None:
    """Adds to out[group[k]] the next size[k] of the rows[pick], one after the other. group: none twice. Groups of about one size are
    taken together, the longest first, and their sums stay in the cache until they are whole."""
    first = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")[: np.count_nonzero(size)]
    taken = np.empty((min(GROUPS, len(order)), out.shape[1]), out.dtype)
    for k in range(0, len(order), GROUPS):
        some = order[k : k + GROUPS]
        at, total = first[some], out[group[some]]
        live = np.searchsorted(-size[some], -np.arange(size[some[0]]), "left").tolist()
        for n, many in enumerate(live):
            np.take(rows, pick[at[:many] + n], axis=0, out=taken[:many], mode="clip")
            total[:many] += taken[:many]
        out[group[some]] = total


def test_matrix(terms: int, width: int) -> np.ndarray:
    return np.random.default_rng(5).standard_normal((terms, width), np.float32)


def summed(rows: DataFrame, kind, source: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the arrays in (k, part, a binary) by k, over two levels, so that no task reads those of all partitions."""
    salts = max(1, int(min(input_bytes(source) >> 25, 1 << 20) ** 0.5))  # of about so many partitions, the root

    def add(key, pdf):
        import pandas as pd

        total = np.zeros(len(pdf["a"].iloc[0]) // np.dtype(kind).itemsize, kind)
        for x in pdf["a"]:
            total += np.frombuffer(x, kind)
        return pd.DataFrame([{"k": int(key[0]), "part": 0, "a": total.tobytes()}])

    ddl = "k long, part long, a binary"
    once = rows.groupBy("k", F.pmod("part", F.lit(salts)).alias("salt")).applyInPandas(add, ddl)
    return {r.k: np.frombuffer(r.a, kind) for r in once.groupBy("k").applyInPandas(add, ddl).collect()}


def part_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def term_frequencies(docs: DataFrame, parts: Parts) -> tuple[np.ndarray, int]:
    """(passages that have each term, passages) over all documents."""
    m = len(parts.terms)

    def run(batches):
        df, n = np.zeros(m, np.int64), 0
        for batch in batches:
            for b in pieces(batch, "text"):
                w = words(b.column("text"))
                at, i = parts.find(w.h)
                block, base = blocks_of(w, at)
                n += int(base[-1])
                df += np.bincount(unique(block * m + i) % m, minlength=m)
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([part_id()]), pa.array([np.append(df, n).tobytes()], pa.binary())], names=["k", "part", "a"])

    text = docs.select(docs["text"].cast("string").alias("text"))
    got = summed(text.mapInArrow(run, "k long, part long, a binary"), np.int64, text)
    return (got[0][:-1], int(got[0][-1])) if got else (np.zeros(m, np.int64), 0)


class Products:
    """Sums of rows of a matrix of terms by blocks, and the transposed product. Terms of ``dense`` are multiplied as a matrix, a row
    of counts for each block; the others are added row by row (add_groups)."""

    def __init__(self, matrix: np.ndarray, dense: np.ndarray):
        self.matrix, self.dense = matrix, np.flatnonzero(dense)
        self.column = np.full(len(matrix), -1, np.int32)
        self.column[self.dense] = np.arange(len(self.dense))

    def of(self, block: np.ndarray, i: np.ndarray):
        """block: ascending. (ids of the blocks, their sums, and what back() needs)."""
        at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        ids = block[at]
        local = np.repeat(np.arange(len(ids)), np.diff(np.append(at, len(block))))
        k = self.column[i]
        often = k >= 0
        counts = np.bincount(local[often] * len(self.dense) + k[often], minlength=len(ids) * len(self.dense)).reshape(len(ids), -1).astype(np.float32) if len(self.dense) else np.zeros((len(ids), 0), np.float32)
        out = counts @ self.matrix[self.dense]
        local, i = local[~often], i[~often]
        add_groups(out, np.arange(len(ids)), np.bincount(local, minlength=len(ids)), self.matrix, i)
        return ids, out, (counts, local, i)

    def back(self, y: np.ndarray, p: np.ndarray, kept) -> None:
        """Adds to y, for each term, the rows p of the blocks that have it."""
        counts, local, i = kept
        y[self.dense] += counts.T @ p
        order = np.argsort(i, kind="stable")
        term, size = run_lengths(i[order])
        add_groups(y, term, size, p, local[order])


def latent_vectors(docs: DataFrame, parts: Parts, rank: int = RANK, oversample: int = OVERSAMPLE) -> tuple[Parts, np.ndarray, np.ndarray, np.ndarray]:
    """The parts with their df; terms x rank: IDF times the right singular vectors of the corpus' matrix; the projection of an
    average passage; and which terms are multiplied as dense ones."""
    df, n = term_frequencies(docs, parts)
    parts = Parts(parts.item, parts.tokens, parts.terms, parts.content, df)
    m = len(parts.terms)
    width = min(rank + oversample, m)
    idf = np.log((1 + n) / (1 + df)) + 1e-3
    scale = (idf / np.sqrt(df + 1)).astype(np.float32)
    dense = df >= max(1, DENSE_SHARE * n)

    def run(batches):
        products = Products(test_matrix(m, width) * scale[:, None], dense)
        y = np.zeros((m, width), np.float32)
        for batch in batches:
            for b in pieces(batch, "text"):
                w = words(b.column("text"))
                at, i = parts.find(w.h)
                if len(at):
                    _, p, kept = products.of(blocks_of(w, at)[0], i)
                    products.back(y, p, kept)
        for k in range(0, m, TERM_BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part_id()]), pa.array([y[k : k + TERM_BLOCK].tobytes()], pa.binary())], names=["k", "part", "a"])

    text = docs.select(docs["text"].cast("string").alias("text"))
    got = summed(text.mapInArrow(run, "k long, part long, a binary"), np.float32, text)
    if not got:
        return parts, np.zeros((m, 1), np.float32), np.zeros(1, np.float32), dense
    y = np.concatenate([got[k].reshape(-1, width) for k in sorted(got)]).astype(np.float64)
    vectors = (idf[:, None] * leading_vectors(y * scale[:, None], test_matrix(m, width), rank)).astype(np.float32)
    return parts, vectors, (df / max(n, 1)).astype(np.float32) @ vectors, dense


def leading_vectors(y: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of a positive semidefinite G, from Y = G O."""
    core = omega.T @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    ok = value > max(value.max(), 0) * 1e-9 if len(value) else value > 0
    if not ok.any():
        return np.zeros((len(y), 1))
    b = y @ (vector[:, ok] / np.sqrt(value[ok]))
    u, s, _ = np.linalg.svd(b, full_matrices=False)
    return u[:, : min(rank, int((s > s[0] * 1e-6).sum()))]


def lcs(masks: dict, full: int, tokens: list) -> int:
    """Bits of the second text that the longest common subsequence takes up."""
    v = full
    for t in tokens:
        if (m := masks.get(t)) is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return full ^ v


def bit_masks(tokens: list) -> dict:
    out: dict = {}
    for k, t in enumerate(tokens):
        out[t] = out.get(t, 0) | 1 << k
    return out


class Matcher:
    def __init__(self, parts: Parts, vectors: np.ndarray, mean: np.ndarray | None = None, dense: np.ndarray | None = None):
        self.parts = parts
        self.products = Products(vectors, np.zeros(len(vectors), bool) if dense is None else dense)
        self.mean = np.zeros(vectors.shape[1], np.float32) if mean is None else mean / BLOCK
        self.made: dict = {}
        q = np.zeros((len(parts.tokens), vectors.shape[1]), np.float32)
        for k, t in enumerate(parts.tokens):
            _, i = parts.find(t)
            q[k] = vectors[i].sum(0) - len(t) * self.mean
        self.queries = unit(q)
        self.prefixes = Prefixes(parts)

    def part(self, k: int) -> tuple[list, dict, set, int]:
        """Words, their masks, content terms and the bits of those, made when they are asked for."""
        if (got := self.made.get(k)) is None:
            if len(self.made) >= MADE:
                self.made.clear()
            t = self.parts.tokens[k]
            terms = np.isin(t, self.parts.content[np.minimum(np.searchsorted(self.parts.content, t), len(self.parts.content) - 1)])
            got = self.made[k] = t.tolist(), bit_masks(t.tolist()), set(t[terms].tolist()), sum(1 << int(i) for i in np.flatnonzero(terms))
        return got

    def possible(self, k: int, window: set) -> bool:
        """Could the subsequence have the share of terms that it needs? (Necessary, and cheaper than the subsequence.)"""
        _, masks, terms, term_bits = self.part(k)
        bits = 0
        for t in terms & window:
            bits |= masks[t]
        return bits.bit_count() >= TERM_SHARE * term_bits.bit_count()

    def verdict(self, k: int, window: list, lcs_share, paraphrase_share, answer_share):
        """(lcs share, answer share) if the window has part k, else None."""
        t, masks, _, term_bits = self.part(k)
        n = len(t)
        bits = lcs(masks, (1 << n) - 1, window)
        share = bits.bit_count() / n
        if share < min(lcs_share, paraphrase_share) or (bits & term_bits).bit_count() < TERM_SHARE * term_bits.bit_count():
            return None
        last = max(4, n // 4)
        tail = t[-last:]
        answer = lcs(bit_masks(tail), (1 << len(tail)) - 1, window).bit_count() / len(tail)
        if share >= lcs_share or answer >= answer_share:
            return share, answer
        return None

    def search(self, batch: pa.RecordBatch, cosine=COSINE, lcs_share=LCS_SHARE, paraphrase_share=PARAPHRASE_SHARE, answer_share=ANSWER_SHARE):
        """{(row, item): (cosine, lcs, answer, first word, end)} of the best window of each."""
        w = words(batch.column("text"))
        found: dict = {}
        at, i = self.parts.find(w.h)
        block, base = blocks_of(w, at)
        exact, part = self.prefixes.windows(block, i, base)
        ids, begin, s = np.empty(0, np.int64), exact, np.empty((0, len(self.mean)), np.float32)
        if len(at):
            ids, s, _ = self.products.of(block, i)
            s = np.concatenate([s, np.zeros((1, s.shape[1]), s.dtype)])  # the last for blocks without terms
            row_of = np.searchsorted(base, ids, "right") - 1
            # windows that begin at most WINDOW_BLOCKS - 1 blocks before a block that has terms
            begin = np.concatenate([exact, *(np.maximum(ids - k, base[row_of]) for k in range(WINDOW_BLOCKS))])
        begin = unique(begin)
        row = np.searchsorted(base, begin, "right") - 1
        size = np.minimum((begin - base[row] + WINDOW_BLOCKS) * BLOCK, w.count[row]) - (begin - base[row]) * BLOCK
        exact = np.searchsorted(begin, exact)
        step = max(1, min(WINDOWS, COSINES // len(self.queries)))
        for a in range(0, len(begin), step):
            total = -(size[a : a + step, None].astype(np.float32) * self.mean)
            for k in range(WINDOW_BLOCKS if len(ids) else 0):
                b = begin[a : a + step] + k
                j = np.minimum(np.searchsorted(ids, b), len(ids) - 1)
                total += np.take(s, np.where((ids[j] == b) & (b < base[row[a : a + step] + 1]), j, len(ids)), axis=0, mode="clip")
            cos = unit(total) @ self.queries.T
            candidate = cos >= cosine
            x, y = np.searchsorted(exact, [a, a + step])
            candidate[exact[x:y] - a, part[x:y]] = True
            last = None
            for x, k in zip(*(i.tolist() for i in np.nonzero(candidate))):
                if x != last:
                    last, r = x, int(row[a + x])
                    first = int(w.first[r] + (begin[a + x] - base[r]) * BLOCK)
                    end = min(first + WINDOW_BLOCKS * BLOCK, int(w.first[r + 1]))
                    window = w.h[first:end].tolist()
                    distinct = set(window)
                if not self.possible(k, distinct):
                    continue
                c = float(cos[x, k])
                v = self.verdict(k, window, lcs_share, paraphrase_share, answer_share)
                key = (r, self.parts.item[k])
                if v and (key not in found or found[key][1:3] < v):
                    found[key] = (c, *v, first, end)
        return w, found


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x * np.divide(1, n, out=np.zeros_like(n), where=n > 1e-12)[:, None]


def matchers(docs: DataFrame, parts: Iterable[Parts], **options) -> Iterator[Matcher]:
    return (Matcher(*latent_vectors(docs, p, **options)) for p in parts if p.tokens)


LEAK_DDL = "cosine double, lcs double, answer double, start int, end int"


def leaks(docs: DataFrame, benchmark: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer, and start and end of the window in characters: a row for each document and item that it has."""
    kind, item = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, item_id {item}, {LEAK_DDL}"
    ship(docs.sparkSession)
    text = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    spark = docs.sparkSession
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    found = [text.mapInArrow(leak_rows(spark.sparkContext.broadcast(m), item_type), ddl) for m in matchers(docs, item_batches(benchmark, max_items))]
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], ddl)


def leak_rows(shared, item_type: pa.DataType):
    def run(batches):
        from rulespan.llm.toxicity import char_positions

        m = shared.value
        for batch in batches:
            for b in pieces(batch, "text"):
                w, found = m.search(b)
                if not found:
                    continue
                chars = char_positions(w.buf)
                keys = sorted(found, key=lambda k: (k[0], str(k[1])))
                rows = np.array([k[0] for k in keys])
                v = [found[k] for k in keys]
                base = chars[w.offs[rows]]
                start = chars[w.start[[x[3] for x in v]]] - base
                end = chars[w.end[[x[4] - 1 for x in v]]] - base
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), pa.array([k[1] for k in keys], item_type), *(pa.array([x[j] for x in v], pa.float64()) for j in range(3)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["doc_id", "item_id", "cosine", "lcs", "answer", "start", "end"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """docs without those that have an item; columns are those of docs."""
    ship(docs.sparkSession)
    at, last = docs.columns.index("text"), None
    for k, parts in enumerate(p for p in item_batches(benchmark, max_items) if p.tokens):
        if k:  # what a batch leaves is written, so that a worker holds one batch at a time
            folder = work_dir(docs.sparkSession, "decontaminated")
            docs = read_parquet_dir(docs.sparkSession, docs, f"{folder}/docs")
            if last:
                remove_dir(last)
            last = folder
        (m,) = matchers(docs, [parts])
        docs = docs.mapInArrow(clean_rows(docs.sparkSession.sparkContext.broadcast(m), at), docs.schema)
    return docs


def clean_rows(shared, at: int):
    def run(batches):
        for batch in batches:
            for b in pieces(batch, batch.schema.names[at]):
                _, found = shared.value.search(pa.RecordBatch.from_arrays([b.column(at)], names=["text"]))
                keep = np.ones(b.num_rows, bool)
                keep[[k[0] for k in found]] = False
                yield b.filter(pa.array(keep))

    return run
