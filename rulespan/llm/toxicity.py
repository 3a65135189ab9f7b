"""Toxic spans by a linear-chain conditional random field.

Labels are given by document, the field needs them by token.  A token of a toxic
document is labelled toxic if its word, or a prefix of it of 4 to 8 bytes, is
significantly tied to toxic documents (binomial likelihood ratio against their share, at ``ALPHA``,
over distinct contexts, so that copies of a document don't count again) and nearly absent from clean ones.
The field is trained on these tokens, on a bounded sample of labelled documents:
at most ``max_toxic`` and ``max_clean``, by the order of a hash of doc_id, each by one row, and of these as many as
``max_bytes`` of text hold (texts beyond a sixteenth of that aren't trained on). Windows without an observation that has a weight differ in their length only: those of one
length are one window that counts as many times, so that training costs what the others take.

Observations of a token are its word, its prefixes and the words beside it, as
64-bit hashes in a sorted table of weights; two labels, with learned transitions
and start.  Every document is scored over its whole length by forward-backward
recursions over all documents of a chunk at once.  A span is a longest run of
tokens whose marginal reaches ``threshold``; the score of a document is its
greatest marginal, and a document is toxic if it has a span.

Defined cases: null and empty texts, and texts without a word, score 0; labels
that are null, or of unknown documents, aren't used; a document with both labels is toxic; without toxic labels
nothing is toxic; repeated rows score alike; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulespan.llm.text import U, Words, as_array, flat, mix, pieces, words
from rulespan.shared import ship

MAX_TOXIC, MAX_CLEAN, MAX_BYTES, THRESHOLD = 1500, 3000, 64 << 20, 0.5
ALPHA = 1e-6
PREFIXES = (4, 5, 6, 7, 8)
KINDS = ("word", *PREFIXES, "before", "after")
LUT_BITS = 20
WINDOW = 128
PIECE = 1 << 19  # bytes of text worked on at once in training
BLOCK = 1 << 19  # tokens whose messages are held at once in training


def observations(w: Words):
    """(kind, tokens, hashes) for each kind."""
    yield 0, None, mix(w.h + U(11))
    size = w.end - w.start
    for k, length in enumerate(PREFIXES, 1):
        at = np.flatnonzero(size >= length)
        yield k, at, mix(w.span(w.start[at], w.start[at] + length) + U(1000 + length))
    if len(w.h) > 1:
        same = w.doc[1:] == w.doc[:-1]
        at = np.flatnonzero(same)
        yield len(PREFIXES) + 1, at + 1, mix(w.h[at] + U(2003))
        yield len(PREFIXES) + 2, at, mix(w.h[at + 1] + U(3001))


@dataclass
class Field:
    """keys: sorted observations; weights: of each, for the toxic label; bias; trans[from, to] and start, as logarithms."""

    keys: np.ndarray = field(default_factory=lambda: np.empty(0, U))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    bias: float = -50.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    lut: np.ndarray | None = None

    def __post_init__(self):
        self.lut = np.zeros(1 << LUT_BITS, bool)
        self.lut[(self.keys >> U(64 - LUT_BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of h are in the table, and where."""
        at = np.flatnonzero(self.lut[(h >> U(64 - LUT_BITS)).astype(np.int64)])
        if not len(at):
            return at, at
        i = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[i] == h[at]
        return at[hit], i[hit]

    def emissions(self, w: Words) -> np.ndarray:
        out = np.full(len(w.h), self.bias)
        if len(self.keys):
            for _, tokens, h in observations(w):
                at, i = self.find(h)
                np.add.at(out, at if tokens is None else tokens[at], self.weights[i])
        return out

    def marginals(self, w: Words) -> np.ndarray:
        return chain_marginals(self.emissions(w), w.first, self.trans, self.start)


def chain_marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: float) -> np.ndarray:
    """P(toxic) of each token. Forward and backward messages are ratios of the two labels;
    one step serves all sequences that are long enough."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    top = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(top), "left")  # sequences longer than t
    e = np.exp(np.clip(emit, -60, 60))
    (oo, ot), (to, tt) = np.exp(trans)
    fwd, bwd = np.empty(len(emit)), np.empty(len(emit))
    r = None
    for t in range(top):
        at = begin[: active[t]] + t
        if r is None:
            r = e[at] * np.exp(start)
        else:
            r = r[: active[t]]
            r = e[at] * (r * tt + ot) / (r * to + oo)
        fwd[at] = r
    back = np.ones(active[0] if top else 0)
    for t in range(top - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        m = active[t + 1] if t + 1 < top else 0
        back[m:n] = 1.0  # sequences that end here
        if m:
            x = e[begin[:m] + t + 1] * back[:m]
            back[:m] = (tt * x + to) / (ot * x + oo)
        bwd[at] = back[:n]
    odds = fwd * bwd
    return odds / (1 + odds)


def contexts(w: Words) -> np.ndarray:
    """A hash of the words before and after each word."""
    h, out = w.h, np.zeros(len(w.h), U)
    if len(h) > 1:
        same = w.doc[1:] == w.doc[:-1]
        out[1:][same] = mix(h[:-1][same] + U(5))
        out[:-1][same] ^= mix(h[1:][same] + U(6)) * U(3)
    return out


def association(batch: pa.RecordBatch, toxic: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yields (observations, contexts that each is in, those only of toxic documents), by kind; only one kind is held at once.

    Contexts are counted and not documents, so that copies of a document count once."""
    for kind in range(len(KINDS)):
        hs, cs, bads, base = [], [], [], 0
        for b in pieces(batch, "text", PIECE):
            w = words(b.column("text"))
            for k, tokens, h in observations(w):
                if k == kind:
                    at = slice(None) if tokens is None else tokens
                    hs.append(h)
                    cs.append(contexts(w)[at])
                    bads.append(toxic[base : base + b.num_rows][w.doc[at]].astype(bool))
            base += b.num_rows
        h = np.concatenate(hs) if hs else np.empty(0, U)
        del hs
        c = np.concatenate(cs) if cs else np.empty(0, U)
        del cs
        bad = np.concatenate(bads) if bads else np.empty(0, bool)
        del bads
        if not len(h):
            yield h, np.empty(0, np.int64), np.empty(0, np.int64)
            continue
        order = np.lexsort((c, h))
        h = h[order]
        c = c[order]
        bad = bad[order]
        del order
        pair = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]))
        only = np.logical_and.reduceat(bad, pair).astype(np.int64)
        h = h[pair]
        del c, bad, pair
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        yield h[at], np.diff(np.append(at, len(h))), np.add.reduceat(only, at)


def tied(counts, share: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(observations worth a weight, those significantly tied to toxic documents), by kind, sorted."""
    out = []
    for h, n, t in counts:
        c = n - t
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(t > 0, t * np.log(t / (n * share)), 0) + np.where(c > 0, c * np.log(c / (n * (1 - share))), 0)
        mostly = t >= 0.9 * n
        out.append((h[(t >= 3) & (t >= 0.5 * n)], h[(gain >= np.log(1 / ALPHA)) & mostly]))
    return out


def inside(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), bool)
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


def fit(texts: list[str] | pa.Array, toxic: np.ndarray, steps: int = 80, rate: float = 0.3, l2: float = 1e-3) -> Field:
    """Adam on the log-likelihood of windows of WINDOW tokens, which cover all texts."""
    toxic = np.asarray(toxic, np.int64)
    if not len(texts) or toxic.sum() == 0 or toxic.sum() == len(toxic):
        return Field()
    batch = pa.RecordBatch.from_arrays([texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())], names=["text"])
    counts = association(batch, toxic)
    word = next(counts)
    chosen = tied(chain([word], counts), min(max(word[2].sum() / max(word[1].sum(), 1), 0.01), 0.99))
    del word
    keys = np.unique(np.concatenate([x for x, _ in chosen]))
    model = Field(keys, np.zeros(len(keys)), 0.0)
    hits, labels, starts, n, row = [], [], [], 0, 0  # hits: first token of a piece, tokens, (token, key) pairs
    for b in pieces(batch, "text", PIECE):
        w = words(b.column("text"))
        y = np.zeros(len(w.h), bool)
        bad = toxic[row : row + b.num_rows].astype(bool)
        token, which = [], []
        for k, tokens, h in observations(w):
            at, i = model.find(h)
            token.append((at if tokens is None else tokens[at]).astype(np.int32))
            which.append(i.astype(np.int32))
            if k <= len(PREFIXES):  # words beside it don't make a token toxic
                hit = inside(h, chosen[k][1])
                at = np.flatnonzero(hit) if tokens is None else tokens[hit]
                y[at[bad[w.doc[at]]]] = True
        labels.append(y)
        hits.append((n, len(w.h), np.concatenate(token), np.concatenate(which)))
        count = w.count
        starts += [w.first[:-1][count > k] + k + n for k in range(0, int(count.max(initial=0)), WINDOW)]
        n, row = n + len(w.h), row + b.num_rows
    y = np.concatenate(labels)
    if not y.any():
        return Field()
    starts = np.sort(np.concatenate(starts))
    ends = np.append(starts[1:], n)
    windows = len(starts)
    is_start = np.zeros(n, bool)
    is_start[starts] = True
    ya, yb = y[:-1].astype(np.int64), y[1:].astype(np.int64)
    inner = ~is_start[1:]
    seen = np.bincount((ya * 2 + yb)[inner], minlength=4).reshape(2, 2).astype(float)
    share = y.mean()
    y, first, weight, hits = distinct_windows(y, starts, ends, hits)
    n, starts = len(y), first[:-1]
    token_weight = np.repeat(weight, np.diff(first))
    inner = np.ones(n, bool)
    inner[starts] = False
    inner = inner[1:]
    p = np.zeros(len(keys) + 6)
    p[len(keys)] = np.log((share + 1e-6) / (1 - share))
    m1, m2 = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        weights, bias, trans, start = p[: len(keys)], p[len(keys)], p[len(keys) + 1 : len(keys) + 5].reshape(2, 2), p[-1]
        emit = np.full(n, bias)
        for token, which in hits:
            emit += np.bincount(token, weights[which], n)
        marg, pair = _window_posteriors(emit, first, trans, start, inner, token_weight)
        rest = (y - marg) * token_weight
        by_key = np.zeros(len(keys))
        for token, which in hits:
            by_key += np.bincount(which, rest[token], len(keys))
        g = np.concatenate([by_key, [rest.sum()], (seen - pair).ravel(), [rest[starts].sum()]])
        g -= l2 * windows * 0.01 * p
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        p = p + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    keep = np.abs(p[: len(keys)]) > 1e-3
    return Field(keys[keep], p[: len(keys)][keep], float(p[len(keys)]), p[len(keys) + 1 : len(keys) + 5].reshape(2, 2).copy(), float(p[-1]))


def distinct_windows(y, starts, ends, hits):
    """(labels, firsts, weights, (token, key) pairs): windows with a pair or a toxic label as they are, and of the others one of each length."""
    size, n = ends - starts, len(y)
    busy = np.zeros(n, bool)
    busy[y] = True
    for at, _, token, _ in hits:
        busy[at + token.astype(np.int64)] = True
    own = np.add.reduceat(busy, starts, dtype=np.int64) > 0
    lengths, one, count = np.unique(size[~own], return_index=True, return_counts=True)
    pick = np.concatenate([np.flatnonzero(own), np.flatnonzero(~own)[one]])
    weight = np.concatenate([np.ones(int(own.sum())), count.astype(float)])
    first = np.concatenate([[0], np.cumsum(size[pick])])
    place = np.full(n, -1, np.int32)  # of a token among those that stay
    old = np.repeat(starts[pick] - first[:-1], size[pick]) + np.arange(first[-1])
    place[old] = np.arange(len(old))
    return y[old], first, weight, [(place[at + token.astype(np.int64)], which) for at, _, token, which in hits]


def _window_posteriors(emit, first, trans, start, inner, weight):
    """Marginals, and expected transitions in all, tokens counting by their weight. Windows of about BLOCK tokens at once."""
    marg, pair, w = np.empty(len(emit)), np.zeros((2, 2)), 0
    while w < len(first) - 1:
        to = max(w + 1, int(np.searchsorted(first, first[w] + BLOCK, "right")) - 1)
        a, b = first[w], first[to]
        marg[a:b], more = _block_posteriors(emit[a:b], first[w : to + 1] - a, trans, start, inner[a : b - 1], weight[a:b])
        pair += more
        w = to
    return marg, pair


def _block_posteriors(emit, first, trans, start, inner, weight):
    e = np.exp(np.clip(emit, -60, 60))
    fwd, bwd = _messages(e, first, np.diff(first), trans, start)
    m, pair = np.exp(trans), np.zeros(4)
    for k in range(0, len(inner), 1 << 16):  # P(a, b) of neighbours, from the ratios before and after
        some = slice(k, k + (1 << 16))
        keep = inner[some]
        a, b, w = fwd[:-1][some][keep], (e[1:][some] * bwd[1:][some])[keep], weight[1:][some][keep]
        ab = a * b
        w = w / (m[0, 0] + m[0, 1] * b + m[1, 0] * a + m[1, 1] * ab)
        pair += m.ravel() * np.array([w.sum(), b @ w, a @ w, ab @ w])
    del e
    fwd *= bwd
    bwd = fwd + 1
    return np.divide(fwd, bwd, out=fwd), pair.reshape(2, 2)


def _messages(e, first, size, trans, start):
    """Ratios of the labels before and after each token. The windows stand side by side, long ones first, so that a step is a row."""
    (oo, ot), (to, tt) = np.exp(trans)
    order = np.argsort(-size, kind="stable")
    column = np.empty(len(size), np.int64)
    column[order] = np.arange(len(size))
    place = (np.arange(len(e)) - np.repeat(first[:-1], size)) * len(size) + np.repeat(column, size)
    active = np.searchsorted(-size[order], -np.arange(int(size.max()) + 1), "left")
    table, fwd, bwd = np.ones((len(active) - 1, len(size))), np.ones((len(active) - 1, len(size))), np.ones((len(active) - 1, len(size)))
    table.ravel()[place] = e
    fwd[0] = table[0] * np.exp(start)
    for t in range(1, len(table)):
        r = fwd[t - 1, : active[t]]
        fwd[t, : active[t]] = table[t, : active[t]] * (r * tt + ot) / (r * to + oo)
    for t in range(len(table) - 2, -1, -1):
        x = table[t + 1, : active[t + 1]] * bwd[t + 1, : active[t + 1]]
        bwd[t, : active[t + 1]] = (tt * x + to) / (ot * x + oo)
    return fwd.ravel()[place], bwd.ravel()[place]


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES) -> Field:
    """Ids are sampled from the labels alone, then found in docs by a broadcast of at most max_toxic + max_clean ids."""
    ids = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = None
    for value, most in ((1, max_toxic), (0, max_clean)):
        part = ids.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        sample = part if sample is None else sample.union(part)
    sample = sample.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y"))
    d = docs.select("doc_id", docs["text"].cast("string").alias("text")).filter("text is not null")
    size = F.octet_length("text")
    rows = d.filter(size <= max_bytes // 16).join(F.broadcast(sample), F.col("doc_id") == F.col("id"))
    one = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"), F.max("y").alias("y"))
    rows = one.select("doc_id", "y", F.col("least.text").alias("text"))
    before = F.sum(size).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # of at most max_toxic + max_clean rows
    rows = rows.withColumn("upto", before).filter(F.col("upto") <= max_bytes).select("doc_id", "y", "text").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    text, y = as_array(rows.column("text").cast(pa.large_string())), rows.column("y").to_numpy()
    del rows
    return fit(text, y)


def char_positions(buf: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])


def spans_of(model: Field, batch: pa.RecordBatch, threshold: float):
    """(words, score of each row, spans: row, first and last token + 1, mean marginal)."""
    w = Words(*flat(batch.column("text")))
    p = model.marginals(w)
    score = np.zeros(w.rows)
    has = np.flatnonzero(w.count)
    if len(has):
        score[has] = np.maximum.reduceat(p, w.first[:-1][has])
    hot = p >= threshold
    begin = hot.copy()
    begin[1:] &= ~hot[:-1] | (w.doc[1:] != w.doc[:-1])
    end = hot.copy()
    end[:-1] &= ~hot[1:] | (w.doc[1:] != w.doc[:-1])
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    total = np.concatenate([[0.0], np.cumsum(p)])
    return w, score, (w.doc[a] if len(a) else a, a, b, (total[b] - total[a]) / np.maximum(b - a, 1)), total[w.first[1:]] - total[w.first[:-1]]


SPAN_DDL = "array<struct<start:int,end:int,text:string,score:double>>"


def tag(docs: DataFrame, model: Field, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, expected (number of toxic tokens), toxic, spans (offsets in characters, end excluded): a row for each row of docs."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for b in pieces(batch, "text"):
                w, score, (row, a, z, mean), expected = spans_of(model, b, threshold)
                spans = [[] for _ in range(w.rows)]
                if len(a):
                    chars = char_positions(w.buf)
                    base = chars[w.offs[:-1]]
                    for r, i, j, m in zip(row.tolist(), w.start[a].tolist(), w.end[z - 1].tolist(), mean.tolist()):
                        spans[r].append({"start": int(chars[i] - base[r]), "end": int(chars[j] - base[r]), "text": bytes(w.buf[i:j]).decode("utf-8", "replace"), "score": m})
                span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array(expected), pa.array(score >= threshold), pa.array(spans, span_type)], names=["doc_id", "score", "expected", "toxic", "spans"])

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, expected double, toxic boolean, spans {SPAN_DDL}")


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``tag`` that are toxic, with their offending offsets."""
    return tag(docs, train(docs, labels), threshold).filter("toxic")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without toxic documents; columns are those of docs."""
    ship(docs.sparkSession)
    model = train(docs, labels)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for b in pieces(batch, batch.schema.names[at]):
                text = pa.RecordBatch.from_arrays([b.column(at)], names=["text"])
                yield b.filter(pa.array(spans_of(model, text, threshold)[1] < threshold))

    return docs.mapInArrow(run, docs.schema)
