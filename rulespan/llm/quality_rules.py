"""Quality rules: decision lists learned from labelled statistics.

Statistics of every document come from one vectorised pass over its bytes.  On
a bounded sample of labelled documents (``max_labelled``, by the order of a hash of doc_id),
sequential covering learns rules for low quality: a rule grows by the threshold
condition of the greatest information gain on two thirds of the rows, is pruned from its end
on the others by (p - n) / (p + n), and is kept while it is right there by ``min_precision``
and covers ``min_cover`` rows; what it covers is taken out, and the next one is learned.
The list comes out as one Spark conditional expression, the first rule that holds
deciding, with high quality as the last resort.

Defined cases: null and empty texts have statistics of 0; null labels and
labels of unknown documents aren't used; a document with both labels is of low quality; without labels of both kinds the list is
empty and everything is kept; repeated rows are judged alike; ties among conditions
go to the first statistic, the lowest threshold, and below it before above it; of prunings of one worth the shortest stays. Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespan.llm.text import U, pieces, words
from rulespan.shared import ship

MAX_LABELLED, MIN_PRECISION, MIN_COVER, MAX_CONDITIONS, MAX_RULES, QUANTILES = 20_000, 0.8, 3, 4, 24, 48
BLOCK = 32
STATS = ("n_words", "mean_word", "distinct_share", "repeat_share", "repeat_block", "upper_share", "upper_block", "sign_share", "sign_block", "digit_share", "mean_line", "alpha_share")


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(chars)] = True
    return m


LOWER, UPPER, DIGIT = _mask(bytes(range(97, 123))), _mask(bytes(range(65, 91))), _mask(b"0123456789")
SIGN, NEWLINE = _mask(b"#$%&*!|~^<>{}[]=+\\@"), _mask(b"\n")


def _running(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x, dtype=np.int64)])


def statistics(column) -> dict[str, np.ndarray]:
    """Of each row. Shares are of words or bytes, blocks the greatest share in 32 words that follow each other."""
    w = words(column)
    n, size = w.count, np.diff(w.offs)
    ratio = lambda a, b: np.divide(a, b, out=np.zeros(len(size)), where=np.asarray(b) > 0)
    rows = lambda flags: np.diff(_running(flags)[w.offs])
    of_words = lambda flags: np.diff(_running(flags)[w.first])
    same = np.zeros(len(w.h), bool)
    same[1:] = (w.h[1:] == w.h[:-1]) & (w.doc[1:] == w.doc[:-1])
    low, up = _running(LOWER[w.buf]), _running(UPPER[w.buf])
    shout = (low[w.end] == low[w.start]) & (up[w.end] - up[w.start] >= 2)
    sign = _running(np.append(SIGN[w.buf], [False, False]))
    end = np.minimum(w.end + 2, w.offs[1:][w.doc]) if len(w.h) else w.end
    marked = sign[end] > sign[w.end]
    per = -(-n // BLOCK)
    base = _running(per)
    block = base[w.doc] + (np.arange(len(w.h)) - w.first[:-1][w.doc]) // BLOCK
    in_block = np.bincount(block, minlength=int(base[-1]))

    def worst(flags):
        out = np.zeros(len(size))
        if base[-1]:
            share = np.bincount(block, weights=flags, minlength=int(base[-1])) / np.maximum(in_block, BLOCK // 4)
            has = np.flatnonzero(per)
            out[has] = np.maximum.reduceat(share, base[:-1][has])
        return out

    key = np.sort((w.doc.astype(U) << U(52)) | (w.h >> U(12)))
    fresh = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
    distinct = np.bincount((key[fresh] >> U(52)).astype(np.int64), minlength=w.rows)
    return {
        "n_words": n.astype(float), "mean_word": ratio(of_words((w.end - w.start).astype(np.int64)), n), "distinct_share": ratio(distinct, n),
        "repeat_share": ratio(of_words(same), n), "repeat_block": worst(same), "upper_share": ratio(of_words(shout), n), "upper_block": worst(shout),
        "sign_share": ratio(of_words(marked), n), "sign_block": worst(marked), "digit_share": ratio(rows(DIGIT[w.buf]), size),
        "mean_line": ratio(n, rows(NEWLINE[w.buf]) + 1), "alpha_share": ratio(rows(LOWER[w.buf] | UPPER[w.buf] | (w.buf >= 128)), size),
    }


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics: a row for each row of docs."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for b in pieces(batch, "text"):
                s = statistics(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(s[c]) for c in STATS)], names=["doc_id", *STATS])

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} double" for c in STATS))


@dataclass(frozen=True)
class Condition:
    stat: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.stat] >= self.threshold if self.above else x[self.stat] < self.threshold

    def column(self) -> Column:
        c = F.col(self.stat)
        return c >= F.lit(self.threshold) if self.above else c < F.lit(self.threshold)


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float = 0.0

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        ok = np.ones(len(next(iter(x.values()))), bool)
        for c in self.conditions:
            ok &= c.holds(x)
        return ok

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out


def thresholds(v: np.ndarray) -> np.ndarray:
    """Middles between neighbouring distinct quantiles."""
    q = np.unique(np.quantile(v, np.linspace(0, 1, QUANTILES + 1)))
    return (q[1:] + q[:-1]) / 2


def grow(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Condition, ...]:
    """Conditions by FOIL gain, until none is wrong or nothing is gained."""
    inside, out = np.ones(len(bad), bool), []
    while len(out) < MAX_CONDITIONS:
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        if p == 0 or n == 0:
            break
        best, gain = None, 1e-9
        before = np.log2(p / (p + n))
        y = bad[inside]
        for s, v in x.items():
            v = v[inside]
            order = np.argsort(v, kind="stable")
            total = np.concatenate([[0], np.cumsum(y[order])])
            for t in thresholds(v):
                k = np.searchsorted(v[order], t, "left")
                for above, pp, all_ in ((False, total[k], k), (True, total[-1] - total[k], len(v) - k)):
                    if pp and (g := pp * (np.log2(pp / all_) - before)) > gain:
                        best, gain = Condition(s, above, float(t)), g
        if best is None:
            break
        out.append(best)
        inside &= best.holds(x)
    return tuple(out)


def prune(conditions: tuple[Condition, ...], x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    best = None
    for k in range(len(conditions), 0, -1):
        hit = Rule(conditions[:k]).holds(x)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if best is None or worth >= best[0]:
            best = (worth, Rule(conditions[:k], p / (p + n) if p + n else 0.0))
    return best[1]


def learn(x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = MIN_PRECISION, min_cover: int = MIN_COVER) -> list[Rule]:
    rules, left = [], np.ones(len(bad), bool)
    part = np.random.default_rng(3).random(len(bad)) < 2 / 3
    while len(rules) < MAX_RULES and (bad & left).sum() >= min_cover:
        a, b = left & part, left & ~part
        take = lambda m: {k: v[m] for k, v in x.items()}
        conditions = grow(take(a), bad[a])
        if not conditions:
            break
        rule = prune(conditions, take(b), bad[b]) if b.any() else Rule(conditions, 1.0)
        hit = rule.holds(x) & left
        if hit.sum() < min_cover or rule.precision < min_precision or (hit & bad).sum() < min_precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Ids come from the labels alone; at most max_labelled of them are broadcast to find the documents."""
    ids = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("q")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    ids = ids.select(F.col("doc_id").alias("id"), F.col("q").cast("int").alias("q"))
    some = docs.select("doc_id", "text").join(F.broadcast(ids.select("id")), F.col("doc_id") == F.col("id"), "left_semi")
    rows = with_statistics(some).join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("id", "q", *STATS).toArrow().sort_by([("id", "ascending"), *((s, "ascending") for s in STATS)])
    bad = rows.column("q").to_numpy() == 0
    if not bad.any() or bad.all():
        return []
    return learn({s: rows.column(s).to_numpy() for s in STATS}, bad)


def expressions(rules: list[Rule]) -> tuple[Column, Column]:
    """(keep, number of the rule that decides, 0 for the last resort), as ordered conditionals over the statistics."""
    if not rules:
        return F.lit(True), F.lit(0)
    keep, which = F.when(rules[0].column(), F.lit(False)), F.when(rules[0].column(), F.lit(1))
    for k, r in enumerate(rules[1:], 2):
        keep, which = keep.when(r.column(), F.lit(False)), which.when(r.column(), F.lit(k))
    return keep.otherwise(F.lit(True)), which.otherwise(F.lit(0))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the statistics, keep and rule: a row for each row of docs."""
    keep, which = expressions(rules)
    return with_statistics(docs).select("doc_id", *STATS, keep.alias("keep"), which.alias("rule"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``judge`` that are kept, by rules learned from labels."""
    return judge(docs, fit(docs, labels)).filter("keep")
