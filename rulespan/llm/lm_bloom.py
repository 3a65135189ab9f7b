"""Language-model scores from a log-frequency Bloom filter.

All n-grams of orders 1 to 3 of the corpus are counted exactly, in shards by hash
range.  A count c becomes the level q = 1 + floor(log_b c); the shard's Bloom
filter holds (gram, 1) ... (gram, q), and a probe asks for level after level until
one is absent.  The count read back is the middle of the level.  A filter never reads
too low; it reads a level too high with the filter's false-positive rate.

The filters grow with the corpus, whose size no broadcast variable would bear; they are spread to the workers
by files, at every size: those of all shards are put one after the other in segments of about ``SEGMENT_BYTES`` in the shared folder,
which workers map, so that all processes of a machine share the pages that they probe.  What is broadcast is where each shard's filter begins.

A batch has keys in all shards, so that batches which probe read all filters, each of them, and their time grows with the square of the corpus
once the filters are larger than caches and memory.  Texts of the corpus itself don't probe: the task that makes a shard's filter probes it once for each
key, and answers all chunks of texts that have sent it keys. What it answers is gathered to a file for each chunk, under the digest of the chunk's keys. Chunks without such a
file (other texts, or tables that come in another order when read again) probe the segments, with the same levels.

    p(w | u v) = l3 max(c(uvw) - D, 0)/c(uv) + l2 max(c(vw) - D, 0)/c(v) + l1 (c(w) + 1)/(N + V)

The discount D keeps texts apart that the corpus has once and more often: without it an n-gram that only the text
itself has would be certain. What it frees isn't given to other words, so the p of all words sum up to less than 1. The terms have the
weights of missing contexts (starts of texts, and what the corpus doesn't have) in proportion.  Words are those of ``llm.text``.  Defined cases: null and empty texts,
and texts without words, have 0 words, log_prob 0 and a null perplexity; repeated rows are
counted and scored as often as they occur; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.llm import grams as G
from rulespan.llm.arrays import mapped_file, pack_planes, pack_sorted, unpack_sorted
from rulespan.llm.text import GRAM_BITS, U, mix, ngrams, pieces, run_lengths, shard_of, shard_runs, words
from rulespan.shared import open_ranges, remove_dir, shard_count, ship, work_dir, write_file

ORDER = 3
LAMBDAS = (0.2, 0.3, 0.5)
DISCOUNT = 0.75
LOG_BASE = 1.5
BITS_PER_ENTRY, HASHES = 10, 6
SHARD_BYTES, SEGMENT_BYTES = 6 << 20, 1 << 30
PROBE_WORDS = 1 << 19
ANSWER_KEYS = 1 << 20  # worked on at once
TAG = U(3)
KEYS_DDL = "shard int, grams binary, counts binary, chunk string"
ANSWER_DDL = "shard int, chunk string, levels binary, tokens long, vocabulary long, bytes long"


def keys_of(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """52 bits of the gram, of which the lowest two tell its order."""
    return ((ngrams(h, doc, n)[0] >> U(64 - GRAM_BITS)) & ~TAG) | U(n)


def level_of(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(base) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray, base: float) -> np.ndarray:
    """The mean of the whole numbers of a level, or its middle if it has none; 0 for level 0."""
    u, inverse = np.unique(levels, return_inverse=True)
    first = np.ceil(base ** (u - 1.0) - 1e-9)
    last = np.ceil(base ** (u * 1.0) - 1e-9) - 1
    return np.where(u > 0, np.where(last >= first, (first + last) / 2, np.maximum(1.0, base ** (u - 1.0) * (1 + base) / 2)), 0.0)[inverse]


class Probe:
    """Positions of one entry (key, level): a start and a stride, as far as they are needed. size: of the filter, or of each key's."""

    def __init__(self, keys: np.ndarray, level: int, size):
        x = mix(keys * U(0x9E3779B97F4A7C15) + U(level * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        self.a, self.size = x, np.asarray(size, U)
        self.b = (x & U(0xFFFFFFFF)) | U(1)

    def at(self, j: int, pick=slice(None)) -> np.ndarray:
        """Bit positions of hash j: 32 mixed bits times the size; filters have less than 2^32 bits."""
        x = self.a[pick] + U(j) * self.b[pick] * U(0x2545F4914F6CDD1D)
        return ((x >> U(32)) * (self.size[pick] if self.size.ndim else self.size)) >> U(32)


def bloom_build(keys: np.ndarray, levels: np.ndarray, bits: int = BITS_PER_ENTRY, hashes: int = HASHES) -> np.ndarray:
    size = max(64, -(-int(levels.sum()) * bits // 64) * 64)
    flags = np.zeros(size, bool)
    level = 1
    while len(keys):
        p = Probe(keys, level, size)
        for j in range(hashes):
            flags[p.at(j).astype(np.int64)] = True
        more = levels > level
        keys, levels, level = keys[more], levels[more], level + 1
    return np.packbits(flags, bitorder="little")


def bloom_levels(filt: np.ndarray, keys: np.ndarray, hashes: int = HASHES, begin=None, size=None) -> np.ndarray:
    """The level of each key, by repeated probes. begin, size: where each key's filter begins (in bytes) and how many bits it has,
    if there are several."""
    out = np.zeros(len(keys), np.int64)
    live, level = np.arange(len(keys)), 1
    while len(live):
        p = Probe(keys[live], level, len(filt) * 8 if size is None else size[live])
        ok = np.arange(len(live))
        for j in range(hashes):
            at = p.at(j, ok)
            byte = (at >> U(3)).astype(np.int64)
            if begin is not None:
                byte += begin[live[ok]]
            ok = ok[(filt[byte] >> (at & U(7)).astype(np.uint8)) & 1 == 1]
        live = live[ok]
        out[live] = level
        level += 1
    return out


class Model:
    """Counts of grams. segments: the files of filters; segment, begin, bits: of each shard's filter (0 bits: it has none); answers: the folder of levels by chunk."""

    def __init__(self, segments, segment, begin, bits, tokens, vocabulary, base, hashes, answers):
        self.segments, self.segment, self.begin, self.bits = segments, segment, begin, bits
        self.tokens, self.vocabulary, self.base, self.hashes, self.answers = tokens, vocabulary, base, hashes, answers

    def counts(self, keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        k = keys[order]
        new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.empty(0, bool)
        u = k[new]
        level = self.answered(u)
        if level is None:
            level = self.probed(u)
        table = count_of(np.arange(int(level.max(initial=0)) + 1), self.base)
        out = np.empty(len(k))
        out[order] = table[level[np.cumsum(new) - 1]]
        return out

    def answered(self, u: np.ndarray) -> np.ndarray | None:
        """The levels of a chunk's sorted distinct keys, if the chunk is one of the corpus."""
        try:
            with open_ranges(f"{self.answers}/{chunk_name(u)}") as f:
                level = np.frombuffer(zlib.decompress(f.read()), np.uint8)
        except FileNotFoundError:
            return None
        return level if len(level) == len(u) else None

    def probed(self, u: np.ndarray) -> np.ndarray:
        """Each distinct key is probed once."""
        level = np.zeros(len(u), np.int16)
        shard = shard_of(u, len(self.bits)).astype(np.int64)
        u, shard, there = (x[self.bits[shard] > 0] for x in (u, shard, np.arange(len(u))))
        edge = np.searchsorted(self.segment[shard], np.arange(len(self.segments) + 1))  # keys are in the order of the shards
        for s in np.flatnonzero(np.diff(edge)):
            part = slice(edge[s], edge[s + 1])
            level[there[part]] = bloom_levels(mapped_file(self.segments[s]), u[part], self.hashes, self.begin[shard[part]], self.bits[shard[part]])
        return level


def all_keys(w) -> np.ndarray:
    return np.concatenate([keys_of(w.h, w.doc, n) for n in range(1, ORDER + 1)])


def word_scores(w, found: np.ndarray, tokens: int, vocabulary: int, lambdas=LAMBDAS, discount: float = DISCOUNT) -> np.ndarray:
    """log10 p of each word. found: counts of all_keys(w)."""
    n = len(w.h)
    if not n:
        return np.empty(0)
    place = np.arange(n) - w.first[:-1][w.doc]
    at2, at3 = np.flatnonzero(place >= 1), np.flatnonzero(place >= 2)
    c1, c2, c3 = found[:n], np.zeros(n), np.zeros(n)
    c2[at2] = found[n : n + len(at2)]
    c3[at3] = found[n + len(at2) :]
    p1 = (c1 + 1) / (tokens + vocabulary)
    l1, l2, l3 = lambdas
    total, mass = l1 * p1, np.full(n, l1)
    for weight, least, c, context in ((l2, 1, c2, c1), (l3, 2, c3, c2)):
        before = np.concatenate([[0.0], context[:-1]])
        there = (place >= least) & (before > 0)
        total += np.where(there, weight * np.clip((c - discount) / np.maximum(before, 1), 0, 1), 0)
        mass += np.where(there, weight, 0)
    return np.log10(total / mass)


def chunk_name(u: np.ndarray) -> str:
    """128 bits of sorted distinct keys."""
    a, b = mix(u), mix(u ^ U(0x9E3779B97F4A7C15))
    return f"{int(a.sum(dtype=U)):016x}{int(np.bitwise_xor.reduce(b)) ^ len(u):016x}"


def chunks(batches) -> Iterator[list]:
    """(ids, words) of several pieces, PROBE_WORDS and more."""
    held, size = [], 0
    for batch in batches:
        for b in pieces(batch, "text"):
            w = words(b.column("text"))
            w.buf = w.prefix = w.start = w.end = None
            held.append((b.column("doc_id"), w))
            size += len(w.h)
            if size >= PROBE_WORDS:
                yield held
                held, size = [], 0
    if held:
        yield held


def rows_of(docs: DataFrame) -> DataFrame:
    """What is read both for the counts and for the scores, so that chunks are the same."""
    return docs.select("doc_id", docs["text"].cast("string").alias("text"))


def answer_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"shard": pa.int32(), "chunk": pa.string(), "levels": pa.binary(), "tokens": pa.int64(), "vocabulary": pa.int64(), "bytes": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))


def gather_answers(folder: str):
    """Writes the levels of each chunk, in the order of its keys; gives the rows that have none. All rows of a chunk are in one partition."""

    def run(batches):
        held: dict[str, list] = {}
        for b in batches:
            own = b.filter(b.column("chunk").is_valid())
            for shard, chunk, levels in zip(*(own.column(c).to_pylist() for c in ("shard", "chunk", "levels"))):
                held.setdefault(chunk, []).append((shard, levels))
            yield b.filter(b.column("chunk").is_null())
        for chunk, found in held.items():
            parts = dict(found)  # equal chunks have equal answers
            write_file(f"{folder}/{chunk}", zlib.compress(b"".join(zlib.decompress(parts[s]) for s in sorted(parts)), 1))

    return run


def train(docs: DataFrame, base: float = LOG_BASE, bits: int = BITS_PER_ENTRY, hashes: int = HASHES, segment_bytes: int = SEGMENT_BYTES) -> Model:
    spark = docs.sparkSession
    ship(spark)
    folder = work_dir(spark, "lm")
    rows = rows_of(docs)
    shards = shard_count(rows.select("text"), SHARD_BYTES)

    def run(batches):
        for held in chunks(batches):
            keys, counts = run_lengths(np.sort(np.concatenate([all_keys(w) for _, w in held])))
            if len(keys):
                name = chunk_name(keys)
                sent = [(shard, pack_sorted(keys[p]), pack_planes(counts[p].astype(np.uint32)), name) for shard, p in shard_runs(keys, shards)]
                kinds = (pa.int32(), pa.binary(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*sent), kinds)], names=["shard", "grams", "counts", "chunk"])

    def fill(batches):
        """A partition is a shard: its filter, and the levels that the filter has for each chunk's keys."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        shard = held[0].column("shard")[0].as_py()
        grams, counts, names = ([x for b in held for x in b.column(c).to_pylist()] for c in ("grams", "counts", "chunk"))
        del held
        keys, counts = G.merged(grams, counts)
        made = bloom_build(keys, level_of(counts, base), bits, hashes)
        write_file(f"{folder}/filters/{shard}", made.tobytes())
        one = (keys & TAG) == 1
        yield answer_batch([(shard, None, None, int(counts[one].sum()), int(one.sum()), len(made))])
        del counts, one
        levels = np.concatenate([bloom_levels(made, keys[k : k + ANSWER_KEYS], hashes) for k in range(0, len(keys), ANSWER_KEYS)]).astype(np.uint8)
        asked, n = [], 0
        for k, name in enumerate(names):
            asked.append((name, unpack_sorted(grams[k])))
            n += len(asked[-1][1])
            if n >= ANSWER_KEYS or k == len(names) - 1:
                found = levels[np.searchsorted(keys, np.concatenate([x for _, x in asked]))]
                ends = np.cumsum([len(x) for _, x in asked]).tolist()
                yield answer_batch([(shard, c, zlib.compress(found[z - len(x) : z].tobytes(), 1), None, None, None) for (c, x), z in zip(asked, ends)])
                asked, n = [], 0

    sent = rows.mapInArrow(run, KEYS_DDL).repartitionById(shards, F.col("shard")).mapInArrow(fill, ANSWER_DDL)
    done = sent.repartition(shards, "chunk").mapInArrow(gather_answers(f"{folder}/answers"), ANSWER_DDL).select("shard", "tokens", "vocabulary", "bytes").collect()
    size = np.zeros(shards, np.int64)
    size[[r.shard for r in done]] = [r.bytes for r in done]
    before = np.cumsum(size) - size
    segment = before // segment_bytes
    _, segment = np.unique(segment, return_inverse=True)
    begin = before - before[np.searchsorted(segment, segment)]
    paths = join_filters(spark, folder, size, segment)
    remove_dir(f"{folder}/filters")
    return Model(paths, segment, begin, size * 8, sum(r.tokens for r in done), sum(r.vocabulary for r in done), base, hashes, f"{folder}/answers")


def join_filters(spark, folder: str, size: np.ndarray, segment: np.ndarray) -> list[str]:
    """Puts the filters of each segment's shards one after the other in one file, a task each."""
    count = int(segment.max(initial=-1)) + 1

    def run(batches):
        for b in batches:
            for s in b.column("id").to_pylist():
                shards = [k for k in np.flatnonzero(segment == s).tolist() if size[k]]
                if shards:
                    write_file(f"{folder}/segments/{s}", (memoryview(mapped_file(f"{folder}/filters/{k}")) for k in shards))
                yield pa.RecordBatch.from_arrays([pa.array([s])], names=["id"])

    spark.range(0, count, 1, count).mapInArrow(run, "id long").collect()
    return [f"{folder}/segments/{s}" for s in range(count)]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, log_prob (log10, summed), perplexity: a row for each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(held):
        """Levels are looked up for the keys of several pieces at once."""
        keys = [all_keys(w) for w in (x[1] for x in held)]
        found = np.split(model.counts(np.concatenate(keys)), np.cumsum([len(k) for k in keys])[:-1])
        for (ids, w), f in zip(held, found):
            total = np.concatenate([[0.0], np.cumsum(word_scores(w, f, model.tokens, model.vocabulary))])
            total = total[w.first[1:]] - total[w.first[:-1]]
            with np.errstate(divide="ignore", invalid="ignore"):
                ppl = 10 ** (-total / w.count)
            yield pa.RecordBatch.from_arrays([ids, pa.array(w.count.astype(np.int64)), pa.array(total), pa.array(ppl, mask=w.count == 0)], names=["doc_id", "n_words", "log_prob", "perplexity"])

    def run(batches):
        for held in chunks(batches):
            yield from finish(held)

    return rows_of(docs).mapInArrow(run, f"doc_id {kind}, n_words long, log_prob double, perplexity double")


def lm_scores(docs: DataFrame, **options) -> DataFrame:
    """Every document under the model of all documents."""
    return score(docs, train(docs, **options))

