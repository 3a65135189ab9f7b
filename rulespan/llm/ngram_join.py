"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its word n-grams.  Grams are ordered by document
frequency, then by hash.  With o = ceil(t * size), the l-prefix of a set is its
first ``size - o + l`` grams; two sets of Jaccard >= t share at least l grams of
their l-prefixes, for every l <= o.  Each document takes the l from 1 to
``max_match`` with the least estimated cost (postings that it reads, and
candidates that it verifies), probes the l-prefixes of all others and keeps the
partners that share l grams.  Intersections of whole sets decide.

Sets are written as numbers of their shared grams. Prefix grams are read from these files and shuffled as packed arrays, some shards in a pass, to shards by
gram, which are written as postings sorted by gram and size, so that the partners of a gram that are long enough stand in one range. A task takes files of documents, counts the hits
of their prefixes in the mapped postings, and verifies the pairs with enough hits in flat arrays of mapped sets, each
set once for all the documents at hand. A pair is neither shuffled nor written, where only groups and numbers of links are asked for: what leaves a task is the
number of links of each document and a forest that connects its pairs.

All of it is exact, but for chances of 2^-52 and less that two hashes agree: grams
of one document only can't be shared, so they stay in front of the order but
aren't shuffled; a document with fewer than o shared grams has no partner.  Sets are told
apart by 128 bits, rows by 128 bits of doc_id and text.

Defined cases: null and empty texts, and texts without a word, have no grams and
no partner.  A text of fewer than ``n`` words is one gram, so that it meets its
exact copies.  Rows with equal gram sets form a class, which is represented by its least row; rows that are equal in
doc_id and text are members as often as they occur.  A null doc_id counts as the greatest.
Further columns are ignored by the join and returned by ``one_of_each``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulespan.llm import grams as G
from rulespan.llm.arrays import mapped, pack_planes, pack_sorted, save_arrays, unpack_planes, unpack_sorted
from rulespan.llm.text import GRAM_BITS, MAX_DOCS, U, doc_sets, mix, ngrams, pieces, run_lengths, shard_runs, words
from rulespan.shared import drop_mapped, freed_shuffles, read_parquet_dir, remove_dir, shard_count, ship, work_dir

N, THRESHOLD, MAX_MATCH = 3, 0.6, 8
SHARD_BYTES = 16 << 20
FLUSH = 1 << 20
HITS = 1 << 21  # worked on at once
GROUP = 16  # files of sets whose documents are probed together
TASK_FILES = 128  # at most, in one task
INDEX_BYTES = 64 << 20  # of text, to a shard of postings
PASSES, PASS_POSTINGS = 4, 1 << 26  # passes in which postings are shuffled, at most; postings to a pass, at least


def _doc_sets(batch: pa.RecordBatch, n: int):
    w = words(batch.column("text"))
    g, d = ngrams(w.h, w.doc, n, short=True)
    return doc_sets(g, d, w.rows)


def _signatures(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's set."""
    count = np.diff(first)
    sig = np.zeros((2, len(count)), U)
    has = np.flatnonzero(count > 0)
    if len(has):
        a = np.add.reduceat(mix(sets), first[:-1][has])
        b = np.bitwise_xor.reduceat(mix(sets + U(0x51ED270B)), first[:-1][has])
        n = count[has].astype(U)
        sig[0, has] = mix(a ^ mix(b + n)) | U(1)
        sig[1, has] = mix(b * U(0x9E3779B97F4A7C15) + mix(a ^ (n << U(32))))
    return sig[0], sig[1]


def _gather(n: int, shards: int):
    def run(batches):
        gather = G.Gather(shards)
        for batch in batches:
            for b in pieces(batch, "text"):
                gather.add(_doc_sets(b, n)[0])
                if rows := list(gather.rows()):
                    yield G.blob_batch(rows)
        if rows := list(gather.rows(last=True)):
            yield G.blob_batch(rows)

    return run


def _sign(n: int):
    def run(batches):
        for batch in batches:
            for b in pieces(batch, "text"):
                sets, first = _doc_sets(b, n)
                one, two = (pa.array(x.view(np.int64)) for x in _signatures(sets, first))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("uid"), b.column("chk"), one, two, pa.array(np.diff(first).astype(np.int32))], names=["doc_id", "uid", "chk", "sig", "sig2", "size"])

    return run


class Frequencies:
    """Document frequencies of grams that two documents or more have, and their numbers in the order of the grams, from mapped shards.
    base: the first number of each shard, and the count of all."""

    def __init__(self, folder: str, base: np.ndarray):
        self.folder, self.base, self.shards = folder, base, len(base) - 1
        self.kind = np.uint32 if base[-1] < 1 << 32 else U

    def of(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """1 for grams that occur in one document, whose numbers mean nothing. grams: sorted and distinct."""
        out, number = np.ones(len(grams), np.uint32), np.zeros(len(grams), self.kind)
        for shard, part in shard_runs(grams, self.shards):
            if self.base[shard] < self.base[shard + 1]:
                a = mapped(f"{self.folder}/{shard}")
                keys = a["grams"]
                at = np.searchsorted(keys, grams[part])
                at[at == len(keys)] = 0
                hit = keys[at] == grams[part]
                out[part] = np.where(hit, a["df"][at], 1)
                number[part] = self.base[shard] + at
        return out, number


class ByNumber:
    """shard_runs of numbers below total: shards of equally many."""

    def __init__(self, total: int):
        self.total = max(total, 1)

    def lows(self, shards: int) -> np.ndarray:
        """The first number of each shard, and the count of all."""
        return np.arange(shards + 1) * self.total // shards

    def __call__(self, numbers: np.ndarray, shards: int):
        at = np.searchsorted(numbers, self.lows(shards).astype(numbers.dtype))
        for s in np.flatnonzero(at[1:] > at[:-1]).tolist():
            yield s, slice(int(at[s]), int(at[s + 1]))


def choose_match(df_sorted: np.ndarray, lead: int, size: int, need: int, max_match: int) -> int:
    """l of least estimated cost. df_sorted: document frequencies of the shared grams in the
    global order; lead: how many of them a 1-prefix reaches. Postings read are the sum of the
    others' frequencies over the l-prefix; at most a l-th of them can be candidates, and a
    verification reads about as many grams as the set has."""
    best, cost = 1, math.inf
    top = min(max_match, need)
    read = np.cumsum(df_sorted[: lead + top - 1].astype(np.float64) - 1)
    for m in range(1, top + 1):
        at = min(lead + m - 1, len(read))
        postings = read[at - 1] if at > 0 else 0.0
        c = postings + postings / m * (8 + size / 64)
        if c < cost * 0.999:
            best, cost = m, c
    return best


ENTRY_DDL = "shard int, grams binary, loc binary, size binary, lev binary"
ENTRY_NAMES = ["shard", "grams", "loc", "size", "lev"]
ROW_BITS, LOC_BITS = 12, 48  # of loc: the row in a file of sets; the others are the file
LOW = U((1 << ROW_BITS) - 1)
assert MAX_DOCS <= 1 << ROW_BITS and GROUP << ROW_BITS <= 1 << (64 - LOC_BITS)


def _write_sets(n: int, t: float, max_match: int, freq: Frequencies, spare: UidSet, many_rows: UidSet, sets_dir: str):
    """Writes the sets of documents that may have partners, as numbers of their shared grams; prefix: those that the longest prefix has, in the
    global order. Gives the files, and how many prefix grams each has."""

    def run(batches):
        from pyspark import TaskContext

        task, seq, files, many = TaskContext.get().taskAttemptId(), 0, [], []
        for batch in batches:
            for b in pieces(batch, "text"):
                sets, first = _doc_sets(b, n)
                size = np.diff(first)
                uid, chk = (b.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "chk"))
                live = (size > 0) & ~spare.contains(uid, chk)
                if not live.any():
                    continue
                distinct, inverse = np.unique(sets, return_inverse=True)
                df, number = (x[inverse] for x in freq.of(distinct))
                doc = np.repeat(np.arange(len(size)), size)
                shared = (df > 1) & live[doc]
                s, d, f = number[shared], doc[shared], df[shared]
                order = np.lexsort((s, f, d))
                s, d, f = s[order], d[order], f[order]
                begin = np.searchsorted(d, np.arange(len(size) + 1))
                m = np.diff(begin)
                need = np.ceil(t * size - 1e-9).astype(np.int64).clip(1)
                rows = np.flatnonzero(live & (m >= need))
                if not len(rows):
                    continue
                file = (task << 20) | seq
                seq += 1
                wants, keep, ends, prefix, upto = [], [], [0], [], [0]
                for i in rows:
                    a, e = begin[i], begin[i + 1]
                    lead = int(m[i] - need[i] + 1)  # shared grams within the 1-prefix
                    wants.append(choose_match(f[a:e], lead, int(size[i]), int(need[i]), max_match))
                    keep.append(np.sort(s[a:e]))
                    ends.append(ends[-1] + len(keep[-1]))
                    prefix.append(s[a : a + min(lead + max_match - 1, int(m[i]))])
                    upto.append(upto[-1] + len(prefix[-1]))
                files.append(file)
                many.append(upto[-1])
                one, two = _signatures(sets, first)
                copies = np.ones((2, len(size)))  # rows of the class, and those equal to this one
                for pick, x, at in many_rows.found(uid, chk):
                    copies[:, pick] = x["n"][at], x["d"][at]
                ids = pa.BufferOutputStream()
                docs = pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows))], names=["doc_id"])
                with pa.ipc.new_stream(ids, docs.schema) as w:
                    w.write_batch(docs)
                save_arrays(f"{sets_dir}/{file}", {
                    "grams": np.concatenate(keep), "ends": np.array(ends, np.int64), "sizes": size[rows].astype(np.int64), "want": np.array(wants, np.uint8),
                    "prefix": np.concatenate(prefix), "prefix_ends": np.array(upto, np.int64), "rows": copies[0, rows], "part": 1 / copies[1, rows],
                    "sig": one[rows], "sig2": two[rows], "ids": np.frombuffer(ids.getvalue(), np.uint8),
                })
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(many, pa.int64())], names=["file", "many"])

    return run


def lead_of(x: dict[str, np.ndarray], t: float) -> np.ndarray:
    """How many shared grams the 1-prefix of each document in a file of sets has."""
    return np.diff(x["ends"]) - np.ceil(t * x["sizes"] - 1e-9).astype(np.int64).clip(1) + 1


def _postings(sets: Sets, t: float, shards: int, split: ByNumber, lo: int, hi: int):
    """Rows are numbers of files. Gives the prefix grams in shards lo to hi, packed by shard: the document (loc), its size, and the least l
    whose l-prefix has the gram (lev)."""
    low, high = split.lows(shards)[[lo, hi]]

    def run(batches):
        held, many = [], 0

        def flush():
            cols = [np.concatenate(x) for x in zip(*held)]
            order = np.argsort(cols[0])
            gram, loc, size, lev = (x[order] for x in cols)
            rows = [(shard, pack_sorted(gram[p].astype(U)), pack_planes(loc[p]), pack_planes(size[p]), pack_planes(lev[p])) for shard, p in split(gram, shards)]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], names=ENTRY_NAMES)

        for k in sorted(x for b in batches for x in b.column("file").to_pylist()):
            x = mapped(sets.path(k))
            count = np.diff(x["prefix_ends"])
            pick = np.flatnonzero((x["prefix"] >= low) & (x["prefix"] < high))
            row = np.repeat(np.arange(len(count)), count)[pick]
            lev = np.maximum(1, pick - x["prefix_ends"][row] - lead_of(x, t)[row] + 2).astype(np.uint8)
            held.append((x["prefix"][pick], row.astype(U) | U(k << ROW_BITS), x["sizes"][row].astype(np.uint32), lev))
            many += len(pick)
            if many >= FLUSH:
                yield flush()
                held, many = [], 0
        if many:
            yield flush()

    return run


def narrow(x: np.ndarray) -> np.ndarray:
    """Integers from 0 in as few bytes as they need: 2, 4 or 8."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else U)


def index_of(gram, loc, size, lev) -> dict[str, np.ndarray]:
    """The postings of a shard by gram, size and document. grams: distinct; first: where the postings of each begin, and their count."""
    order = np.lexsort((loc, size, gram))
    gram = gram[order]
    new = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    return {"grams": narrow(gram[new]), "first": narrow(np.append(new, len(gram))), "size": narrow(size[order]), "loc": narrow(loc[order]), "lev": lev[order]}


def _index(folder: str):
    """A partition is a shard."""

    def run(batches):
        held, shard = [], None
        for b in batches:
            for at, *row in zip(*(b.column(c).to_pylist() for c in ENTRY_NAMES)):
                shard = at
                held.append((unpack_sorted(row[0]), *(unpack_planes(x, k) for x, k in zip(row[1:], (U, np.uint32, np.uint8)))))
        if held:
            gram, loc, size, lev = (np.concatenate(x) for x in zip(*held))
            del held
            save_arrays(f"{folder}/{shard}", index_of(gram, loc, size, lev))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32())], names=["shard"])

    return run


def search_within(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, side: str) -> np.ndarray:
    """np.searchsorted of each x in a sorted part of its own, values[lo:hi]."""
    lo, hi = lo.copy(), hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        a, z = lo[open_], hi[open_]
        mid = (a + z) >> 1
        up = values[mid] < x[open_] if side == "left" else values[mid] <= x[open_]
        lo[open_], hi[open_] = np.where(up, mid + 1, a), np.where(up, z, mid)
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def stretches(start: np.ndarray, size: np.ndarray):
    """(which, start[which], start[which] + 1, ...) of all runs, HITS at once."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, total, HITS):
        to = min(at + HITS, total)
        x, y = np.searchsorted(ends, [at, to - 1], "right")
        own = np.arange(x, y + 1)
        begin = ends[own] - size[own]
        some = np.minimum(ends[own], to) - np.maximum(begin, at)
        yield np.repeat(own, some), np.arange(to - at) + np.repeat(start[own] + np.maximum(begin, at) - begin - np.cumsum(some) + some, some)


def summed(held) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of (keys, numbers), sorted, and the sums of their numbers."""
    keys, n = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def candidates(part, shards: int, t: float, gram, doc, size, want, own, split=shard_runs):
    """Yields (number of a document, other, hits) of pairs that have the hits that the document wants; the other is shorter, or as long with a
    lower loc. gram, doc: the prefixes, all in the postings; size, want and own (loc) of each document; part(shard): its postings."""
    order = np.argsort(gram, kind="stable")
    gram, doc = gram[order], doc[order]
    least = np.ceil(t * size - 1e-9).astype(np.int64)
    lo, left, hi, shard = np.zeros((4, len(gram)), np.int64)
    for s, p in split(gram, shards):
        x = part(s)
        place = np.searchsorted(x["grams"], gram[p].astype(x["grams"].dtype))
        first, end = (x["first"][place + k].astype(np.int64) for k in (0, 1))
        lo[p] = search_within(x["size"], first, end, least[doc[p]], "left")
        left[p] = search_within(x["size"], lo[p], end, size[doc[p]], "left")
        hi[p] = search_within(x["size"], left[p], end, size[doc[p]], "right")
        shard[p] = s
    total = np.cumsum(np.bincount(doc, hi - lo, len(size)))
    d = 0
    while d < len(size):  # documents of about HITS postings
        e = max(d + 1, int(np.searchsorted(total, (total[d - 1] if d else 0) + HITS, "right")))
        pick = np.flatnonzero((doc >= d) & (doc < e))
        found, held, n = [], [], 0
        for a, z in runs_of(shard[pick]):
            x, q = part(int(shard[pick[a]])), pick[a:z]
            for k, j in stretches(lo[q], hi[q] - lo[q]):
                k = q[k]
                i, loc = doc[k], x["loc"][j]
                ok = (x["lev"][j] <= want[i]) & ((j < left[k]) | (loc < own[i]))
                held.append(i[ok].astype(U) << U(LOC_BITS) | loc[ok])
                n += len(held[-1])
                if n >= HITS:
                    found.append(run_lengths(np.sort(np.concatenate(held))))
                    held, n = [], 0
        if held:
            found.append(run_lengths(np.sort(np.concatenate(held))))
        if found:
            pair, hits = found[0] if len(found) == 1 else summed(found)
            i = (pair >> U(LOC_BITS)).astype(np.int64)
            ok = hits >= want[i]
            yield i[ok], pair[ok] & U((1 << LOC_BITS) - 1), hits[ok]
        d = e


def runs_of(x: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of each run of equal values."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)
    return list(zip(at[:-1].tolist(), at[1:].tolist()))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, on end."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - size - start, size)


@lru_cache(maxsize=1024)
def _ids(path: str) -> pa.Array:
    return pa.ipc.open_stream(pa.py_buffer(mapped(path)["ids"].tobytes())).read_all().column(0).combine_chunks()


def _pair_ddl(kind: str) -> str:
    return f"doc_id_a {kind}, doc_id_b {kind}, shared int, jaccard double, sig_a long, sig2_a long, sig_b long, sig2_b long"


class Sets:
    """The files of sets, by number; a document is told by its loc."""

    def __init__(self, folder: str, files: np.ndarray):
        self.folder, self.files = folder, files

    def path(self, k: int) -> str:
        return f"{self.folder}/{self.files[k]}"

    def of(self, loc: np.ndarray, *columns: str) -> list[np.ndarray]:
        """What the files have of each document, in order."""
        order = np.argsort(loc, kind="stable")
        out: list = [[] for _ in columns]
        for a, z in runs_of(loc[order] >> U(ROW_BITS)):
            at = loc[order[a:z]]
            f, row = mapped(self.path(int(at[0]) >> ROW_BITS)), (at & LOW).astype(np.int64)
            for held, c in zip(out, columns):
                held.append(f[c][row])
        back = np.argsort(order, kind="stable")
        return [np.concatenate(x)[back] for x in out]

    def ids(self, loc: np.ndarray) -> pa.Array:
        order = np.argsort(loc, kind="stable")
        held = [_ids(self.path(int(loc[order[a]]) >> ROW_BITS)).take(pa.array((loc[order[a:z]] & LOW).astype(np.int64))) for a, z in runs_of(loc[order] >> U(ROW_BITS))]
        return pa.concat_arrays(held).take(pa.array(np.argsort(order, kind="stable")))


def verified(sets: Sets, t: float, a: np.ndarray, b: np.ndarray):
    """Yields (a, b, grams shared, Jaccard) of the pairs with Jaccard >= t, of different sets.

    The grams of all documents in a are one sorted list with the documents of each, so that a set of b is looked up once for all of them."""
    used, a = np.unique(a, return_inverse=True)
    grams, who = [], []
    for p, q in runs_of(used >> U(ROW_BITS)):
        f = mapped(sets.path(int(used[p]) >> ROW_BITS))
        row = (used[p:q] & LOW).astype(np.int64)
        size = f["ends"][row + 1] - f["ends"][row]
        grams.append(f["grams"][spread(f["ends"][row], size)])
        who.append(np.repeat(np.arange(p, q), size))
    grams, who = np.concatenate(grams), np.concatenate(who)
    order = np.argsort(grams, kind="stable")
    grams, who = grams[order], who[order]
    at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    keys, many = grams[at], np.diff(np.append(at, len(grams)))
    del grams, order
    sizes, sig, sig2 = sets.of(used, "sizes", "sig", "sig2")
    by = np.argsort(b, kind="stable")
    a, b = a[by], b[by]
    for x, y in runs_of(b >> U(ROW_BITS)):
        f = mapped(sets.path(int(b[x]) >> ROW_BITS))
        row, col = np.unique((b[x:y] & LOW).astype(np.int64), return_inverse=True)
        held = f["ends"][row + 1] - f["ends"][row]
        upto, z = np.cumsum(held), 0
        while z < len(row):  # sets of about HITS / 4 grams
            e = max(z + 1, min(z + max(1, HITS // len(used)), int(np.searchsorted(upto, (upto[z - 1] if z else 0) + HITS // 4, "right"))))
            g = f["grams"][spread(f["ends"][row[z:e]], held[z:e])]
            k = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            hit = keys[k] == g
            k, r = k[hit], np.repeat(np.arange(e - z), held[z:e])[hit]
            n = np.zeros((e - z) * len(used), np.int64)
            for w, j in stretches(at[k], many[k]):
                n += np.bincount(r[w] * len(used) + who[j], minlength=len(n))
            p, q = x + np.searchsorted(col, [z, e])
            own, other = a[p:q], row[col[p - x : q - x]]
            n = n[(col[p - x : q - x] - z) * len(used) + own]
            jaccard = n / (sizes[own] + f["sizes"][other] - n)
            good = np.flatnonzero((jaccard >= t - 1e-12) & ((sig[own] != f["sig"][other]) | (sig2[own] != f["sig2"][other])))
            if len(good):
                yield used[own[good]], b[p:q][good], n[good], jaccard[good]
            z = e


def near(sets: Sets, numbers: list[int], part, shards: int, t: float, split=shard_runs):
    """Yields what verified does, of all pairs whose longer document is in one of the files."""
    for k in range(0, len(numbers), GROUP):
        size, want, own, gram, many = [], [], [], [], []
        for f in numbers[k : k + GROUP]:
            x = mapped(sets.path(f))
            size.append(x["sizes"])
            want.append(x["want"])
            own.append(np.arange(len(x["sizes"]), dtype=U) | U(f << ROW_BITS))
            many.append(np.minimum(lead_of(x, t) + x["want"] - 1, np.diff(x["prefix_ends"])))
            gram.append(x["prefix"][spread(x["prefix_ends"][:-1], many[-1])])
        size, want, own, gram, many = (np.concatenate(v) for v in (size, want, own, gram, many))
        for i, other, _ in candidates(part, shards, t, gram, np.repeat(np.arange(len(size)), many), size, want, own, split):
            if len(i):
                yield from verified(sets, t, own[i], other)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) that connect what the edges (a, b) do: one fewer than there are nodes."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            return nodes[root != np.arange(len(nodes))], nodes[root[root != np.arange(len(nodes))]]
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


FOUND_DDL = "bucket int, a binary, b binary"


def _pack_found(rows):
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "a", "b"])


def _links(sets: Sets, part, shards: int, t: float, buckets: int, split=shard_runs):
    """Rows are numbers of files. Gives, packed, the links of documents by bucket of their file, and a forest of all pairs (bucket -1);
    no pair is sent, so that they don't grow with the pairs."""

    def run(batches):
        numbers = sorted(x for b in batches for x in b.column("file").to_pylist())
        links, edges, n = [], [], 0

        def rows():
            loc, value = summed(links)
            bucket = (mix(loc >> U(ROW_BITS)) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            out = [(int(bucket[order[p]]), pack_sorted(loc[order[p:q]]), value[order[p:q]].tobytes()) for p, q in runs_of(bucket[order])]
            x, y = forest(*map(np.concatenate, zip(*edges)))
            return _pack_found([*out, (-1, pack_sorted(x), pack_planes(y))])

        for a, b, _, _ in near(sets, numbers, part, shards, t, split):
            (rows_a, part_a), (rows_b, part_b) = sets.of(a, "rows", "part"), sets.of(b, "rows", "part")
            links += [(a, rows_b * part_b * part_a), (b, rows_a * part_a * part_b)]
            edges.append((a, b))
            n += len(a)
            if n >= HITS:
                links, edges = [summed(links)], [forest(*map(np.concatenate, zip(*edges)))]
                n = len(links[0][0])
                if n >= HITS // 2:
                    yield rows()
                    links, edges, n = [], [], 0
        if links:
            yield rows()

    return run


def _add_links(sets: Sets):
    """Rows come by bucket."""

    def finish(held):
        loc, value = summed(held)
        return pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in sets.of(loc, "sig", "sig2")), pa.array(value)], names=["sig", "sig2", "links"])

    def run(batches):
        held, last = [], None
        for batch in batches:
            for bucket, a, b in zip(*(batch.column(c).to_pylist() for c in ("bucket", "a", "b"))):
                if bucket != last and held:
                    yield finish(held)
                    held = []
                last = bucket
                held.append((unpack_sorted(a), np.frombuffer(b)))
        if held:
            yield finish(held)

    return run


def _join_forests(batches):
    held, n = [], 0
    give = lambda: pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in forest(*map(np.concatenate, zip(*held)))], names=["a", "b"])
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            held.append((unpack_sorted(a), unpack_planes(b, U)))
            n += len(held[-1][0])
            if n >= 2 * HITS:
                held = [forest(*map(np.concatenate, zip(*held)))]
                n = len(held[0][0])
                if n >= HITS:
                    yield give()
                    held, n = [], 0
    if held:
        yield give()


def _classes(sets: Sets):
    def run(batches):
        for b in batches:
            if b.num_rows:
                loc = b.column("uid").to_numpy(zero_copy_only=False).view(U)
                yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in sets.of(loc, "sig", "sig2")), b.column("root")], names=["sig", "sig2", "root"])

    return run


def _pairs(sets: Sets, part, shards: int, t: float, names: list[str], split=shard_runs):
    def run(batches):
        numbers = sorted(x for b in batches for x in b.column("file").to_pylist())
        for a, b, n, jaccard in near(sets, numbers, part, shards, t, split):
            sig = [pa.array(x.view(np.int64)) for loc in (a, b) for x in sets.of(loc, "sig", "sig2")]
            yield pa.RecordBatch.from_arrays([sets.ids(a), sets.ids(b), pa.array(n.astype(np.int32)), pa.array(jaccard), *sig], names=names)

    return run


class Join:
    """members: doc_id, uid and chk (of the row), sig and sig2 (of its class), size, rep (doc_id, uid, chk of the class's least row),
    first (is this that row), n (rows of the class); alone: the same of rows without a word."""

    def __init__(self, docs: DataFrame, n: int = N, threshold: float = THRESHOLD, max_match: int = MAX_MATCH):
        assert 0 < threshold <= 1 and n >= 1 and 1 <= max_match <= 15
        spark = self.spark = docs.sparkSession
        ship(spark)
        folder = self.dir = work_dir(spark, "jaccard")
        self.t = threshold
        shards, self.shards = shard_count(docs.select("text"), SHARD_BYTES), shard_count(docs.select("text"), INDEX_BYTES)
        base = with_uid(docs)
        kind = self.kind = docs.schema["doc_id"].dataType.simpleString()
        rows = base.mapInArrow(_sign(n), f"doc_id {kind}, uid long, chk long, sig long, sig2 long, size int")
        whole = Window.partitionBy("sig", "sig2", F.when(F.col("size") == 0, F.col("uid")))
        w = whole.orderBy(F.col("doc_id").isNull(), "doc_id", "uid", "chk")
        members = rows.select("*", F.first(F.struct("doc_id", "uid", "chk")).over(w).alias("rep"), (F.row_number().over(w) == 1).alias("first"), F.count("*").over(whole).alias("n"))
        members = read_parquet_dir(spark, members, f"{folder}/members")
        self.members, self.alone = members.filter("size > 0"), members.filter("size = 0")

        def write(shard, keys, df):
            many = df > 1
            if many.any():
                save_arrays(f"{folder}/df/{shard}", {"grams": keys[many], "df": df[many].astype(np.uint32)})
            return {"shard": shard, "many": int(many.sum())}

        done = G.by_shard(base.select("text").mapInArrow(_gather(n, shards), G.BLOB_DDL), shards, write, "shard long, many long").collect()
        counts = np.zeros(shards + 1, np.int64)
        for r in done:
            counts[r.shard + 1] = r.many
        freq = Frequencies(f"{folder}/df", np.cumsum(counts))
        same = (F.col("uid") == F.col("rep.uid")) & (F.col("chk") == F.col("rep.chk"))
        spare = UidSet.of(self.members.filter(~F.col("first") & ~same), f"{folder}/spare")
        many_rows = self.members.filter((F.col("n") > 1) & same).groupBy("uid", "chk").agg(F.max("n").alias("n"), F.count("*").alias("d"))
        many_rows = UidSet.of(many_rows, f"{folder}/rows", "n", "d")
        # A task that runs again names its sets anew: files are those of the tasks whose rows are here.
        done = base.mapInArrow(_write_sets(n, threshold, max_match, freq, spare, many_rows, f"{folder}/sets"), "file long, many long").collect()
        drop_mapped(f"{folder}/df")
        self.same, self.split = same, ByNumber(int(freq.base[-1]))
        self.sets = Sets(f"{folder}/sets", np.array(sorted(r.file for r in done), np.int64))
        passes = max(1, min(PASSES, self.shards, sum(r.many for r in done) // PASS_POSTINGS))
        numbers, *_ = self.probing()
        for k in range(passes):
            lo, hi = (self.shards * x // passes for x in (k, k + 1))
            entries = numbers.mapInArrow(_postings(self.sets, threshold, self.shards, self.split, lo, hi), ENTRY_DDL)
            entries.repartitionById(hi - lo, F.col("shard") - lo).mapInArrow(_index(f"{folder}/index"), "shard int").collect()

    def probing(self) -> tuple[DataFrame, Callable, int, float]:
        """Numbers of files by task, and what near takes."""
        count, folder = len(self.sets.files), f"{self.dir}/index"
        self.tasks = max(1, min(count, max(4 * self.spark.sparkContext.defaultParallelism, count // TASK_FILES)))
        return self.spark.range(0, count, 1, self.tasks).withColumnRenamed("id", "file"), lambda s: mapped(f"{folder}/{s}"), self.shards, self.t

    def pairs(self) -> DataFrame:
        """Pairs of two classes, by their least rows, as _pair_ddl."""
        numbers, *rest = self.probing()
        names = [x.split()[0] for x in _pair_ddl("x").split(", ")]
        pairs = numbers.mapInArrow(_pairs(self.sets, *rest, names, self.split), _pair_ddl(self.kind))
        back = F.col("doc_id_a").isNull() | (F.col("doc_id_b") < F.col("doc_id_a"))
        swap = lambda x, y: F.when(back, F.col(y)).otherwise(F.col(x)).alias(x)
        pairs = pairs.select(swap("doc_id_a", "doc_id_b"), swap("doc_id_b", "doc_id_a"), *names[2:])
        if self.members.filter(~F.col("first") & self.same).limit(1).count():  # least rows that are there twice: each of them is found
            pairs = pairs.select(*names[:4], *(f(F.struct("sig_a", "sig2_a"), F.struct(F.col("sig_b").alias("sig_a"), F.col("sig2_b").alias("sig2_a"))).alias(c) for c, f in (("x", F.least), ("y", F.greatest)))).distinct()
            pairs = pairs.select(*names[:4], F.col("x.sig_a").alias("sig_a"), F.col("x.sig2_a").alias("sig2_a"), F.col("y.sig_a").alias("sig_b"), F.col("y.sig2_a").alias("sig2_b"))
        return read_parquet_dir(self.spark, pairs, f"{self.dir}/pairs")

    def groups(self) -> tuple[DataFrame, DataFrame]:
        """(sig, sig2, links: rows of other classes that are near) and (sig, sig2, root: the same for classes connected by pairs), of classes that have a pair."""
        numbers, *rest = self.probing()
        buckets = min(self.shards, 64)
        found = read_parquet_dir(self.spark, numbers.mapInArrow(_links(self.sets, *rest, buckets, self.split), FOUND_DDL), f"{self.dir}/found")
        drop_mapped(f"{self.dir}/index")
        links = found.filter("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_add_links(self.sets), "sig long, sig2 long, links double")
        links = links.groupBy("sig", "sig2").agg(F.round(F.sum("links")).cast("long").alias("links"))
        links = read_parquet_dir(self.spark, links, f"{self.dir}/links")
        edges = found.filter("bucket < 0").repartition(1 + self.tasks // 64).mapInArrow(_join_forests, "a long, b long")
        edges = read_parquet_dir(self.spark, edges, f"{self.dir}/forest")
        labels = components(edges, f"{self.dir}/groups").mapInArrow(_classes(self.sets), "sig long, sig2 long, root long").distinct()
        labels = read_parquet_dir(self.spark, labels, f"{self.dir}/labels")
        drop_mapped(f"{self.dir}/sets")
        for x in ("found", "forest", "groups"):
            remove_dir(f"{self.dir}/{x}")
        return links, labels

    def least(self, labels: DataFrame) -> DataFrame:
        """sig, sig2, best: of each class that has a pair, the least row (none: has it no doc_id; doc_id, uid, chk) of all that it is connected to."""
        rows = self.members.filter("first").select("sig", "sig2", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid", "chk").alias("row"))
        best = labels.join(rows, ["sig", "sig2"]).groupBy("root").agg(F.min("row").alias("best"))
        return labels.join(best, "root").select("sig", "sig2", "best")


def row_ids(docs: DataFrame):
    """128 bits of doc_id and text."""
    return F.xxhash64(docs["doc_id"], docs["text"]), F.xxhash64(F.lit(7), docs["text"], docs["doc_id"])


def with_uid(docs: DataFrame) -> DataFrame:
    uid, chk = row_ids(docs)
    return docs.select("doc_id", docs["text"].cast("string").alias("text"), uid.alias("uid"), chk.alias("chk"))


class UidSet:
    """Rows by uid and chk, in mapped shards by range of uid. lows: the least uid of each."""

    def __init__(self, lows: np.ndarray, paths: list[str]):
        self.lows, self.paths = lows, paths

    @staticmethod
    def of(rows: DataFrame, path: str, *more: str) -> UidSet:
        """more: columns of integers, one value for each uid and chk."""
        parts = rows.select("uid", "chk", *more).distinct().repartitionByRange(F.col("uid")).sortWithinPartitions("uid", "chk")

        def run(batches):
            from pyspark import TaskContext

            held = [b for b in batches if b.num_rows]
            if held:
                uid, *rest = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("uid", "chk", *more))
                name = f"{path}.{TaskContext.get().partitionId()}"
                save_arrays(name, {"uid": uid} | dict(zip(("chk", *more), rest)))
                yield pa.RecordBatch.from_arrays([pa.array([uid[0]]), pa.array([name])], names=["low", "name"])

        made = sorted((r.low, r.name) for r in parts.mapInArrow(run, "low long, name string").collect())
        return UidSet(np.array([low for low, _ in made], np.int64), [name for _, name in made])

    def __bool__(self) -> bool:
        return bool(self.paths)

    def contains(self, uid: np.ndarray, chk: np.ndarray) -> np.ndarray:
        out = np.zeros(len(uid), bool)
        for pick, _, _ in self.found(uid, chk):
            out[pick] = True
        return out

    def found(self, uid: np.ndarray, chk: np.ndarray):
        """Yields (those of uid and chk that are in the set, a shard, where in it)."""
        last = np.searchsorted(self.lows, uid, "right") - 1
        for s in np.unique(last[last >= 0]).tolist():
            a = mapped(self.paths[s])
            pick = np.flatnonzero(last == s)
            at = np.searchsorted(a["uid"], uid[pick])
            while len(pick):
                on = at < len(a["uid"])
                on[on] = a["uid"][at[on]] == uid[pick[on]]
                pick, at = pick[on], at[on]
                same = a["chk"][at] == chk[pick]
                if same.any():
                    yield pick[same], a, at[same]
                pick, at = pick[~same], at[~same] + 1


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, max_match: int = MAX_MATCH) -> DataFrame:
    """doc_id_a, doc_id_b, jaccard, shared.

    Documents of one gram set are represented by the least doc_id. A row is either such a document and another one of
    its class (jaccard 1, doc_id_a the least), or the least ones of two classes with Jaccard >= threshold, the
    lesser first. So two documents are near duplicates if and only if their least ones are the same or are in a row, and
    the result grows with the copies and not with their square."""
    with freed_shuffles(docs.sparkSession):
        j = Join(docs, n, threshold, max_match)
        pairs = j.pairs()
    copies = j.members.filter("not first").select(F.col("rep.doc_id").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"), F.lit(1.0).alias("jaccard"), F.col("size").alias("shared"))
    return pairs.select("doc_id_a", "doc_id_b", "jaccard", "shared").unionByName(copies)


def groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, max_match: int = MAX_MATCH) -> DataFrame:
    """doc_id, class_id, links: a row for each row of docs.

    links: how many other rows have Jaccard >= threshold with it, copies included; class_id: the least doc_id of all rows that it is connected
    to by links, its own if it has none. So the result grows with the documents, whatever the number of pairs."""
    with freed_shuffles(docs.sparkSession):
        j = Join(docs, n, threshold, max_match)
        links, labels = j.groups()
    key = ["sig", "sig2"]
    found = j.least(labels).join(links, key)
    out = j.members.join(found, key, "left")
    own = F.when(F.col("best").isNull(), F.col("rep.doc_id")).otherwise(F.col("best.doc_id"))
    out = out.select("doc_id", own.alias("class_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    return out.unionByName(j.alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links")))


def components(edges: DataFrame, folder: str) -> DataFrame:
    """uid, root (least uid of its component), for edges (a, b). Labels spread to neighbours and
    jump to their label's label; every round is a table in the shared folder."""
    spark = edges.sparkSession
    both = read_parquet_dir(spark, edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{folder}/edges")
    labels = both.groupBy(F.col("a").alias("uid")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    labels = read_parquet_dir(spark, labels, f"{folder}/labels-0")
    k = 0
    while True:
        k += 1
        spread = both.join(labels.select(F.col("uid").alias("b"), F.col("root").alias("near")), "b").groupBy(F.col("a").alias("uid")).agg(F.min("near").alias("near"))
        step = labels.join(spread, "uid", "left").select("uid", F.least("root", F.coalesce("near", "root")).alias("to"), F.col("root").alias("old"))
        jump = labels.select(F.col("uid").alias("to"), F.col("root").alias("far"))
        step = step.join(jump, "to", "left").select("uid", F.least("to", F.coalesce("far", "to")).alias("root"), "old")
        step = read_parquet_dir(spark, step, f"{folder}/labels-{k}")
        remove_dir(f"{folder}/labels-{k - 1}")
        labels = step.select("uid", "root")
        if step.filter("root != old").limit(1).count() == 0:
            return labels


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, max_match: int = MAX_MATCH) -> DataFrame:
    """docs without near duplicates: of each group (connected by pairs) the row of the least
    (doc_id, id of the row) stays, a null doc_id counting as the greatest; of rows equal in doc_id and text, one.
    Rows without a word stay, all of them. Columns are those of docs."""
    with freed_shuffles(docs.sparkSession):
        j = Join(docs, n, threshold, max_match)
        best = j.least(j.groups()[1]).select("sig", "sig2", F.col("best.uid").alias("best_uid"), F.col("best.chk").alias("best_chk"))
        stays = j.members.select("sig", "sig2", "uid", "chk", "rep", "first").join(best, ["sig", "sig2"], "left")
        same = (F.col("uid") == F.coalesce("best_uid", "rep.uid")) & (F.col("chk") == F.coalesce("best_chk", "rep.chk"))
        drop = UidSet.of(stays.filter(~same), f"{j.dir}/drop")
        twice = UidSet.of(stays.filter(same & ~F.col("first")), f"{j.dir}/twice")
    for x in ("members", "links", "labels"):
        remove_dir(f"{j.dir}/{x}")
    own = ["__uid", "__chk"]
    while set(own) & set(docs.columns):
        own = [c + "_" for c in own]
    marked = docs.withColumns(dict(zip(own, row_ids(docs))))

    def keep(inside: UidSet | None, outside: list[UidSet]):
        def run(batches):
            for b in batches:
                ids = [b.column(b.num_columns - k).to_numpy(zero_copy_only=False) for k in (2, 1)]
                ok = inside.contains(*ids) if inside else np.ones(b.num_rows, bool)
                for x in outside:
                    ok &= ~x.contains(*ids)
                yield b.filter(pa.array(ok))

        return run

    if not drop and not twice:
        return docs
    out = marked.mapInArrow(keep(None, [x for x in (drop, twice) if x]), marked.schema)
    if twice:
        out = out.unionByName(marked.mapInArrow(keep(twice, []), marked.schema).dropDuplicates(own))
    return out.drop(*own)


def _oracle_pairs(documents: str, n: int, threshold: float) -> str:
    """w: words; g: sets; c: classes (k); p: pairs of classes, from all pairs of sets that share a gram."""
    big = "".join(chr(c) for c in [*range(65, 91), *range(0xC0, 0xDF)])
    small = "".join(chr(c) for c in [*range(97, 123), *range(0xE0, 0xFF)])
    return f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, '{big}', '{small}'), '[0-9A-Za-z_\u0080-\U0010FFFF]+') as w from {documents} where text is not null),
g as (
  select doc_id, list_sort(list_distinct(case when len(w) < {n} then [array_to_string(w, ' ')]
         else [array_to_string(w[i : i + {n - 1}], ' ') for i in range(1, len(w) - {n} + 2)] end)) as grams
  from w where len(w) > 0),
c as (select grams, min(doc_id) as rep, count(*) as many, len(grams) as size, row_number() over () as k from g group by grams),
e as (select k, rep, size, unnest(grams) as gram from c),
p as (
  select a.k as ka, b.k as kb, a.rep as ra, b.rep as rb, a.size + b.size - count(*) as whole, count(*) as shared
  from e a join e b on a.gram = b.gram and a.k < b.k group by a.k, b.k, a.rep, b.rep, a.size, b.size
  having count(*) / (a.size + b.size - count(*)) >= {threshold} - 1e-12)"""


def oracle(documents: str = "documents", n: int = N, threshold: float = THRESHOLD) -> str:
    """The rows of near_duplicates. Works on integer doc_ids, each in one row."""
    return f"""{_oracle_pairs(documents, n, threshold)}
select least(ra, rb) as doc_id_a, greatest(ra, rb) as doc_id_b, shared / whole as jaccard, shared::integer as shared from p
union all
select c.rep, g.doc_id, 1.0::double, c.size::integer from g join c on g.grams = c.grams where g.doc_id <> c.rep"""


def oracle_groups(documents: str = "documents", n: int = N, threshold: float = THRESHOLD) -> str:
    """The rows of groups. Works on integer doc_ids, each in one row."""
    return f"""{_oracle_pairs(documents, n, threshold)},
b as (select ka as a, kb as b from p union all select kb, ka from p),
r as (select k as a, k as b from c union select r.a, b.b from r join b on r.b = b.a),
i as (select r.a as k, min(c.rep) as class_id from r join c on r.b = c.k group by r.a),
l as (select b.a as k, sum(c.many) as links from b join c on b.b = c.k group by b.a)
select d.doc_id, coalesce(i.class_id, d.doc_id) as class_id, coalesce(c.many - 1 + coalesce(l.links, 0), 0)::bigint as links
from {documents} d left join g on g.doc_id = d.doc_id left join c on c.grams = g.grams left join i on i.k = c.k left join l on l.k = c.k"""
