"""Line deduplication by sharded minimal perfect hashes.

All distinct lines of the corpus, each with its count and first place, go by hash range into shards:
a minimal perfect hash over their 64-bit hashes gives each of them a slot, and arrays by slot hold a
32-bit fingerprint (independent of the hash) and the count; those that occur twice or more have
their first place (doc_id, byte) in further arrays, by their rank among them.  Documents
then probe the mapped arrays; lines are never joined.  Lines are told apart by all 96 bits:
of lines whose hashes agree one has the slot, the others stand in a list beside it.

A line is what stands between newlines, without spaces, tabs and carriage
returns at its ends.  It stays where it first occurs, by (doc_id, place), and
goes everywhere else.  Defined cases: lines of less than ``min_bytes`` bytes
always stay; null and empty texts stay as they are; a document of which only white
space is left goes; a null doc_id counts as the greatest; rows with one doc_id
are one document, so repeated rows keep the same lines.  ``n_chars``, if there
is such a column, follows the text of rows that change; other columns are untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespan.llm.arrays import mapped, save_arrays
from rulespan.llm.text import U, Words, flat, mix, pieces, prefix_hash, span_hash
from rulespan.shared import shard_count, ship, work_dir

MIN_BYTES, MIN_COUNT = 10, 2
SHARD_BYTES = 64 << 20
GAMMA, LEVELS = 2.0, 32
NOT_NL = np.ones(256, bool)
NOT_NL[10] = False
BLANK = np.zeros(256, bool)
BLANK[list(b" \t\r\n")] = True
_FP_TABLE = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)


# --- minimal perfect hash


def _slot_of(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + U(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % U(size)).astype(np.int64)


def mph_build(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Of distinct uint64 keys. On each level, keys alone in their cell set its bit; the
    others go on to the next. A key's slot is the rank of its bit."""
    words, sizes, left = [], [], np.asarray(keys, U)
    while len(left) and len(sizes) < LEVELS:
        size = -(-int(GAMMA * len(left) + 1) // 64) * 64
        at = _slot_of(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view(U))
        sizes.append(size)
        left = left[~alone[at]]
    bits = np.concatenate(words) if words else np.empty(0, U)
    rank = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
    return {"bits": bits, "rank": rank, "sizes": np.array(sizes, np.int64), "left": np.sort(left)}


def mph_slots(m: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key; for a key that isn't there, any slot or -1."""
    out = np.full(len(keys), -1, np.int64)
    todo, base = np.arange(len(keys)), 0
    for level, size in enumerate(m["sizes"].tolist()):
        if not len(todo):
            return out
        at = _slot_of(keys[todo], level, size)
        w = base + (at >> 6)
        word, bit = m["bits"][w], (at & 63).astype(U)
        hit = (word >> bit) & U(1) == 1
        below = np.bitwise_count(word & ((U(1) << bit) - U(1)))
        out[todo[hit]] = (m["rank"][w] + below)[hit]
        todo, base = todo[~hit], base + size // 64
    if len(todo) and len(m["left"]):
        at = np.minimum(np.searchsorted(m["left"], keys[todo]), len(m["left"]) - 1)
        hit = m["left"][at] == keys[todo]
        out[todo[hit]] = m["rank"][-1] + at[hit]
    return out


# --- lines


class Lines(Words):
    """Non-empty lines: start, end of the line; key, fp of what it says; long: counts for deduplication."""

    def __init__(self, column, min_bytes: int):
        buf, offs = flat(column)
        super().__init__(buf, offs, NOT_NL, _FP_TABLE)
        solid = np.flatnonzero(~BLANK[buf])
        a = np.searchsorted(solid, self.start)
        b = np.searchsorted(solid, self.end)
        full = b > a
        solid = np.append(solid, 0)
        s = np.where(full, solid[np.minimum(a, len(solid) - 1)], self.start)
        e = np.where(full, solid[np.maximum(b - 1, 0)] + 1, self.start)
        self.long = full & (e - s >= min_bytes)
        self.fp = (self.span(s, e) >> U(32)).astype(np.uint32)
        self.key = span_hash(prefix_hash(buf), s, e)
        self.at = self.start - offs[self.doc]


def owner_columns(docs: DataFrame):
    """(is null, number) by which documents are ordered."""
    c = docs["doc_id"]
    n = c.cast("long") if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) else F.xxhash64(c)
    return c.isNull(), F.coalesce(n, F.lit(0))


LINE_DDL = "k long, fp long, none boolean, owner long, at long"


def _line_rows(min_bytes: int):
    def run(batches):
        for batch in batches:
            for b in pieces(batch, "text"):
                x = Lines(b.column("text"), min_bytes)
                pick = np.flatnonzero(x.long)
                doc = x.doc[pick]
                none = b.column("none").to_numpy(zero_copy_only=False)[doc]
                owner = b.column("owner").to_numpy(zero_copy_only=False)[doc]
                cols = (x.key[pick].view(np.int64), x.fp[pick].astype(np.int64), none, owner, x.at[pick])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["k", "fp", "none", "owner", "at"])

    return run


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> U(32)) * U(shards)) >> U(32)


def build_index(docs: DataFrame, folder: str, shards: int, min_bytes: int, min_count: int) -> frozenset[int]:
    """Writes the shards; returns those that aren't empty."""
    none, owner = owner_columns(docs)
    lines = docs.select(none.alias("none"), owner.alias("owner"), docs["text"].cast("string").alias("text")).mapInArrow(_line_rows(min_bytes), LINE_DDL)
    counted = lines.groupBy("k", "fp").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("none", "owner", "at")).alias("w"))
    where = F.shiftright(F.shiftrightunsigned("k", 32) * F.lit(shards), 32).cast("int")
    counted = counted.select(where.alias("shard"), "k", "n", "fp", "w.none", "w.owner", "w.at").repartitionById(shards, F.col("shard"))

    def write(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        shard = t.column("shard")[0].as_py()
        save_arrays(f"{folder}/{shard}", shard_arrays({c: t.column(c).to_numpy() for c in ("k", "fp", "n", "none", "owner", "at")}))
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32())], names=["shard"])

    return frozenset(r.shard for r in counted.mapInArrow(write, "shard int").collect())


def shard_arrays(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of distinct lines (k, fp): the minimal perfect hash, fp and n by slot, the first places of the repeated ones,
    and under x.* the lines whose k another one has, sorted by k and fp."""
    order = np.lexsort((c["fp"], c["k"].view(U)))
    c = {name: x[order] for name, x in c.items()} | {"k": c["k"].view(U)[order]}
    other = np.concatenate([[False], c["k"][1:] == c["k"][:-1]])
    extra = {f"x.{name}": x[other] for name, x in c.items()}
    c = {name: x[~other] for name, x in c.items()}
    m = mph_build(c["k"])
    order = np.argsort(mph_slots(m, c["k"]))
    n = np.minimum(c["n"][order], 0xFFFFFFFF).astype(np.uint32)
    again = n >= 2
    bits = np.packbits(np.concatenate([again, np.zeros(-len(again) % 64, bool)]), bitorder="little").view(U)
    rank = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
    places = {name: c[name][order][again] for name in ("none", "owner", "at")}
    return m | {"fp": c["fp"][order].astype(np.uint32), "n": n, "again": bits, "again_rank": rank} | places | extra


def stands_elsewhere(m: dict[str, np.ndarray], key: np.ndarray, fp: np.ndarray, none: np.ndarray, owner: np.ndarray, at: np.ndarray, min_count: int) -> np.ndarray:
    """Of each line: it is there, at least min_count times, and not here for the first time."""
    out = np.zeros(len(key), bool)
    slot = mph_slots(m, key)
    p = np.flatnonzero(slot >= 0)
    p = p[m["fp"][slot[p]] == fp[p]]
    s = slot[p]
    often = m["n"][s] >= max(2, min_count)
    q, s = p[often], s[often]
    bit = (s & 63).astype(U)
    r = m["again_rank"][s >> 6] + np.bitwise_count(m["again"][s >> 6] & ((U(1) << bit) - U(1)))
    out[q] = (m["none"][r] != none[q]) | (m["owner"][r] != owner[q]) | (m["at"][r] != at[q])
    if len(m["x.k"]):
        left = np.ones(len(key), bool)
        left[p] = False
        q = np.flatnonzero(left)
        r = np.searchsorted(m["x.k"], key[q])
        while len(q):
            on = r < len(m["x.k"])
            on[on] = m["x.k"][r[on]] == key[q[on]]
            q, r = q[on], r[on]
            same = m["x.fp"][r] == fp[q]
            a, b = q[same], r[same]
            out[a] = (m["x.n"][b] >= max(2, min_count)) & ((m["x.none"][b] != none[a]) | (m["x.owner"][b] != owner[a]) | (m["x.at"][b] != at[a]))
            q, r = q[~same], r[~same] + 1
    return out


def repeats(folder: str, present: frozenset[int], shards: int, x: Lines, none: np.ndarray, owner: np.ndarray, min_count: int) -> np.ndarray:
    """Of each line: it counts, occurs often enough, and doesn't stand in its first place."""
    gone = np.zeros(len(x.h), bool)
    pick = np.flatnonzero(x.long)
    shard = shard_of(x.key[pick], shards).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    pick, shard = pick[order], shard[order]
    edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(pick) else []
    for a, b in zip(edges[:-1], edges[1:]):
        if int(shard[a]) not in present:
            continue
        p = pick[a:b]
        d = x.doc[p]
        gone[p] = stands_elsewhere(mapped(f"{folder}/{shard[a]}"), x.key[p], x.fp[p], none[d], owner[d], x.at[p], min_count)
    return gone


def without(x: Lines, gone: np.ndarray, null: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """New texts, which rows changed, and which are left with white space only."""
    changed = np.zeros(x.rows, bool)
    changed[x.doc[gone]] = True
    n = len(x.buf)
    step = np.zeros(n + 2, np.int32)
    last = x.offs[1:][x.doc[gone]]
    np.add.at(step, x.start[gone], 1)
    np.add.at(step, np.minimum(x.end[gone] + 1, last), -1)
    keep = np.cumsum(step[:n]) == 0
    final = gone & (x.end == x.offs[1:][x.doc])  # the last line goes, and so does the newline before what is left out
    if final.any():
        left = np.flatnonzero(keep)
        for d in x.doc[final]:
            at = np.searchsorted(left, x.offs[d + 1]) - 1
            if at >= 0 and left[at] >= x.offs[d]:
                keep[left[at]] = False
    total = np.concatenate([[0], np.cumsum(keep)])
    offs = total[x.offs]
    solid = np.concatenate([[0], np.cumsum(keep & ~BLANK[x.buf])])[x.offs]
    blank = changed & (np.diff(solid) == 0)
    out = pa.LargeStringArray.from_buffers(x.rows, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(x.buf[keep]), pa.py_buffer(np.packbits(~null, bitorder="little")))
    return out, changed, blank


def dedup_lines(docs: DataFrame, min_bytes: int = MIN_BYTES, min_count: int = MIN_COUNT) -> DataFrame:
    """docs with every line in its first place only. Columns are those of docs."""
    spark = docs.sparkSession
    ship(spark)
    folder = work_dir(spark, "lines")
    shards = shard_count(docs.select("text"), SHARD_BYTES)
    present = build_index(docs, folder, shards, min_bytes, min_count)
    if not present:
        return docs
    names = docs.columns
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    extra = []
    for want in ("none", "owner"):
        name = f"__{want}"
        while name in names:
            name += "_"
        extra.append(name)
    none_col, owner_col = owner_columns(docs)

    def run(batches):
        for batch in batches:
            for b in pieces(batch, names[text_at]):
                x = Lines(b.column(text_at), min_bytes)
                k = len(names)
                gone = repeats(folder, present, shards, x, b.column(k).to_numpy(zero_copy_only=False), b.column(k + 1).to_numpy(zero_copy_only=False), min_count)
                cols = list(b.columns[:k])
                if gone.any():
                    text, changed, blank = without(x, gone, b.column(text_at).is_null().to_numpy(zero_copy_only=False))
                    cols[text_at] = text.cast(b.column(text_at).type)
                    if chars_at is not None:
                        import pyarrow.compute as pc

                        size = pc.cast(pc.utf8_length(text), cols[chars_at].type)
                        cols[chars_at] = pc.if_else(pa.array(changed), size, cols[chars_at])
                    yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(~blank))
                else:
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.withColumns({extra[0]: none_col, extra[1]: owner_col}).mapInArrow(run, docs.schema)


def oracle(documents: str = "documents", min_bytes: int = MIN_BYTES, min_count: int = MIN_COUNT) -> str:
    trimmed = "trim(line, ' ' || chr(9) || chr(13))"
    return f"""
with split_lines as (
  select doc_id, text, lang, source, n_chars,
         unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as pos
  from {documents} where text is not null),
ranked as (
  select *, strlen({trimmed}) >= {min_bytes} as long,
         rank() over (partition by {trimmed} order by doc_id nulls last, pos) as place,
         count(*) over (partition by {trimmed}) as times
  from split_lines),
kept as (
  select *, not (long and times >= {min_count} and place > 1) as stays from ranked),
joined as (
  select doc_id, any_value(lang) as lang, any_value(source) as source, any_value(n_chars) as n_chars, any_value(text) as old,
         coalesce(string_agg(line, chr(10) order by pos) filter (where stays), '') as text,
         bool_or(not stays) as changed
  from kept group by doc_id)
select doc_id, text, lang, source, case when changed then length(text) else n_chars end as n_chars
from joined where not changed or trim(text, ' ' || chr(9) || chr(13) || chr(10)) <> ''
"""
