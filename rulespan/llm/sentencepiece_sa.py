"""SentencePiece encoding by suffix-array matching, and decoding.

For byte-pair models with an identity normaliser, a dummy prefix and byte
fallback.  The texts of a batch are concatenated, every word with its space mark, and
a suffix array is built over the whole of it, to the depth that the pieces need;
every piece of the vocabulary is looked up in it by binary search and its range
gives all its occurrences.  These edges are sorted by position and relaxed from left to right.
No piece has a space mark behind another character, so that no path crosses words, and
positions are counted from the beginning of the word: all words are relaxed at once.

With a byte-pair model the best path is not that of the greatest sum of scores; but
the last piece of every prefix is unique: an edge holds if the piece before it and its own
piece stay apart when merged by rank.  Relaxing keeps, for each position, the
one edge that holds, which gives exactly the tokens of the merges.

Runs of space marks, whose pieces all have one score, are merged leftmost first
and looked up by length.  Characters without a piece become bytes.  As in the library,
a space mark in a text is a space.

Defined cases: null and empty texts have no tokens (a null list decodes to null);
repeated rows get equal tokens; further columns pass through.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rulespan.llm.text import Words, flat, pieces
from rulespan.shared import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[32] = False
BATCH_BYTES = 1 << 20
UNSEEN, START, BYTES = -3, -2, -1
_RAW_TABLE = np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64)


class Vocabulary:
    """Pieces in matching order, how they were merged, and which pairs merge."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        text, score = [m.id_to_piece(i) for i in range(n)], [m.get_score(i) for i in range(n)]
        special = [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i) for i in range(n)]
        self.byte_id = np.full(256, m.unk_id(), np.int32)
        for i in range(n):
            if m.is_byte(i):
                self.byte_id[int(text[i][3:5], 16)] = i
        usual = [i for i in range(n) if not special[i]]
        self.runs = {len(text[i]): i for i in usual if set(text[i]) == {MARK}}
        usual = [i for i in usual if len(text[i]) == 1 or set(text[i]) != {MARK}]
        if any(MARK in text[i][1:] for i in usual):
            raise ValueError("the model has pieces across words")
        usual.sort(key=lambda i: (-score[i], i))
        rank = {text[i]: r for r, i in enumerate(usual)}
        if len({score[i] for i in usual if len(text[i]) > 1}) < sum(len(text[i]) > 1 for i in usual):
            raise ValueError("pieces with one score: their order isn't defined")
        self.ids = np.array(usual, np.int32)
        k = len(usual)
        self.rank = np.array([r if len(text[i]) > 1 else -1 for r, i in enumerate(usual)], np.int32)
        self.left, self.right = np.zeros(k, np.int32), np.zeros(k, np.int32)
        reached = np.ones(k, bool)
        for r, i in enumerate(usual):
            if len(text[i]) > 1:
                reached[r], self.left[r], self.right[r] = last_merge(text[i], rank)
        pairs = {}
        for r, i in enumerate(usual):
            t = text[i]
            for c in range(1, len(t)):
                if (a := rank.get(t[:c])) is not None and (b := rank.get(t[c:])) is not None:
                    pairs[a << 20 | b] = r
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[x] for x in sorted(pairs)], np.int32)
        raw = [text[i].encode() for i in usual]
        self.size = np.array([len(x) for x in raw], np.int32)
        self.match = np.flatnonzero(reached & (self.size < 1 << 15))
        self.blocks = -(-int(self.size.max()) // 8)
        low, high = np.zeros((k, self.blocks * 8), np.uint8), np.full((k, self.blocks * 8), 255, np.uint8)
        for r, x in enumerate(raw):
            low[r, : len(x)] = high[r, : len(x)] = np.frombuffer(x, np.uint8)
        self.low, self.high = (x.view(">u8").astype(np.uint64) for x in (low, high))
        long = self.match[self.size[self.match] > 8]
        self.deep = np.unique(self.low[long, 0])  # beginnings of the pieces beyond 8 bytes
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(text[i]) for i in usual if len(text[i]) == 1]] = True
        self.mark = int(rank[MARK])
        # decoding: the bytes of every id
        out = []
        for i in range(n):
            out.append(bytes([int(text[i][3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else " ⁇ ".encode() if m.is_unknown(i) else text[i].replace(MARK, " ").encode())
        self.out_size = np.array([len(x) for x in out], np.int64)
        self.out_start = np.concatenate([[0], np.cumsum(self.out_size)])[:-1]
        self.out = np.frombuffer(b"".join(out), np.uint8)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that a and b make, or a great number."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], 1 << 30)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Do the pieces a and b, side by side, stay as they are?

        Their merges are undone from the last to the first. In between, the pieces beside the
        border could have merged across it before the merge undone last took one of them
        away: by a lower rank, or by the same on its left side."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), 1 << 30)
        a, b = a.copy(), b.copy()
        while len(live):
            cross = self.pair(a, b) < limit
            ok[live[cross]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~cross & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            undo_a = ra > rb
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok


def last_merge(text: str, rank: dict) -> tuple[bool, int, int]:
    """(the merges of text end in one piece, its two halves)."""
    s = list(text)
    while len(s) > 2:
        best = min(((rank[x + y], k) for k, (x, y) in enumerate(zip(s, s[1:])) if x + y in rank), default=None)
        if best is None:
            return False, 0, 0
        k = best[1]
        s[k : k + 2] = [s[k] + s[k + 1]]
    ok = len(s) == 2 and s[0] in rank and s[1] in rank
    return (True, rank[s[0]], rank[s[1]]) if ok else (False, 0, 0)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


# --- suffix array


def windows8(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number, zeros behind the end."""
    p = np.concatenate([t, np.zeros(8, np.uint8)])
    out = np.zeros(len(t), np.uint64)
    for j in range(8):
        out = out << np.uint64(8) | p[j : j + len(t)]
    return out


def suffix_array(t: np.ndarray, deep: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first 8 bytes, and those that begin with one of ``deep``
    (sorted beginnings of 8 bytes) in that of their first 8 * blocks; and the windows. No longer piece begins with other bytes."""
    key = windows8(t)
    order = np.argsort(key).astype(np.int32)
    if blocks > 1 and len(deep):
        sorted_key = key[order]
        lo, hi = np.searchsorted(sorted_key, deep, "left"), np.searchsorted(sorted_key, deep, "right")
        lo, size = lo[hi - lo > 1], (hi - lo)[hi - lo > 1]
        at, group = spread(lo, size), np.repeat(np.arange(len(lo)), size)
        padded = np.concatenate([key, np.zeros(8 * blocks, np.uint64)])
        some = order[at]
        by = np.lexsort([padded[some + 8 * j] for j in range(blocks - 1, 0, -1)] + [group])
        order[at] = some[by]
    return order, key


def find_pieces(v: Vocabulary, order: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, from, to): the range of suffixes that begin with each piece that occurs."""
    n = len(order)
    p = v.match
    sorted_key = key[order]
    lo, hi = np.searchsorted(sorted_key, v.low[p, 0], "left"), np.searchsorted(sorted_key, v.high[p, 0], "right")
    padded = np.concatenate([key, np.zeros(8 * v.blocks, np.uint64)])
    for j in range(1, v.blocks):
        more = np.flatnonzero((v.size[p] > 8 * j) & (hi > lo))
        if not len(more):
            break
        for side, bound in (("left", v.low), ("right", v.high)):
            want = bound[p[more], j]
            a, b = lo[more].copy(), hi[more].copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                x = padded[order[np.minimum(mid, n - 1)].astype(np.int64) + 8 * j]
                right = open_ & ((x < want) if side == "left" else (x <= want))
                a = np.where(right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            if side == "left":
                first = a
            else:
                last = a
        lo[more], hi[more] = first, last
    has = hi > lo
    return p[has], lo[has], hi[has]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, on end."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - size - start, size)


class Encoder:
    """memo: pairs of pieces that were found to stay apart, or not."""

    MEMO_BITS = 20

    def __init__(self, v: Vocabulary):
        self.v, self.run_made = v, {}
        self.memo_key = np.full(1 << self.MEMO_BITS, -1, np.int64)
        self.memo_ok = np.zeros(1 << self.MEMO_BITS, bool)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.MEMO_BITS)).astype(np.int32)
        ok = self.memo_ok[slot]
        new = np.flatnonzero(self.memo_key[slot] != key)
        if len(new):
            u, at, inv = np.unique(key[new], return_index=True, return_inverse=True)
            r = self.v.apart(a[new[at]], b[new[at]])
            ok[new] = r[inv]
            self.memo_key[slot[new]], self.memo_ok[slot[new]] = key[new], ok[new]
            # two keys may share a slot within one call: what stays must belong together
            s = slot[new[at]]
            self.memo_key[s], self.memo_ok[s] = u, r
        return ok

    def runs(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of runs of space marks, each distinct length once: (tokens, start of each run, size of each)."""
        u, which = np.unique(lengths, return_inverse=True)
        made = []
        for n in u.tolist():
            if n not in self.run_made:
                if len(self.run_made) >= 4096:
                    self.run_made.clear()
                self.run_made[n] = np.array(run_tokens(n, self.v) if n else [], np.int32)
            made.append(self.run_made[n])
        size = np.array([len(x) for x in made], np.int64)
        return np.concatenate([np.empty(0, np.int32), *made]), (np.cumsum(size) - size)[which], size[which]

    def word_tokens(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words (each with a mark before it) on end, and how many each has."""
        v = self.v
        words = len(start)
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        count = (end - start).astype(np.int32)
        first = np.concatenate([[0], np.cumsum(count + 3)]).astype(np.int32)
        t = np.empty(first[-1], np.uint8)
        for j, c in enumerate(MARK.encode()):
            t[first[:-1] + j] = c
        t[spread(first[:-1] + 3, count)] = buf[spread(start, count)]
        word_of = np.repeat(np.arange(words, dtype=np.int32), count + 3)
        # edges: all occurrences of all pieces
        order, key = suffix_array(t, v.deep, v.blocks)
        p, lo, hi = find_pieces(v, order, key)
        del key
        piece = np.repeat(p.astype(np.int32), hi - lo)
        at = order[spread(lo, hi - lo)]
        del order
        # characters without a piece: an edge of bytes
        lead = np.flatnonzero((t & 0xC0) != 0x80).astype(np.int32)
        size = np.diff(np.append(lead, len(t)))
        unknown = ~v.known[t[lead]]
        wide = np.flatnonzero(size > 1)
        unknown[wide] = ~v.known[code_points(t, lead[wide], size[wide])]
        odd, odd_size = lead[unknown], size[unknown]
        del lead, size
        length = np.concatenate([v.size[piece], odd_size.astype(np.int32)])
        at, piece = np.concatenate([at, odd]), np.concatenate([piece, np.full(len(odd), BYTES, np.int32)])
        offset = at - first[word_of[at]] + length
        by = np.argsort(offset.astype(np.uint16) if offset.max() < 1 << 16 else offset, kind="stable")
        at, piece, length, offset = at[by], piece[by], length[by], offset[by]
        edges = np.flatnonzero(np.concatenate([[True], offset[1:] != offset[:-1], [True]]))
        del by, offset
        # a node for each position and one for the end of each word
        last, back = np.full(len(t) + words, UNSEEN, np.int32), np.zeros(len(t) + words, np.int32)
        last[first[:-1] + np.arange(words)] = START
        node = at + word_of[at]
        for a, b in zip(edges[:-1], edges[1:]):
            s, q = node[a:b], piece[a:b]
            before = last[s]
            ok = before > UNSEEN
            test = np.flatnonzero((before >= 0) & (q >= 0))
            ok[test] = self.apart(before[test], q[test])
            s = s[ok]
            e = s + length[a:b][ok]
            last[e], back[e] = q[ok], s
        del at, piece, length, node
        # back from the ends: the nodes on the paths
        begin = first[:-1] + np.arange(words, dtype=np.int32)
        on = np.zeros(len(t) + words, bool)
        at_word, now = np.arange(words), first[1:] + np.arange(words, dtype=np.int32)
        while len(now):
            on[now] = True
            now = back[now]
            go = now > begin[at_word]
            at_word, now = at_word[go], now[go]
        nodes = np.flatnonzero(on)
        w = np.searchsorted(nodes, begin + 1)  # the first node of each word's path
        q, s = last[nodes], back[nodes]
        assert (q > START).all(), "a word has no path"
        size = np.where(q >= 0, 1, nodes - s)
        tokens = np.repeat(np.where(q >= 0, v.ids[q], 0), size)
        raw = np.repeat(q < 0, size)
        total = np.concatenate([[0], np.cumsum(size)])
        if raw.any():
            per = np.diff(np.append(w, len(nodes)))
            tokens[raw] = v.byte_id[t[spread(s - np.repeat(np.arange(words), per), size)[raw]]]
        return tokens.astype(np.int32), np.diff(np.append(total[w], total[-1]))

    def all_tokens(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As word_tokens; a text longer than a batch is indexed in parts that end with a word, so that memory doesn't follow its length."""
        if len(buf) <= 2 * BATCH_BYTES:
            return self.word_tokens(buf, start, end)
        part = np.cumsum(end - start + 3) // (2 * BATCH_BYTES)
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.empty(0, np.int64)
        made = [self.word_tokens(buf, start[a:b], end[a:b]) for a, b in zip(cut[:-1], cut[1:])] or [self.word_tokens(buf, start, end)]
        tokens, size = zip(*made)
        return np.concatenate(tokens), np.concatenate(size)

    def encode(self, column) -> pa.LargeListArray:
        if pc.any(pc.match_substring(column, MARK)).as_py():
            column = pc.replace_substring(column, MARK, " ")
        buf, offs = flat(column)
        x = Words(buf, offs, NOT_SPACE, _RAW_TABLE)
        tokens, word_size = self.all_tokens(buf, x.start, x.end)
        word_start = np.cumsum(word_size) - word_size
        # marks before each word; the text begins with one of its own
        gap = x.start - np.concatenate([[0], x.end[:-1]])[: len(x.start)]
        has = np.flatnonzero(x.count)
        gap[x.first[:-1][has]] = x.start[x.first[:-1][has]] - offs[:-1][has] + 1
        seg_start, seg_size = np.zeros((len(gap), 2), np.int64), np.zeros((len(gap), 2), np.int64)
        seg_start[:, 1], seg_size[:, 1] = word_start, word_size
        # behind the last word, or of a text of spaces only
        length = np.diff(offs)
        tail = np.where(x.count > 0, offs[1:] - (x.end[np.maximum(x.first[1:] - 1, 0)] if len(x.end) else 0), np.where(length > 0, length + 1, 0))
        wide = np.flatnonzero(gap > 1)
        lone = tokens[word_start[wide]] == self.v.ids[self.v.mark] if len(wide) else np.empty(0, bool)
        made, run_start, run_size = self.runs(np.concatenate([gap[wide] - ~lone, tail]))
        run_start = run_start + len(tokens)
        seg_start[wide[lone], 1] += 1
        seg_size[wide[lone], 1] -= 1
        seg_start[wide, 0], seg_size[wide, 0] = run_start[: len(wide)], run_size[: len(wide)]
        tail_start, tail_size = run_start[len(wide) :], run_size[len(wide) :]
        per_row = np.bincount(x.doc, weights=seg_size.sum(1), minlength=x.rows).astype(np.int64)
        # the order is: words of a row, then its tail
        all_start = np.insert(seg_start.reshape(-1), 2 * x.first[1:], tail_start)
        all_size = np.insert(seg_size.reshape(-1), 2 * x.first[1:], tail_size)
        ids = np.concatenate([tokens, made])[spread(all_start, all_size)]
        return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row + tail_size)]), pa.int64()), pa.array(ids, pa.int32()))


def code_points(t: np.ndarray, lead: np.ndarray, size: np.ndarray) -> np.ndarray:
    p = np.concatenate([t, np.zeros(4, np.uint8)]).astype(np.int64)
    c = np.where(size == 1, p[lead], np.where(size == 2, p[lead] & 0x1F, np.where(size == 3, p[lead] & 0x0F, p[lead] & 7)))
    for j in range(1, 4):
        c = np.where(size > j, c << 6 | (p[lead + j] & 0x3F), c)
    return np.minimum(c, 0x10FFFF)


def run_tokens(n: int, v: Vocabulary) -> list[int]:
    """n marks, merged leftmost first: all pieces of marks have one score."""
    s = [1] * min(n, 4096)
    done = []
    if n > 4096:  # the left end settles; what is settled repeats
        whole = max(v.runs)
        done, s = [whole] * ((n - 4096) // whole), [1] * (4096 + (n - 4096) % whole)
    k = 0
    while k < len(s) - 1:
        if s[k] + s[k + 1] in v.runs:
            s[k : k + 2] = [s[k] + s[k + 1]]
            k = max(k - 1, 0)
        else:
            k += 1
    return [v.runs[x] for x in done + s]


def decode_lists(v: Vocabulary, column) -> pa.Array:
    """Texts of lists of ids; the dummy prefix goes, ids out of range and bytes that aren't UTF-8 become replacement characters."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    null = a.is_null().to_numpy(zero_copy_only=False)
    offs = a.offsets.to_numpy().astype(np.int64)
    if null.any():
        lists = [x if x is not None else [] for x in a.to_pylist()]
        offs = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        ids = np.array([y if y is not None else 0 for x in lists for y in x], np.int64)
    else:
        ids = pc.fill_null(a.values, 0).to_numpy(zero_copy_only=False)[offs[0] : offs[-1]].astype(np.int64)
        offs = offs - offs[0]
    ids = np.where((ids >= 0) & (ids < len(v.out_size)), ids, 0)
    size = v.out_size[ids]
    data = v.out[spread(v.out_start[ids], size)]
    ends = np.concatenate([[0], np.cumsum(size)])[offs]
    begin = ends[:-1]
    lead = begin[(begin < ends[1:])]
    lead = lead[data[lead] == 32]
    keep = np.ones(len(data), bool)
    keep[lead] = False
    ends = np.concatenate([[0], np.cumsum(keep)])[ends]
    valid = pa.py_buffer(np.packbits(~null, bitorder="little"))
    out = pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[keep]), valid)
    try:
        out.validate(full=True)
    except pa.ArrowInvalid:
        data = data[keep].tobytes()
        out = pa.array([None if n else data[x:y].decode("utf-8", "replace") for n, x, y in zip(null, ends[:-1], ends[1:])], pa.large_string())
    return out


def _encoder(path: str) -> Encoder:
    """One in each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(vocabulary(path))
    return _encoders[path]


_encoders: dict[str, Encoder] = {}


def encode(docs: DataFrame, path: str = MODEL, check: bool = True, ids: str = "ids", n_tokens: str = "n_tokens", round_trip: str = "round_trip") -> DataFrame:
    """docs with ids, n_tokens, and (if check) round_trip: decoding the ids gives the text, with spaces for
    space marks. A new column whose name is taken gets underscores behind it."""
    ship(docs.sparkSession)
    names, new = docs.columns, []
    for c in (ids, n_tokens, round_trip)[: 2 + check]:
        while c in names:
            c += "_"
        new.append(c)
    at = names.index("text")

    def run(batches):
        e = _encoder(path)
        for batch in batches:
            for b in pieces(batch, batch.schema.names[at], BATCH_BYTES):
                text = pc.fill_null(b.column(at).cast(pa.large_string()), "")
                got = e.encode(text)
                cols = [got.cast(pa.list_(pa.int32())), pc.cast(pc.list_value_length(got), pa.int32())]
                if check:
                    cols.append(pc.equal(decode_lists(e.v, got), pc.replace_substring(text, MARK, " ")))
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*names, *new])

    from pyspark.sql import types as T

    kinds = (T.ArrayType(T.IntegerType()), T.IntegerType(), T.BooleanType())
    return docs.mapInArrow(run, T.StructType(docs.schema.fields + [T.StructField(c, k) for c, k in zip(new, kinds)]))


def decode(tokens: DataFrame, column: str = "ids", to: str = "text", path: str = MODEL) -> DataFrame:
    """tokens with their text; a column ``to`` that is there is replaced."""
    ship(tokens.sparkSession)
    from pyspark.sql import types as T

    names = [c for c in tokens.columns if c != to]
    base = tokens.select(*[f"`{c}`" for c in names])

    def run(batches):
        v = vocabulary(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, decode_lists(v, b.column(names.index(column))).cast(pa.string())], names=[*names, to])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(to, T.StringType())]))
