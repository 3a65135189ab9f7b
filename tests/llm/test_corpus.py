"""Toxicity, line deduplication, Jaccard join, decontamination, SentencePiece, LM scores, pipeline."""

import itertools
import os
import random
import re
import time
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as P
from rulespan.llm import decontam as D
from rulespan.llm import line_dedup as L
from rulespan.llm import lm_bloom as M
from rulespan.llm import ngram_join as J
from rulespan.llm import sentencepiece_sa as S
from rulespan.llm import text as T
from rulespan.llm import toxicity as X

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def word_list(t):
    return [w.lower() for w in re.findall(r"\w+", t or "")]


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# --- the kernel


def test_words_and_grams_against_strings():
    texts = ["The cat. the CAT", "", None, "a", "É é x_1", "one two three four", "one two"]
    w = T.words(pa.array(texts))
    flat = [x for t in texts for x in word_list(t)]
    assert len(w.h) == len(flat) and list(w.count) == [len(word_list(t)) for t in texts]
    for (h1, x), (h2, y) in itertools.combinations(zip(w.h.tolist(), flat), 2):
        assert (h1 == h2) == (x == y)
    g, d = T.ngrams(w.h, w.doc, 3, short=True)
    assert sorted(d.tolist()) == sorted([0, 0, 3, 4, 5, 5, 6])
    s, first = T.doc_sets(g, d, w.rows)
    assert list(np.diff(first)) == [2, 0, 0, 1, 1, 2, 1]
    b = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    assert sum(p.num_rows for p in T.pieces(b, "text", 6)) == len(texts)


# --- toxicity


def toxic_corpus(rng, n):
    bad = ["grunt", "vileworm", "vilekin", "vilesome"]
    rows = []
    for k in range(n):
        w = prose(rng, 40).split()
        if k % 5 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((k, " ".join(w), int(k % 5 == 0)))
    return rows


def test_chain_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    trans, start = rng.normal(size=(2, 2)), 0.3
    emit, first = rng.normal(size=9), np.array([0, 4, 4, 9])
    got = X.chain_marginals(emit, first, trans, start)
    for a, b in ((0, 4), (4, 9)):
        total, hot = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=b - a):
            s = start * y[0] + sum(emit[a + k] * v for k, v in enumerate(y)) + sum(trans[p, q] for p, q in zip(y, y[1:]))
            total += np.exp(s)
            hot += np.exp(s) * np.array(y)
        assert np.allclose(got[a:b], hot / total)


def test_gradient_against_enumeration():
    """Marginals and expected transitions of windows, by all labellings of each; equal windows count by weight."""
    rng = np.random.default_rng(3)
    trans, start = rng.normal(size=(2, 2)), -0.4
    first, weight = np.array([0, 3, 4, 8]), np.array([1.0, 5.0, 2.0])
    emit = rng.normal(size=8)
    inner = np.array([True, True, False, False, True, True, True])
    marg, pair = X._window_posteriors(emit, first, trans, start, inner, np.repeat(weight, np.diff(first)))
    want = np.zeros((2, 2))
    for a, b, w in zip(first[:-1], first[1:], weight):
        total, hot, ab = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(b - a)):
            s = np.exp(start * y[0] + sum(emit[a + k] * v for k, v in enumerate(y)) + sum(trans[p, q] for p, q in zip(y, y[1:])))
            total += s
            hot += s * np.array(y)
            for p, q in zip(y, y[1:]):
                ab[p, q] += s
        assert np.allclose(marg[a:b], hot / total)
        want += w * ab / total
    assert np.allclose(pair, want)


def test_training_holds_a_part_at_once(monkeypatch):
    """The driver's memory is a bounded multiple of the sample; windows in blocks are those of one block."""
    rng = random.Random(41)
    vocabulary = [prose(rng, 1) + str(k) for k in range(30_000)]
    texts = [" ".join(rng.choices(vocabulary, k=400)) + (" vileworm vilekin" if k % 4 == 0 else "") for k in range(1000)]
    toxic = np.array([k % 4 == 0 for k in range(1000)])
    T.words(pa.array(texts[:500]))  # tables of powers
    tracemalloc.start()
    one = X.fit(texts, toxic, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * sum(map(len, texts)), peak / sum(map(len, texts))
    monkeypatch.setattr(X, "BLOCK", 1000)
    parts = X.fit(pa.array(texts, pa.large_string()), toxic, steps=2)
    assert (one.keys == parts.keys).all() and np.allclose(one.weights, parts.weights) and len(one.keys) > 1


def test_equal_windows_are_one():
    y = np.zeros(20, bool)
    y[13] = True
    starts, ends = np.array([0, 4, 8, 12, 16, 18]), np.array([4, 8, 12, 16, 18, 20])
    hits = [(0, 10, np.array([5, 5]), np.array([0, 1])), (10, 10, np.array([3]), np.array([1]))]
    labels, first, weight, pairs = X.distinct_windows(y, starts, ends, hits)
    assert np.diff(first).tolist() == [4, 4, 2, 4] and weight.tolist() == [1, 1, 2, 2] and np.flatnonzero(labels).tolist() == [5]
    assert [(t.tolist(), k.tolist()) for t, k in pairs] == [([1, 1], [0, 1]), ([5], [1])]


def test_toxic_held_out(spark, odd, clashing, empty):
    rows = toxic_corpus(random.Random(7), 500)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 350] + [(None, 1), (1, None), (9999, 1)], "doc_id long, toxic int")
    model = X.train(docs, labels)
    got = {r.doc_id: r for r in X.tag(docs, model).collect()}
    held = [r for r in rows if r[0] >= 350]
    assert sum(got[i].toxic == bool(y) for i, _, y in held) / len(held) >= 0.98
    for i, t, y in held:
        for s in got[i].spans:
            assert t[s.start : s.end] == s.text and (not y or "vile" in s.text or "grunt" in s.text)
    assert {r.doc_id for r in X.toxic_documents(docs, labels).collect()} == {i for i, r in got.items() if r.toxic}
    assert {r.doc_id for r in X.drop_toxic(docs, labels).collect()} == {i for i, r in got.items() if not r.toxic}
    assert X.tag(odd, model).count() == odd.count() and X.tag(odd, model).filter("toxic").count() == 0
    assert X.drop_toxic(clashing, labels).columns == clashing.columns and X.drop_toxic(empty, labels).count() == 0
    assert X.toxic_documents(docs, labels.filter("toxic = 0")).count() == 0 and X.tag(empty, model).count() == 0


# --- lines


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(1, 1 << 63, 5000, dtype=np.uint64))
    for n in (0, 1, 2, len(keys)):
        m = L.mph_build(keys[:n])
        slots = L.mph_slots(m, keys[:n])
        assert sorted(slots.tolist()) == list(range(n))
    assert (L.mph_slots(m, keys + np.uint64(1)) < len(keys)).all()


def test_lines_whose_hashes_agree():
    rng = np.random.default_rng(4)
    k = np.repeat(rng.integers(1, 1 << 62, 50), rng.integers(1, 4, 50))
    fp, n, owner = np.arange(len(k)), rng.integers(1, 4, len(k)), rng.integers(0, 99, len(k))
    none, at = np.zeros(len(k), bool), np.zeros(len(k), np.int64)
    mixed = rng.permutation(len(k))
    m = L.shard_arrays({c: x[mixed] for c, x in dict(k=k, fp=fp, n=n, none=none, owner=owner, at=at).items()})
    for there, want in ((owner, np.zeros(len(k), bool)), (owner + 1, n >= 2)):
        assert (L.stands_elsewhere(m, k.astype(np.uint64), fp.astype(np.uint32), none, there, at, 2) == want).all()
    assert not L.stands_elsewhere(m, k.astype(np.uint64), fp.astype(np.uint32) + 1000, none, owner + 1, at, 2).any()


def test_lines_against_sql(spark, odd, clashing, empty):
    rng = random.Random(3)
    pool = [prose(rng, 4) for _ in range(12)] + ["short", "", "  ", "é" * 12]
    rows = [(k, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\t", "\r"]) for _ in range(rng.randrange(7))), "en", "s", 5) for k in range(60)]
    rows += [(100, rows[5][1], "en", "s", 5), (None, rows[7][1], "en", "s", 5), (101, None, None, None, None), (102, "\n\n", "x", None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = L.dedup_lines(df)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    want = con.execute(f"select {', '.join(cols)} from ({L.oracle()})").fetchall() + [rows[-2]]
    norm = lambda rs: key([[None if v is None or v != v else int(v) if isinstance(v, float) else v for v in r] for r in rs])
    assert norm(got.select(cols).collect()) == norm(want)
    for d in (odd, clashing):
        out = L.dedup_lines(d)
        assert out.columns == d.columns
        left = [r.doc_id for r in out.collect()]
        assert left.count(2) == 0 and left.count(1) == 1 and 4 in left and 5 in left and 6 in left and 7 in left
        assert left.count(None) == 1 and left.count(3) == 1 and left.count(10) == 1 and left.count(11) == 1
    assert L.dedup_lines(empty).count() == 0
    same = spark.createDataFrame([(1, "a long enough line"), (1, "a long enough line")], "doc_id long, text string")
    assert L.dedup_lines(same).count() == 2


# --- Jaccard


def brute_pairs(rows, n, t):
    sets = []
    for i, x in rows:
        w = word_list(x)
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    out = []
    for (a, s), (b, u) in itertools.combinations(sets, 2):
        if s and u and len(s & u) / len(s | u) >= t - 1e-12:
            out.append(tuple(sorted((a, b), key=repr)))
    return sorted(out, key=repr)


def expand(rows):
    """All pairs, from those of least documents and the members of their classes."""
    classes = {}
    for r in rows:
        if r.jaccard == 1:
            classes.setdefault(r.doc_id_a, [r.doc_id_a]).append(r.doc_id_b)
    out = [p for c in classes.values() for p in itertools.combinations(c, 2)]
    for r in rows:
        if r.jaccard < 1:
            out += itertools.product(classes.get(r.doc_id_a, [r.doc_id_a]), classes.get(r.doc_id_b, [r.doc_id_b]))
    return sorted((tuple(sorted(p, key=repr)) for p in out), key=repr)


def near_rows(rng):
    rows = []
    for _ in range(12):
        base = prose(rng, rng.randrange(8, 60)).split()
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = prose(rng, 1)
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("n, t, most", [(3, 0.6, 8), (2, 0.8, 1), (1, 0.5, 4)])
def test_join_against_all_pairs(spark, n, t, most):
    rows = near_rows(random.Random(n)) + [(200, "two words"), (201, "Two words"), (202, ""), (203, None), (204, "two words"), (204, "two words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = J.near_duplicates(df, n, t, most).collect()
    assert expand(got) == brute_pairs(rows, n, t)
    kept = {r.doc_id for r in J.one_of_each(df, n, t, most).collect()}
    groups = {i: i for i, _ in rows}

    def root(x):
        while groups[x] != x:
            x = groups[x]
        return x

    for a, b in brute_pairs(rows, n, t):
        ra, rb = root(a), root(b)
        groups[max(ra, rb)] = min(ra, rb)
    assert kept == {root(i) for i, _ in rows}


def test_join_odd_rows(spark, odd, clashing, empty, odd_rows):
    want = brute_pairs([r[:2] for r in odd_rows], 3, 0.6)
    for d in (odd, clashing):
        assert expand(J.near_duplicates(d).collect()) == want
        out = J.one_of_each(d)
        ids = [r.doc_id for r in out.collect()]
        assert out.columns == d.columns and ids.count(1) == 1 and ids.count(2) == 0 and ids.count(10) == 1 and ids.count(11) == 0 and {4, 5, 6, 7, 8} <= set(ids)
        assert ids.count(3) == 1 and ids.count(None) == 1
    assert J.near_duplicates(empty).count() == 0 and J.one_of_each(empty).count() == 0


def test_join_against_sql(spark):
    rows = near_rows(random.Random(31)) + [(200, "two words"), (201, "Two, words"), (202, ""), (203, None), (204, "ÀÉÎ × ßx_9 wort"), (205, "àéî ÷ ßX_9 Wort")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    cols = ["doc_id_a", "doc_id_b", "shared", "jaccard"]
    want = con.execute(f"select {', '.join(cols)} from ({J.oracle()})").fetchall()
    assert len(want) > 10 and key(J.near_duplicates(df).select(cols).collect()) == key(want)


def test_hits_in_parts_and_uid_sets(spark, tmp_path, monkeypatch):
    rows = near_rows(random.Random(32)) * 2
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rng = np.random.default_rng(0)
    gram, loc, size = rng.integers(0, 9, 400).astype(np.uint64) << np.uint64(48), np.arange(400, dtype=np.uint64) << np.uint64(10), rng.integers(1, 20, 400).astype(np.uint32)
    want = rng.integers(1, 4, 400).astype(np.uint8)
    lev = rng.integers(1, 4, 400).astype(np.uint8)
    shard = (gram >> np.uint64(49)).astype(int)  # 8 of them
    index = {k: J.index_of(*(x[shard == k] for x in (gram, loc, size, lev))) for k in set(shard.tolist())}
    own = np.flatnonzero(lev <= want)

    def run():
        found = J.candidates(index.__getitem__, 8, 0.6, gram[own], own, size.astype(np.int64), want, loc)
        return sorted((a, b, n) for i, y, k in found for a, b, n in zip(loc[i].tolist(), y.tolist(), k.tolist()))

    # a document of one gram has a hit at most; pairs that want more aren't given
    brute = [(int(loc[i]), int(loc[j]), 1) for i in range(400) for j in range(400) if gram[i] == gram[j] and (size[i], loc[i]) > (size[j], loc[j]) and size[j] >= 0.6 * size[i] - 1e-9 and lev[i] <= want[i] and lev[j] <= want[i] and want[i] == 1]
    whole = run()
    assert len(whole) > 100 and whole == sorted(brute)
    monkeypatch.setattr(J, "HITS", 7)
    assert run() == whole
    s = J.UidSet.of(spark.createDataFrame([(5, 1), (5, 2), (-9, 3), (7, 4)], "uid long, chk long"), str(tmp_path / "u"))
    assert s.contains(np.array([5, 5, 5, -9, 7, 8, -10]), np.array([1, 2, 3, 3, 3, 4, 3])).tolist() == [True, True, False, True, False, False, False]
    assert expand(J.near_duplicates(df).collect()) == brute_pairs(rows, 3, 0.6)


def brute_groups(rows, n, t):
    """(doc_id, class_id, links) by rows, all rows told apart."""
    pairs = [(a[0], b[0]) for a, b in brute_pairs([((k, i), x) for k, (i, x) in enumerate(rows)], n, t)]
    links, root = [0] * len(rows), list(range(len(rows)))
    for a, b in pairs:
        links[a], links[b] = links[a] + 1, links[b] + 1
        x, y = root[a], root[b]
        root = [x if r == y else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(least.get(r, (True, 0)), (i is None, i or 0))
    return key((i, None if least[r][0] else least[r][1], k) for (i, _), r, k in zip(rows, root, links))


def test_groups_have_all_links(spark, odd, clashing, empty, odd_rows):
    """Every document has all its links: texts of equal sets, repeated rows, rows of one id, and documents far apart in a group."""
    chain = [f"w{k}" for k in range(80)]
    rows = near_rows(random.Random(33)) + [(300, "One two, three four five"), (301, "one TWO three; four five"), (302, "one two three four five six"), (303, "one two three four five seven"), (303, "one two three four five seven")]
    rows += [(304, "one two three four five six"), (304, "two words"), (305, "Two words"), (306, ""), (307, None), (None, "one two three four five six"), (None, None)]
    rows += [(400 + k, " ".join(chain[3 * k : 3 * k + 40])) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for n, t, most in ((3, 0.6, 8), (2, 0.5, 3)):
        assert key(map(tuple, J.groups(df, n, t, most).collect())) == brute_groups(rows, n, t)
    for d in (odd, clashing):
        assert key(map(tuple, J.groups(d).collect())) == brute_groups([r[:2] for r in odd_rows], 3, 0.6)
    assert J.groups(empty).count() == 0


def test_groups_against_sql_and_in_parts(spark, monkeypatch):
    rows = near_rows(random.Random(34)) + [(200, "two words"), (201, "Two, words"), (202, ""), (203, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.execute(f"select doc_id, class_id, links from ({J.oracle_groups()})").fetchall()
    assert key(want) == brute_groups(rows, 3, 0.6) == key(map(tuple, J.groups(df).collect()))


def test_join_leaves_no_sets_or_pairs(spark, tmp_path, monkeypatch):
    """What a step of the join has written goes when the next has read it; rows aren't read from it."""
    monkeypatch.setattr(J, "work_dir", lambda spark, name: str(tmp_path))
    rows = near_rows(random.Random(35))
    out = J.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert not {"df", "entries", "index", "sets", "pairs", "found", "forest", "groups"} & {p.name for p in tmp_path.iterdir()}
    assert 0 < len(out.collect()) < len(rows)


def test_join_disk(spark, tmp_path, monkeypatch):
    """Where all grams are shared, as in large tables, sets and postings take few bytes a gram, nothing else that is large stays beside them, and no shuffle stays."""
    monkeypatch.setattr(J, "work_dir", lambda spark, name: str(tmp_path))
    rng = random.Random(36)
    rows = [(k, " ".join(rng.choice(WORDS[:12]) for _ in range(1000))) for k in range(80)]
    total = sum(len({tuple(w[k : k + 3]) for k in range(len(w) - 2)}) for w in (t.split() for _, t in rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    shuffled = lambda: set(re.findall(r"shuffle_\d+_", spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))
    before, held, groups = shuffled(), {}, J.Join.groups

    def measured(join):
        held.update({p.name: sum(f.stat().st_size for f in p.rglob("*")) for p in tmp_path.iterdir() if p.is_dir()}, shuffles=len(shuffled() - before))
        return groups(join)

    monkeypatch.setattr(J.Join, "groups", measured)
    assert J.one_of_each(df).count() == 80
    assert held.pop("sets") + held.pop("index") < 10 * total
    assert held.pop("shuffles") == 0 and set(held) == {"members"}
    assert not {"members", "links", "labels"} & {p.name for p in tmp_path.iterdir()}


def test_postings_in_passes(spark, tmp_path, monkeypatch):
    rows = near_rows(random.Random(37))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name, value in (("PASSES", 3), ("PASS_POSTINGS", 1), ("shard_count", lambda *_: 5)):
        monkeypatch.setattr(J, name, value)
    assert expand(J.near_duplicates(df).collect()) == brute_pairs(rows, 3, 0.6)
    assert key(map(tuple, J.groups(df).collect())) == brute_groups(rows, 3, 0.6)


def test_dropped_files_hold_no_disk(tmp_path):
    J.save_arrays(f"{tmp_path}/a/b/c", {"x": np.arange(1000)})
    with open(f"{tmp_path}/a/b/c", "rb") as f:
        J.drop_mapped(f"{tmp_path}/a")
        assert os.fstat(f.fileno()).st_blocks == 0 and not (tmp_path / "a").exists()


def test_no_pair_leaves_a_task(tmp_path):
    """Of 300 documents that are all near each other, a task's links and forest are of the number of documents."""
    base = np.sort(np.random.default_rng(1).choice(1 << 40, 60, False)).astype(np.uint64)
    grams = np.concatenate([np.sort(np.append(base, np.uint64((1 << 41) + k))) for k in range(300)])
    ends = np.arange(301) * 61
    size, want = np.full(300, 61), np.ones(300, np.uint8)
    J.save_arrays(f"{tmp_path}/0", {"grams": grams, "ends": ends, "sizes": size, "want": want, "sig": np.arange(300).astype(np.uint64), "sig2": np.arange(300).astype(np.uint64), "prefix": np.repeat(base[:1], 300), "prefix_ends": np.arange(301), "rows": np.ones(300), "part": np.ones(300)})
    index = J.index_of(np.repeat(base[:1], 300), np.arange(300, dtype=np.uint64), size, want)
    sets = J.Sets(str(tmp_path), np.array([0]))
    (batch,) = J._links(sets, lambda s: index, 1, 0.6, 1)([pa.RecordBatch.from_pydict({"file": [0]})])
    assert sum(len(x) for c in ("a", "b") for x in batch.column(c).to_pylist()) < 300 * 16
    (links,) = J._add_links(sets)([batch.filter(pa.array([b >= 0 for b in batch.column("bucket").to_pylist()]))])
    assert links.column("links").to_pylist() == [299.0] * 300


# --- decontamination


def test_leaks(spark, odd, clashing, empty):
    rng = random.Random(11)
    items = [(k, prose(rng, rng.randrange(20, 50))) for k in range(20)] + [(50, None), (51, ""), (52, prose(rng, 150))]
    docs, planted = [], set()
    for k in range(150):
        w = prose(rng, 150).split()
        if k % 5 == 0:
            i, t = items[k // 5 % 20]
            t = t.split()
            if k % 10 == 0:  # a paraphrase: some words are replaced
                for j in range(2, len(t) - 8, 5):
                    t[j] = "other" + str(j)
            at = rng.randrange(len(w))
            w[at:at] = t
            planted.add((k, i))
        docs.append((k, " ".join(w)))
    docs.append((500, "x " + items[-1][1]))
    planted.add((500, 52))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.leaks(df, bench).collect()}
    assert len(got & planted) >= 0.9 * len(planted) and not got - planted
    assert {r.doc_id for r in D.drop_contaminated(df, bench).collect()} == {i for i, _ in docs} - {i for i, _ in got}
    for d in (odd, clashing):
        assert D.leaks(d, bench).count() == 0 and key([r[:1] for r in D.drop_contaminated(d, bench).collect()]) == key([r[:1] for r in odd.collect()])
    assert D.drop_contaminated(clashing, bench).columns == clashing.columns
    assert D.leaks(empty, bench).count() == 0 and D.leaks(df, bench.limit(0)).count() == 0 and D.drop_contaminated(df, bench.limit(0)).count() == df.count()
    with pytest.raises(ValueError):
        D.read_items(bench, max_items=3)


def cut_items(rng, docs, lengths, each):
    """Items cut word for word from documents: (item_id, text), and the (doc_id, item_id) of their sources."""
    items, planted = [], set()
    for n in lengths:
        for _ in range(each):
            i, t = rng.choice(docs)
            w = t.split()
            at = rng.randrange(len(w) - n + 1)
            planted.add((i, len(items)))
            items.append((len(items), " ".join(w[at : at + n])))
    return items, planted


def test_leaks_of_every_item_length_against_all_windows(spark):
    rng = random.Random(21)
    docs = [(k, prose(rng, rng.randrange(70, 400))) for k in range(60)] + [(60, ""), (61, "alpha1")]
    items, planted = cut_items(rng, docs[:60], (1, 2, 4, 7, 11, 15, 19, 24, 40, 64), 8)
    items.append((len(items), prose(rng, 150)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    parts = D.read_items(bench)
    m = D.Matcher(parts, np.zeros((len(parts.terms), 1), np.float32))
    want = {}
    for i, t in docs:
        h = T.words(pa.array([t])).h
        for at in range(0, len(h), D.BLOCK):
            window = h[at : at + D.WINDOW_BLOCKS * D.BLOCK].tolist()
            for k, item in enumerate(parts.item):
                if v := m.verdict(k, window, D.LCS_SHARE, D.PARAPHRASE_SHARE, D.ANSWER_SHARE):
                    want[i, item] = max(want.get((i, item), v), v)
    assert planted <= set(want)
    assert {(r.doc_id, r.item_id): (r.lcs, r.answer) for r in D.leaks(df, bench).collect()} == want
    assert {r.doc_id for r in D.drop_contaminated(df, bench).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_leaks_in_batches_of_items(spark):
    rng = random.Random(22)
    docs = [(k, prose(rng, 150)) for k in range(40)]
    items, planted = cut_items(rng, docs, (5, 12, 30, 64), 6)
    items = [(i, "the " * (i % 2) + t + " and") for i, t in items] + [(0, docs[7][1][:300]), (90, "the and the and"), (91, "of of"), (None, docs[3][1][:200]), (None, None), (93, "")]
    docs += [(50, "so the and the and so"), (50, docs[5][1]), (None, docs[6][1]), (51, None)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string").repartition(2)
    rows = lambda d: key((r.doc_id, r.item_id, r.lcs, r.answer) for r in d.collect())
    one = rows(D.leaks(df, bench))
    assert planted <= {r[:2] for r in one} and (50, 90) in {r[:2] for r in one}
    assert rows(D.leaks(df, bench, max_items=5)) == one
    clean = key(D.drop_contaminated(df, bench).collect())
    assert 0 < len(clean) < len(docs) and key(D.drop_contaminated(df, bench, max_items=5).collect()) == clean


def test_sums_of_rows_by_blocks_and_by_terms():
    rng = np.random.default_rng(4)
    for blocks, terms, hits in ((1, 1, 1), (40, 7, 300), (700, 600, 4000), (2000, 5, 2500)):
        block, i = np.sort(rng.integers(0, blocks, hits)), (terms * rng.random(hits) ** 3).astype(np.int64)
        a = np.zeros((blocks, terms), np.float32)
        np.add.at(a, (block, i), 1)
        matrix = rng.standard_normal((terms, 9), np.float32)
        for dense in (np.zeros(terms, bool), a.any(0) & (np.arange(terms) % 3 == 0), np.ones(terms, bool)):
            products, y = D.Products(matrix, dense), np.ones((terms, 9), np.float32)
            ids, p, kept = products.of(block, i)
            assert (ids == np.unique(block)).all() and np.allclose(p, (a @ matrix)[ids], rtol=1e-4, atol=1e-3)
            products.back(y, p, kept)
            assert np.allclose(y, 1 + a.T @ (a @ matrix), rtol=1e-3, atol=1e-2)


def test_work_of_a_batch_of_documents(monkeypatch):
    rng, looked_up = random.Random(23), []
    docs = [(k, prose(rng, 300)) for k in range(20)]
    items, planted = cut_items(rng, docs, (12, 30), 5)
    monkeypatch.setattr(D, "item_texts", lambda _: type("Rows", (), {"toArrow": lambda self: pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]})})())
    parts = D.read_items(None, max_items=None)
    m, find = D.Matcher(parts, np.random.default_rng(1).standard_normal((len(parts.terms), 8), np.float32)), D.find
    monkeypatch.setattr(D, "find", lambda *a: looked_up.append(1) or find(*a))
    _, found = m.search(pa.RecordBatch.from_pydict({"text": [t for _, t in docs]}))
    assert planted <= set(found) and len(looked_up) == 1  # words are looked up once, not again for the prefixes

    r = np.random.default_rng(2)
    block, i = np.sort(r.integers(0, 8000, 60_000)), r.integers(0, 3000, 60_000)
    products, y = D.Products(r.standard_normal((3000, 288), np.float32), np.zeros(3000, bool)), np.zeros((3000, 288), np.float32)
    _, p, (counts, local, i) = products.of(block, i)
    order = np.argsort(i, kind="stable")

    def seconds(f):
        took = []
        for _ in range(5):
            t = time.process_time()
            f()
            took.append(time.process_time() - t)
        return min(took)

    by_reduceat = seconds(lambda: np.add.reduceat(p[local[order]], np.arange(0, len(order), 20), axis=0))
    assert seconds(lambda: products.back(y, p, (counts, local, i))) < 0.4 * by_reduceat


def test_lcs_and_singular_vectors():
    rng = random.Random(1)
    for _ in range(50):
        a, b = [rng.randrange(5) for _ in range(12)], [rng.randrange(5) for _ in range(15)]
        best = [[0] * 16 for _ in range(13)]
        for i, j in itertools.product(range(12), range(15)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert D.lcs(D.bit_masks(a), (1 << 12) - 1, b).bit_count() == best[-1][-1]
    x = np.random.default_rng(0).normal(size=(300, 40)) * np.geomspace(10, 0.01, 40)
    g, o = x.T @ x, D.test_matrix(40, 20)
    v = D.leading_vectors(g @ o, o, 5)
    true = np.linalg.svd(x)[2][:5].T
    assert np.linalg.norm(true.T @ v, 2) > 0.99 and np.abs(np.linalg.svd(true.T @ v)[1]).min() > 0.9


@pytest.mark.parametrize("kind", ["int", "smallint", "string"])
def test_ids_of_any_type(spark, kind):
    rng = random.Random(17)
    item = prose(rng, 30)
    rows = [(1, prose(rng, 40) + " " + item), (2, prose(rng, 40)), (None, prose(rng, 40) + " " + item), (4, None), (5, "")]
    rows += [(3, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    bench = spark.createDataFrame([(7, item), (None, prose(rng, 20))], "item_id long, text string").selectExpr(f"cast(item_id as {kind}) as item_id", "text")
    cast = (lambda x: None if x is None else str(x)) if kind == "string" else (lambda x: x)
    found = D.leaks(df, bench)
    assert found.dtypes[:2] == [("doc_id", kind), ("item_id", kind)] and key(r[:2] for r in found.collect()) == key([(cast(1), cast(7)), (None, cast(7))])
    assert D.drop_contaminated(df, bench).dtypes == df.dtypes
    near = J.near_duplicates(df, n=1)
    assert near.dtypes[:2] == [("doc_id_a", kind), ("doc_id_b", kind)] and (cast(2), cast(3)) in [r[:2] for r in near.collect()]
    assert {r.doc_id for r in J.one_of_each(df).collect()} == {cast(x) for x in (1, 2, None, 4, 5)}
    encoded = S.encode(df.select("doc_id", "text"))
    assert encoded.dtypes[0] == ("doc_id", kind) and encoded.filter("round_trip").count() == 6


# --- SentencePiece


def test_encoding_against_the_library(spark, odd, clashing, empty, monkeypatch):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    rng = random.Random(8)
    chars = "abc déß,. \n\t▁漢字😀Ａ-=x'0  "
    texts = ["", " ", "   ", "x" * 700, " " * 40, "▁▁a", "日本語テキスト", "http://e.org/a?b=c&d", *("".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(300))]
    e = S.Encoder(S.vocabulary(S.MODEL))
    for size in (S.BATCH_BYTES, 1, 100):  # whole, by words, in parts
        monkeypatch.setattr(S, "BATCH_BYTES", size)
        got = e.encode(pa.array(texts, pa.large_string()))
        assert got.to_pylist() == m.encode(texts)
    monkeypatch.undo()
    assert S.decode_lists(e.v, got).to_pylist() == [t.replace("▁", " ") for t in texts]
    for n in (1, 2, 15, 16, 17, 31, 100, 4999):
        assert S.run_tokens(n + 1, e.v) == m.encode(" " * n)
    for d in (odd, clashing):
        out = S.encode(d)
        new = out.columns[len(d.columns) :]
        assert out.columns[: len(d.columns)] == d.columns and len(set(out.columns)) == len(out.columns)
        for r in out.collect():
            assert list(r[new[0]]) == m.encode(r.text or "") and r[new[1]] == len(r[new[0]]) and r[new[2]]
    assert S.encode(empty).count() == 0
    ids = spark.createDataFrame([(1, m.encode("Hello  wörld\n")), (2, None), (3, []), (4, [3 + 0xFF, 99_999_999, -1])], "k int, ids array<int>")
    text = {r.k: r.text for r in S.decode(ids).collect()}
    assert text[1] == "Hello  wörld\n" and text[2] is None and text[3] == "" and "�" in text[4]


# --- LM


def test_bloom_levels_never_read_low():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 52, 4000, dtype=np.uint64))
    levels = rng.integers(1, 9, len(keys))
    f = M.bloom_build(keys, levels, 16, 8)
    got = M.bloom_levels(f, keys, 8)
    assert (got >= levels).all() and (got != levels).mean() < 0.01
    assert (M.bloom_levels(f, keys + np.uint64(1 << 52), 8) > 0).mean() < 0.01


def test_scores_against_exact_counts(spark, odd, clashing, empty):
    from collections import Counter

    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(30)))) for k in range(80)] + [(90, None), (91, ""), (92, "..."), (3, "pi pi pi"), (3, "pi pi pi")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    c = Counter()
    for _, t in rows:
        w = word_list(t)
        for n in (1, 2, 3):
            c.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    total, vocabulary = sum(v for g, v in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)
    q = {g: float(M.count_of(M.level_of(np.array([v]), M.LOG_BASE), M.LOG_BASE)[0]) for g, v in c.items()}
    assert [float(M.count_of(np.array([k]), M.LOG_BASE)[0]) for k in range(5)] == [0, 1, 2, 3, 4.5]

    def brute(t):
        w, out = word_list(t), 0.0
        for k in range(len(w)):
            p, mass = M.LAMBDAS[0] * (q[(w[k],)] + 1) / (total + vocabulary), M.LAMBDAS[0]
            for n in (1, 2):
                if k >= n:
                    p, mass = p + M.LAMBDAS[n] * min(1, max(0, q[tuple(w[k - n : k + 1])] - M.DISCOUNT) / q[tuple(w[k - n : k])]), mass + M.LAMBDAS[n]
            out += np.log10(p / mass)
        return out

    for size in (1 << 30, 100):  # one segment of filters, and many
        got = M.lm_scores(df, bits=32, hashes=12, segment_bytes=size).collect()
        assert len(got) == len(rows)
        for i, t in rows:
            mine = [r for r in got if r.doc_id == i and r.n_words == len(word_list(t))]
            assert mine and mine[0].log_prob == pytest.approx(brute(t), abs=1e-6)
            assert (mine[0].perplexity is None) == (not word_list(t))
    assert M.lm_scores(odd).count() == odd.count() == M.lm_scores(clashing).count() and M.lm_scores(empty).count() == 0


def test_production_scores_near_exact_counts(spark):
    from collections import Counter

    rng = random.Random(15)
    rows = [(k, prose(rng, rng.randrange(20, 200))) for k in range(300)]
    c = Counter()
    for _, t in rows:
        w = word_list(t)
        for n in (1, 2, 3):
            c.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    total, vocabulary = sum(v for g, v in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)
    errors = []
    for r in M.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        w, exact = word_list(rows[r.doc_id][1]), 0.0
        for k in range(len(w)):
            p, mass = M.LAMBDAS[0] * (c[(w[k],)] + 1) / (total + vocabulary), M.LAMBDAS[0]
            for n in range(1, min(k, 2) + 1):
                p, mass = p + M.LAMBDAS[n] * (c[tuple(w[k - n : k + 1])] - M.DISCOUNT) / c[tuple(w[k - n : k])], mass + M.LAMBDAS[n]
            exact += np.log10(p / mass)
        errors.append((r.log_prob - exact) / len(w))
    assert len(errors) == len(rows) and np.abs(errors).max() <= 0.03  # log10 a word


def test_copies_are_told_from_the_rest(spark):
    rng = random.Random(16)
    rows = [(k, prose(rng, 80)) for k in range(200)]
    rows += [(200 + k, rows[k][1]) for k in range(20)]
    got = {r.doc_id: r.perplexity for r in M.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    twice = [got[k] for k in (*range(20), *range(200, 220))]
    assert max(twice) < min(got[k] for k in range(20, 200))


def test_scores_of_the_corpus_need_no_probes(spark):
    """Texts of the corpus are answered by shard; others probe the filters. Both give the same."""
    import shutil

    rng = random.Random(17)
    rows = [(k, prose(rng, rng.randrange(0, 300))) for k in range(200)] + [(200, None), (201, ""), (202, "..."), (203, "of the")]
    docs = spark.createDataFrame(rows + rows[:30], "doc_id long, text string").repartition(3)
    answered, probed = M.train(docs), M.train(docs)
    shutil.rmtree(probed.answers)
    others = M.score(docs.filter("doc_id % 3 > 0"), answered).collect()
    for path in answered.segments:
        os.remove(path.removeprefix("file:"))
    got, want = (sorted(map(repr, M.score(docs, m).collect())) for m in (answered, probed))
    assert len(got) == len(rows) + 30 and got == want
    short = lambda r: (r.doc_id, r.n_words, round(r.log_prob, 6))
    assert len(others) > 100 and {short(r) for r in others} <= {short(r) for r in M.score(docs, probed).collect()}


# --- the pipeline


def test_pipeline(spark, tmp_path, odd, clashing, empty):
    rows = toxic_corpus(random.Random(9), 200)
    line = "this line stands in many documents of the table"
    rows += [(300 + k, line + "\n" + prose(random.Random(k), 50), 0) for k in range(4)] + [(400, rows[1][1] + " tail", 0)]
    item = prose(random.Random(99), 30)
    rows += [(500, prose(random.Random(98), 40) + " " + item, 0)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], odd.schema)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, _, y in rows[:200]], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id: r for r in P.run(spark, str(tmp_path)).collect()}
    assert set(out) == {i for i, _, y in rows if not y} - {400, 500}
    assert out[300].text.startswith(line) and all(line not in out[300 + k].text and out[300 + k].n_chars == len(out[300 + k].text) for k in (1, 2, 3))
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in out.values())
    for name, stage in P.STAGES:
        for d in (clashing, empty):
            got = stage(spark, d, str(tmp_path))
            assert got.columns[: len(d.columns)] == d.columns and (name == P.STAGES[-1][0] or got.columns == d.columns)
            assert got.count() <= d.count() and (got.count() > 0 or d is empty)
