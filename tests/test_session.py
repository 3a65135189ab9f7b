import random

import pytest

from rulespan.engine import Engine
from rulespan.operators import signed
from rulespan.plans.program import ArityError, ProgramError
from rulespan.streaming.session import Session

REACH = ".decl edge(a: symbol, b: symbol)\n.decl hop(a: symbol, b: symbol)\nhop(A, B) :- edge(A, B).\nhop(A, C) :- hop(A, B), edge(B, C)."


def changes(out):
    return {(row, d) for _, row, d in out}


def test_mutual_friends(spark):
    seen = []
    s = Session(spark, ".decl likes(a: symbol, b: symbol)\nboth(P, Q) :- likes(P, Q), likes(Q, P).", on_delta=lambda *x: seen.append(x))
    s.insert("likes", ("ann", "bert"), ("bert", "ann"))
    assert changes(s.step()) == {(("ann", "bert"), 1), (("bert", "ann"), 1)}
    s.insert("likes", ("ann", "cleo"))
    assert s.step() == []
    s.remove("likes", ("bert", "ann"))
    assert changes(s.step()) == {(("ann", "bert"), -1), (("bert", "ann"), -1)}
    assert len(seen) == 4


def test_reach_under_update(spark):
    s = Session(spark, REACH)
    s.insert("edge", ("a", "b"), ("b", "c"), ("c", "d"))
    assert len(s.step()) == 6
    s.remove("edge", ("b", "c"))
    assert changes(s.step()) == {((x, y), -1) for x, y in (("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"))}
    s.insert("edge", ("b", "c"))
    assert len(s.step()) == 4 and s.steps[-1]["strata"] == [(0, "continued")]
    assert s.step() == []


def test_copies_and_missing_rows(spark):
    s = Session(spark, ".decl e(x: int64)\nt(X) :- e(X).")
    s.insert("e", (1,), (1,))
    s.remove("e", (2,))
    assert changes(s.step()) == {((1,), 1)}
    s.remove("e", (1,))
    assert s.step() == []
    s.remove("e", (1,))
    s.insert("e", (3,))
    assert changes(s.step()) == {((1,), -1), ((3,), 1)}
    s.remove("e", (3,))
    s.insert("e", (3,))
    assert s.step() == []
    with pytest.raises(ArityError):
        s.insert("e", (1, 2))
    with pytest.raises(ProgramError):
        s.insert("f", (1,))
    with pytest.raises(ProgramError):
        s.insert("e", ("x",))


def test_snapshot_facts_and_untouched_strata(spark):
    s = Session(spark, 'e(1).\n.decl e(x: int64)\n.decl f(x: int64)\nt(X) :- e(X).\nu(X) :- f(X).\nn(count(X)) :- f(X).\nw(X) :- e(X), !f(X).')
    assert {tuple(r) for r in s.snapshot("t").collect()} == {(1,)}
    s.insert("f", (7,))
    out = s.step()
    assert ("u", (7,), 1) in out and ("n", (1,), 1) in out and all(r != "t" for r, _, _ in out)
    s.insert("f", (1,))
    out = s.step()
    assert ("w", (1,), -1) in out and ("n", (1,), -1) in out and ("n", (2,), 1) in out
    assert set(s.snapshot()) == {"t", "u", "n", "w"}


def test_snapshot_leaves_changes_where_they_are(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    sizes, collect = [], Classic.collect

    def watched(df):
        rows = collect(df)
        sizes.append(len(rows))
        return rows

    monkeypatch.setattr(Classic, "collect", watched)
    told = []
    for tell in (None, lambda *x: told.append(x)):
        s = Session(spark, ".decl e(x: int64)\nt(X, 1) :- e(X).\nn(count(X)) :- t(X, _).", on_delta=tell)
        s.insert("e", spark.range(12_000).toDF("x"))
        s.snapshot("t")
        s.remove("e", spark.range(2).toDF("x"))
        assert s.snapshot("t").count() == 11_998
    assert max(sizes, default=0) <= 1
    assert told[:2] == [("t", (0, 1), 1), ("t", (1, 1), 1)] and told[12_000:] == [("n", (12_000,), 1), ("t", (0, 1), -1), ("t", (1, 1), -1), ("n", (11_998,), 1), ("n", (12_000,), -1)]


def test_large_changes_of_a_recursion_are_evaluated_anew(spark, monkeypatch):
    from rulespan.streaming import session

    monkeypatch.setattr(session, "ANEW_ROWS", 5)
    s = Session(spark, ".decl e(a: int64, b: int64)\np(A, B) :- e(A, B).\np(A, C) :- p(A, B), e(B, C).")
    edges = lambda *ks: spark.createDataFrame([(k, k + 1) for k in ks], "a long, b long")
    closed = lambda *ks: {(a, b + 1) for a in ks for b in ks if a <= b and set(range(a, b + 1)) <= set(ks)}
    s.insert("e", edges(*range(20)))
    s.step_frame()
    s.insert("e", edges(20, 21, 22))
    s.remove("e", edges(3, 9, 12, 15))
    found = changes(s.step())
    now, before = closed(*(k for k in range(23) if k not in (3, 9, 12, 15))), closed(*range(20))
    assert found == {(r, 1) for r in now - before} | {(r, -1) for r in before - now}
    assert s.steps[-1]["strata"] == [(0, "anew")] and {tuple(r) for r in s.state["p"].collect()} == now
    s.insert("e", edges(3))
    assert changes(s.step()) == {(r, 1) for r in closed(*(k for k in range(23) if k not in (9, 12, 15))) - now}
    assert s.steps[-1]["strata"] == [(0, "continued")]


def test_state_is_that_of_a_fresh_evaluation(spark):
    text = ".decl e(x: int64, y: int64)\n.decl f(x: int64)\np(X, Y) :- e(X, Y).\np(X, Z) :- p(X, Y), p(Y, Z).\nq(X) :- f(X), !p(X, X).\nm(X, max(Y)) :- p(X, Y).\np(9, 9) :- f(9)."
    rng = random.Random(3)
    s = Session(spark, text)
    have = {"e": [], "f": []}
    for _ in range(4):
        for _ in range(3):
            rel = rng.choice(["e", "e", "f"])
            row = (rng.randrange(5), rng.randrange(5)) if rel == "e" else (rng.randrange(10),)
            if have[rel] and rng.random() < 0.35:
                row = rng.choice(have[rel])
                s.remove(rel, row)
                have[rel].remove(row)
            else:
                s.insert(rel, row)
                have[rel].append(row)
        s.step_frame()
        fresh = Engine(spark, text, {"e": spark.createDataFrame(have["e"], "x long, y long"), "f": spark.createDataFrame(have["f"], "x long")})
        for rel in ("p", "q", "m"):
            assert {tuple(r) for r in s.state[rel].collect()} == {tuple(r) for r in fresh.relation(rel).collect()}, rel


def test_stream(spark, tmp_path):
    from rulespan.streaming.stream import feed

    s = Session(spark, ".decl e(x: int64, y: int64)\np(X, Y) :- e(X, Y).\np(X, Z) :- p(X, Y), e(Y, Z).")
    spark.createDataFrame([(1, 2), (2, 3)], "x long, y long").write.parquet(str(tmp_path / "in"))
    got = []
    q = feed(s, "e", spark.readStream.schema("x long, y long").parquet(str(tmp_path / "in")), lambda c, k: got.append(sorted(c)), checkpointLocation=str(tmp_path / "mark"))
    q.processAllAvailable()
    q.stop()
    assert got == [["p"]] and {tuple(r) for r in s.state["p"].collect()} == {(1, 3), (2, 3), (1, 2)}


def test_signed_relations(spark):
    a = spark.createDataFrame([("x", 2), ("y", 3)], "k string, __diff long")
    b = spark.createDataFrame([("x", -1), ("x", 4), ("z", 1)], "k string, __diff long")
    assert {tuple(r) for r in signed.join_weighted(a, b, ["k"]).collect()} == {("x", -2), ("x", 8)}
    assert {tuple(r) for r in signed.delta(b, a).collect()} == {("x", 1), ("y", -3), ("z", 1)}
    assert signed.count_weighted(b).collect()[0][0] == 4 and signed.count_weighted(b.limit(0)).collect()[0][0] == 0
    n = [spark.range(k, k + 4).withColumnRenamed("id", "k") for k in range(3)]
    assert sorted(r[0] for r in signed.multiway_join(n, "k", 2).collect()) == [2, 3]
    assert signed.exchange(n[0], 3, "k").rdd.getNumPartitions() == 3
