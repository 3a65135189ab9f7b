"""Stores, maintained sessions, semi-joins and what the plans look like."""

import os
import random

import pytest

from rulespan.engine import Engine
from rulespan.functions.scalar import crc32c, crc32c_tables
from rulespan.operators.rules import existential
from rulespan.operators.store import COMPACT, Part, Store
from rulespan.plans.program import NotStratifiableError, Program, ProgramError
from rulespan.streaming import session
from rulespan.streaming.session import Session

TC = ".decl e(a: int64, b: int64)\n.decl p(a: int64, b: int64)\np(A, B) :- e(A, B).\np(A, C) :- p(A, B), e(B, C)."


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_store_adds_and_takes_away(spark, tmp_path):
    rng, want = random.Random(1), set()
    schema = spark.createDataFrame([], "x long, y string").schema
    s = Store(spark, schema, str(tmp_path))
    assert rows(s.df) == []
    for k in range(COMPACT + 3):
        new = {(rng.randrange(40), str(rng.randrange(2))) for _ in range(12)}
        found = s.write(spark.createDataFrame(sorted(new), schema))
        fresh = s.write(s.absent_small(found))
        assert rows(s.read(fresh)) == sorted(new - want) == rows(s.absent(s.read(found)))
        s.add(fresh)
        want |= new
        if k % 3 == 2:
            out = set(rng.sample(sorted(want), 5))
            s.add(s.write(spark.createDataFrame(sorted(out), schema), gone=True))
            want -= out
        assert rows(s.df) == sorted(want)
        s.compact()
        assert rows(s.df) == sorted(want) and len(s.parts) <= COMPACT
    more, less = s.write_signed(spark.createDataFrame([(1, "z", 1), (2, "z", -1), (3, "z", 0)], "x long, y string, __diff long"))
    assert (more.n, less.n) == (1, 1) and rows(s.read(more)) == [(1, "z")] and rows(s.read(less)) == [(2, "z")]
    s.drop_tables()
    assert not [t for t in spark.catalog.listTables() if t.name in s.tables]


def test_only_what_is_new_is_shuffled(spark, tmp_path):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).selectExpr("id % 10 as x", "id as y")
        s = Store(spark, df.schema, str(tmp_path / "s"))
        s.add(s.write_bucketed(df), s.write_bucketed(df.selectExpr("x", "y + 1000 as y")))
        new = spark.range(500, 2500).selectExpr("id % 10 as x", "id as y").distinct()
        fresh = s.absent(new)
        assert plan(fresh).count("Exchange hashpartitioning") == 1 and plan(fresh).count("Bucketed: true") == 2
        assert fresh.count() == 500
        keyed = Store(spark, df.schema, str(tmp_path / "k"), ["x"])
        keyed.add(keyed.write_bucketed(df.groupBy("x").agg({"y": "min"}).toDF("x", "y")))
        better = keyed.absent(spark.createDataFrame([(1, 0), (2, 2), (3, 9), (77, 5)], df.schema).groupBy("x").agg({"y": "min"}).toDF("x", "y"), "min")
        assert plan(better).count("Exchange hashpartitioning") == 1 and rows(better) == [(1, 0), (77, 5)]
        s.drop_tables(), keyed.drop_tables()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_steps_write_what_they_change(spark):
    def written(s):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(s.folder.removeprefix("file://")) for f in fs)

    with Session(spark, TC) as s:
        s.insert("e", spark.range(4000).selectExpr("id * 2 as a", "id * 2 + 1 as b"))
        s.step_frame()
        whole = written(s)
        s.insert("e", (1, 2))
        assert rows(s.step_frame()["p"]) == [(0, 2, 1), (0, 3, 1), (1, 2, 1), (1, 3, 1)] and s.steps[-1]["strata"] == [(0, "continued")]
        s.remove("e", (1, 2))
        assert {r[2] for r in rows(s.step_frame()["p"])} == {-1} and s.steps[-1]["strata"] == [(0, "continued")]
        assert written(s) - whole < whole and s.state["p"].count() == 4000
    with pytest.raises(ProgramError):
        s.insert("e", (1, 2))
    assert not os.path.exists(s.folder.removeprefix("file://"))


def test_rederivation(spark, monkeypatch):
    """Other derivations, cycles, given rows of a derived relation, and removals with insertions in one step; the last step by frames."""
    text = TC + "\n.decl q(a: int64)\nq(A) :- p(A, _), p(_, A).\nq(A * 2) :- e(A, A)."
    s, edges = Session(spark, text), {(1, 2), (2, 3), (3, 1), (1, 3), (3, 4), (5, 5)}
    s.insert("e", *sorted(edges))
    s.insert("p", (7, 8), (1, 4))
    s.step_frame()
    for k, (gone, new) in enumerate((({(3, 1), (5, 5), (2, 3)}, {(4, 5)}), ({(1, 3)}, {(3, 1), (2, 3)}))):
        if k == 1:
            monkeypatch.setattr(session, "FEW_ROWS", 0)
        edges = (edges - gone) | new
        before = {r: set(rows(s.state[r])) for r in ("p", "q")}
        if gone:
            s.remove("e", *sorted(gone))
        if new:
            s.insert("e", *sorted(new))
        out = s.step_frame()
        e = Engine(spark, text, {"e": spark.createDataFrame(sorted(edges), "a long, b long"), "p": spark.createDataFrame([(7, 8), (1, 4)], "a long, b long")})
        assert all(how == "continued" for _, how in s.steps[-1]["strata"])
        for r in ("p", "q"):
            now = set(rows(e.relation(r)))
            assert set(rows(s.state[r])) == now, r
            told = {tuple(x) for x in out[r].collect()} if r in out else set()
            assert told == {(*t, 1) for t in now - before[r]} | {(*t, -1) for t in before[r] - now}, r
    monkeypatch.undo()
    s.remove("p", (7, 8), (1, 4))
    assert (7, 8, -1) in rows(s.step_frame()["p"]) and (1, 4) in rows(s.state["p"])


def test_existential_atoms_are_semijoins(spark):
    text = ".decl a(x: int64, y: int64)\n.decl b(y: int64, z: int64)\n.decl q(x: int64, y: int64)\nq(X, Y) :- a(X, Y), b(Y, Z), b(Z, _)."
    a, b = spark.createDataFrame([(1, 2), (1, 5), (3, 2)], "x long, y long"), spark.createDataFrame([(2, 4), (2, 2), (5, 6)], "y long, z long")
    e = Engine(spark, text, {"a": a, "b": b}, sets={"a", "b"})
    assert rows(e.relation("q")) == [(1, 2), (3, 2)]
    text = ".decl a(x: int64, y: int64)\n.decl b(y: int64, z: int64)\n.decl q(x: int64, y: int64)\nq(X, Y) :- a(X, Y), b(Y, _)."
    df = Engine(spark, text, {"a": a, "b": b}, sets={"a", "b"}).relation("q")
    assert rows(df) == [(1, 2), (1, 5), (3, 2)] and "LeftSemi" in plan(df) and "HashAggregate" not in plan(df)
    of = lambda t: existential(Program.parse(".decl a(x: int64, y: int64)\n.decl b(y: int64, z: int64)\n" + t).rules[0])
    assert of("q(X) :- a(X, Y), b(Y, _).") == [1] and of("q(X, Z) :- a(X, Y), b(Y, Z).") == [] and of("q(X, count(Y)) :- a(X, Y), b(Y, _).") == []
    assert of("q(X) :- a(X, Y), b(Y, Z), Z > 3.") == [] and of("q(X) :- a(X, _), b(_, _).") == []


def test_nulls_fail_or_are_dropped(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "x long, y long")
    text = ".decl o(x: int64, y: int64)\nq(X) :- o(X, _)."
    with pytest.raises(Exception, match="null"):
        Engine(spark, text, {"o": df}).relation("q").collect()
    assert rows(Engine(spark, text, {"o": df}, nulls="drop").relation("q")) == [(2,)]
    s = Session(spark, text)
    s.insert("o", df)
    with pytest.raises(Exception, match="null"):
        s.step()
    s = Session(spark, text, nulls="drop")
    s.insert("o", df)
    assert s.step() == [("q", (2,), 1)]


def test_is_stratified():
    bad = "p(X) :- e(X), !q(X).\nq(X) :- e(X), !p(X)."
    with pytest.raises(NotStratifiableError):
        Program.parse(bad)
    assert not Program.parse(bad, strict=False).is_stratified and Program.parse(TC).is_stratified


def test_crc32c_of_any_length():
    def one(x):
        c = 0xFFFFFFFF
        for b in x:
            c ^= b
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    rng = random.Random(2)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 3, 255, 256, 257, 512, 1000, 5000)]
    assert crc32c(texts, crc32c_tables()).tolist() == [one(x) for x in texts] and len(crc32c([], crc32c_tables())) == 0


def test_hmac_with_long_and_other_keys(spark):
    import hashlib
    import hmac

    key = "é" * 50
    df = spark.createDataFrame([("m", "k")], "m string, k string")
    out = Engine(spark, f'.decl e(m: string, k: string)\nt(hmac_sha256(M, "{key}"), hmac_sha256(M, K)) :- e(M, K).', {"e": df}).relation("t").collect()[0]
    assert tuple(out) == tuple(hmac.new(k.encode(), b"m", hashlib.sha256).hexdigest() for k in (key, "k"))


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from rulespan import shared

    class Dir:
        def isEmpty(self):
            return True

    class Context:
        applicationId, master = "none", "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Dir()})()})()

    fake = type("Spark", (), {"sparkContext": Context(), "conf": type("C", (), {"get": lambda self, *a: None})()})()
    with pytest.raises(RuntimeError):
        shared.shared_base(fake)
    assert Part("x", 1).gone is False
