"""Joins whose result is much larger than what is joined."""

from collections import Counter

import pytest

from rulespan.engine import Engine
from rulespan.operators import signed, wide


@pytest.fixture
def small(monkeypatch):
    """Limits at which small tables are wide."""
    for name, n in (("SLICE", 50), ("LEAST_BYTES", 1), ("MULTIPLES", 0)):
        monkeypatch.setattr(wide, name, n)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


TEXT = ".decl n(n: int64, x: string)\n.decl c(c: int64, n: int64, x: int64)\n.decl s(s: int64, n: int64, x: int64)\n"


def test_multiway_rule_repeats_nothing(spark, small):
    """the result isn't made distinct; the atoms are."""
    n = [(k, "x") for k in range(3)]
    c = [(k, k % 4, 0) for k in range(80)]
    s = [(k % 10, k % 10 % 4, k) for k in range(60)]
    inputs = {"n": spark.createDataFrame(n, "n long, x string"), "c": spark.createDataFrame(c, "c long, n long, x long"), "s": spark.createDataFrame(s, "s long, n long, x long")}
    q = Engine(spark, TEXT + ".decl q(n: int64, c: int64, s: int64)\nq(N, C, S) :- n(N, _), c(C, N, _), s(S, N, _).", inputs, sets=frozenset(inputs)).relation("q")
    want = {(b, a, d) for a, b, _ in c for d, e, _ in s if b == e and b < 3}
    got = [tuple(r) for r in q.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "Aggregate" not in plan(q)


@pytest.mark.parametrize("again", [0, 30])
def test_theta_rule_with_and_without_a_key(spark, small, again):
    """where a column tells the row, pairs aren't made distinct; rows that share it with others are right as well."""
    s = [(k, k % 2, k * 7 % 40) for k in range(40)] + [(k, (k + k // 2) % 2, k * 3 % 50) for k in range(again)]
    df = spark.createDataFrame(s, "s long, n long, x long")
    q = Engine(spark, TEXT + ".decl q(a: int64, b: int64)\nq(A, B) :- s(A, N, X), s(B, N, Y), X > Y, A != B.", {"s": df}).relation("q")
    want = {(a, b) for a, n, x in s for b, m, y in s if n == m and x > y and a != b}
    got = [tuple(r) for r in q.collect()]
    assert len(got) == len(want) and set(got) == want
    assert ("Aggregate" in plan(q)) == bool(again)


def test_placed_join_cuts_large_keys(spark, small):
    """no partition has all of a large key; keys and repetitions are as many as before."""
    a, b, c = [(0,), (1,), (2,)], [(0, k % 90) for k in range(100)] + [(1, 5), (1, 5)], [(0, k) for k in range(30)] + [(1, 7), (3, 7)]
    q = signed.multiway_join([spark.createDataFrame(a, "k long"), spark.createDataFrame(b, "k long, b long"), spark.createDataFrame(c, "k long, c long")], "k", 2)
    assert Counter(tuple(r) for r in q.collect()) == Counter((k, x, y) for (k,) in a for m, x in b if m == k for o, y in c if o == k)
    assert max(q.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) <= 1500
    assert q.rdd.getNumPartitions() > 2
