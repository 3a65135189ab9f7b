import random

import pytest
from naive import evaluate

from rulespan.engine import Engine, register_function
from rulespan.operators.fixpoint import IterationLimitError, doubled
from rulespan.plans.program import ArityError, Program, ProgramError


def rows(df):
    out = [tuple(r) for r in df.collect()]
    assert len(out) == len(set(out)), "a relation is a set"
    return set(out)


def check(spark, text, inputs=None, schemas=None, **options):
    p = Program.parse(text, options.pop("extended", False))
    frames = {r: spark.createDataFrame(sorted(v), schemas[r]) for r, v in (inputs or {}).items()}
    e = Engine(spark, p, frames, **options)
    want = evaluate(p, inputs)
    for rel in p.idb:
        assert rows(e.relation(rel)) == want[rel], rel
    return e


def path(n):
    return "".join(f"e({k}, {k + 1}). " for k in range(1, n + 1))


CHAIN = path(99)


def test_chain_closure(spark):
    e = check(spark, CHAIN + "tc(a, b) :- e(a, b).\ntc(a, c) :- tc(a, b), tc(b, c).")
    assert e.count("tc") == 4950 and len(e.passes) <= 10


def test_doubling_and_unrolling(spark):
    text = "".join(f"e({k}, {k + 1}). " for k in range(1, 24)) + "e(24, 5).\ntc(a, b) :- e(a, b).\ntc(a, c) :- tc(a, b), e(b, c)."
    a, b = check(spark, text, doubling=True), check(spark, text, unroll=3)
    c = Engine(spark, text, unroll=1)
    assert c.count("tc") == a.count("tc") == b.count("tc") and len(b.passes) < len(c.passes)
    assert len(doubled(Program.parse(text).rules)) == 2
    other = tuple(Program.parse("tc(a, b) :- e(a, b).\ntc(a, c) :- tc(a, b), e(c, b).").rules)
    assert doubled(other) == other


def test_core_forms(spark):
    check(
        spark,
        """
        e(1, 2). e(2, 2). e(2, 3). e(3, 3). n(1). n(2). n(5). w("a", 1). w("bb", 2).
        loop(x) :- e(x, x).
        to3(x) :- e(x, 3).
        pairs(x, y) :- n(x), n(y), x < y.
        calc(x, x + 2 * 3 - 1, x / 2, x % 2, x / z) :- n(x), z = x - 1.
        lonely(x) :- n(x), !e(x, _).
        nothing(x) :- n(x), !e(_, _).
        none(x) :- n(x), False.
        all(x) :- n(x), True.
        u(x) :- e(x, _). u(y) :- e(_, y). u(7).
        deg(x, count(y)) :- e(x, y).
        stat(min(y), x, max(y), sum(y)) :- e(x, y).
        total(count(x)) :- n(x).
        zero(count(x)) :- n(x), x > 100.
        wide(c, count(i)) :- e(i, _), n(c).
        len(s, strlen(s)) :- w(s, _).
        both(x) :- n(x), 2 = x.
        const(1, "x") :- True.
        triangle(x, y, z) :- e(x, y), e(y, z), n(x).
        missing(x) :- n(x), nowhere(x).
        kept(x) :- n(x), !nowhere(x).
        """,
    )


def test_mutual_recursion_and_seeds(spark):
    check(spark, path(30) + "e(31, 4).\nred(1).\nblue(y) :- red(x), e(x, y).\nred(y) :- blue(x), e(x, y).\nbad(x) :- red(x), blue(x).\nquiet(x) :- e(x, _), !bad(x).")


def test_several_recursive_atoms(spark):
    check(spark, "a(1, 2). a(2, 3). b(3, 4). b(4, 5). a(5, 1).\np(x, y) :- a(x, y).\np(x, y) :- b(x, y).\np(x, w) :- p(x, y), p(y, z), p(z, w).\nq(x, y) :- p(x, y), p(y, x).")


def test_recursive_minimum(spark):
    text = "w(1, 2, 5). w(2, 3, 1). w(1, 3, 9). w(3, 1, 1). w(3, 4, 2). w(4, 2, 1).\ndist(1, 0).\ndist(y, min(d + c)) :- dist(x, d), w(x, y, c).\nfar(max(d)) :- dist(_, d)."
    check(spark, text)
    check(spark, "e(6, 5). e(5, 6). e(2, 3). e(1, 2).\ncc(x, min(x)) :- e(x, _).\ncc(y, min(y)) :- e(_, y).\ncc(y, min(l)) :- cc(x, l), e(x, y).\ncc(x, min(l)) :- cc(y, l), e(x, y).")


def test_random_programs(spark):
    rng = random.Random(5)
    bodies = ["e(x, y)", "f(y, z)", "p(x, y)", "p(y, z)", "!f(x, x)", "x != y", "x < y", "g(y)"]
    for _ in range(3):
        text = [".decl e(a: int64, b: int64)\n.decl f(a: int64, b: int64)\n.decl g(a: int64)\np(x, y) :- e(x, y)."]
        for _ in range(3):
            body = ["e(x, y)" if rng.random() < 0.5 else "p(x, y)", *rng.sample(bodies, 2)]
            head = rng.choice(["p(x, y)", "p(y, x)", "q(x, y)", "p(y, y)"])
            text.append(f"{head} :- {', '.join(body)}.")
        text.append("r(x, count(y), max(y)) :- p(x, y).\ns(x) :- g(x), !p(x, _).")
        data = {"e": {(rng.randrange(6), rng.randrange(6)) for _ in range(7)}, "f": {(rng.randrange(6), rng.randrange(6)) for _ in range(4)}, "g": {(rng.randrange(6),) for _ in range(3)}}
        check(spark, "\n".join(text), data, {"e": "a long, b long", "f": "a long, b long", "g": "a long"})


def test_iteration_limit_raises(spark):
    with pytest.raises(IterationLimitError):
        Engine(spark, "n(1).\nn(x + 1) :- n(x).", max_iterations=5).relation("n")


def test_magic_sets(spark):
    text = path(20) + "e(50, 51).\ntc(a, b) :- e(a, b).\ntc(a, c) :- e(a, b), tc(b, c)."
    full = Engine(spark, text)
    part = Engine(spark, text)
    assert rows(part.query("tc", {0: 15})) == {r for r in rows(full.relation("tc")) if r[0] == 15}
    assert part.magic_stats.adorned and sum(n for p in part.passes for r, n in p.rows.items() if r.startswith("tc__")) < full.count("tc")
    assert rows(part.query("tc", {0: 15, 1: 17})) == {(15, 17)} and rows(part.query("tc", {1: 3})) == {(1, 3), (2, 3)}
    sg = "up(1, 5). up(2, 5). up(3, 6). up(5, 7). up(6, 7).\nsg(x, y) :- up(x, p), up(y, p), x != y.\nsg(x, y) :- up(x, a), sg(a, b), up(y, b).\nodd(x) :- up(x, _), !sg(x, _).\nsg(9, 9)."
    assert rows(Engine(spark, sg.replace("odd(x) :- up(x, _), !sg(x, _).", "")).query("sg", {0: 1})) == {(1, 2), (1, 3)}
    assert rows(Engine(spark, sg).query("odd", {0: 7})) == set()
    with pytest.raises(ProgramError):
        Engine(spark, text).query("tc", {0: 1}, "bf")


def test_inputs(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (2, 3)], "a int, b int")
    e = Engine(spark, ".decl e(x: int32, y: int32)\nn(count(x)) :- e(x, _).\nt(x, y) :- e(x, y).", {"e": df})
    assert rows(e.relation("n")) == {(2,)} and rows(e.relation("t")) == {(1, 2), (2, 3)}
    with pytest.raises(ArityError):
        Engine(spark, ".decl e(x: int32)\nt(x) :- e(x).", {"e": df})
    with pytest.raises(ProgramError):
        Engine(spark, "t(x) :- e(x).", {"other": df})


def test_kinds_are_checked(spark):
    for text in ('e(1).\nt(x) :- e(x), x = "a".', 'e("a").\nt(x + 1) :- e(x).', '.decl t(x: string)\ne(1).\nt(x) :- e(x).', "e(1).\nt(strlen(x)) :- e(x).", 'e(1). f("a").\nt(x) :- e(x), f(x).'):
        with pytest.raises(ProgramError):
            Engine(spark, text).relation("t").collect()


def test_named_graphs_and_compounds(spark):
    text = '.decl quad(s: string, p: string, __graph_id: int64)\nquad("a", "p", 1). quad("b", "p", 2).\n__graph_metadata(1, 98, 0, 0, 0, 0). __graph_metadata(2, 7, 0, 0, 0, 0).\nsafe(a, b) :- quad(a, b, h), __graph_metadata(h, 98, _, _, _, _).'
    assert rows(Engine(spark, text).relation("safe")) == {("a", "p")}
    empty = ".decl t(s: int64)\nt(1).\nq(s) :- t(s), __graph_metadata(s, _, _, _, _, _)."
    assert rows(Engine(spark, empty).relation("q")) == set()
    text = '.decl ev(id: int64, pt: point/2 inline)\nev(1, point(3, "n")). ev(2, point(4, "m")).\nx(i, a) :- ev(i, point(a, _)).\ny(i) :- ev(i, point(a, "m")), a > 3.\nz(i) :- ev(i, line(_, _)).\n.decl flip(i: int64, p: pair/2)\nflip(i, pair(b, a)) :- ev(i, point(a, b)).\n.decl back(i: int64, b: string)\nback(i, b) :- flip(i, pair(b, _)).'
    e = Engine(spark, text, extended=True)
    assert rows(e.relation("x")) == {(1, 3), (2, 4)} and rows(e.relation("y")) == {(2,)} and rows(e.relation("z")) == set()
    assert rows(e.relation("back")) == {(1, "n"), (2, "m")}


def test_zero_arity(spark):
    e = Engine(spark, "e(1). e(2).\nyes() :- e(2).\nno() :- e(3).\nq(x) :- e(x), yes().\nr(x) :- e(x), no().\ns(x) :- e(x), !no().\nt(x) :- yes(), e(x).")
    assert e.count("yes") == 1 and e.count("no") == 0
    assert rows(e.relation("q")) == rows(e.relation("s")) == rows(e.relation("t")) == {(1,), (2,)} and rows(e.relation("r")) == set()


def test_own_function(spark):
    from pyspark.sql import functions as F

    register_function("twice", ("int",), "int", lambda c: c * 2)
    assert rows(Engine(spark, "e(4).\nt(twice(x)) :- e(x).").relation("t")) == {(8,)}
    assert F is not None


def test_printsize_and_outputs(spark, tmp_path):
    text = '.printsize t\n.output t(filename="t.csv")\n.output u\ne(1, "b"). e(2, "a").\nt(y, x) :- e(x, y).\nu(x) :- e(x, _).\nv(x) :- e(x, _).'
    e = Engine(spark, text, base_dir=str(tmp_path))
    assert e.sizes() == {"t": 2} and e.write_outputs() == ["u"] and set(e.run()) == {"t", "u"}
    assert sorted((tmp_path / "t.csv").read_text().splitlines()) == ["a,2", "b,1"]
