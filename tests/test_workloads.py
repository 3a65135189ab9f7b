"""Programs of the kinds that analyses of code are made of, over generated facts, against the naive evaluator."""

import random

import pytest
from naive import evaluate

from rulespan.engine import Engine
from rulespan.plans.program import Program

POINTS_TO = """
holds(P, Obj) :- takes(P, Obj).
holds(P, Obj) :- copies(P, Q), holds(Q, Obj).
holds(P, Obj) :- reads(P, Q), holds(Q, Mid), holds(Mid, Obj).
holds(Mid, Obj) :- writes(P, Q), holds(P, Mid), holds(Q, Obj).
"""

ALIASES = """
flows(To, From) :- moves(To, From).
flows(A, A) :- moves(A, _).
flows(A, A) :- moves(_, A).
flows(To, From) :- moves(To, Z), same_place(Z, From).
flows(To, From) :- flows(To, Z), flows(Z, From).
same_place(X, W) :- derefs(Y, X), same_value(Y, Z), derefs(Z, W).
same_value(X, Y) :- flows(Z, X), flows(Z, Y).
same_value(X, Y) :- flows(Z, X), same_place(Z, W), flows(W, Y).
same_place(A, A) :- moves(_, A).
same_place(A, A) :- moves(A, _).
"""

BRACKETS = """
match(X, X) :- open_a(X, _).
match(X, Y) :- open_a(X, U), match(U, V), close_a(V, Y).
match(X, Y) :- open_a(X, U), close_a(U, Y).
match(X, Y) :- open_b(X, U), match(U, V), close_b(V, Y).
match(X, Y) :- open_b(X, U), close_b(U, Y).
match(X, Y) :- match(X, Z), match(Z, Y).
"""

BLOCKS = """
code(E) :- start(E).
code(To) :- code(E), after(E, To), !stops(E).
code(To) :- code(E), jumps(E, To).
head(E) :- start(E).
head(To) :- jumps(E, To), code(E).
member(E, E) :- head(E).
member(To, B) :- member(E, B), after(E, To), !stops(E), !head(To).
link(B, To) :- member(E, B), jumps(E, To).
link(B, To) :- member(E, B), after(E, To), !stops(E), head(To).
live(B) :- start(B).
live(C) :- live(B), link(B, C).
dead(B) :- head(B), !live(B).
size(B, count(E)) :- member(E, B).
"""

LOANS = """
holds_at(O, L, P) :- issued(O, L, P).
holds_at(O, L, Q) :- holds_at(O, L, P), goes(P, Q), !killed(L, P), lives(O, Q).
holds_at(To, L, P) :- holds_at(From, L, P), outlives(From, To, P).
active(L, P) :- holds_at(O, L, P), lives(O, P).
error(L, P) :- broken(L, P), active(L, P).
"""

ONTOLOGY = """
isa(X, Z) :- isa(X, Y), isa(Y, Z).
isa(X, Z) :- both(Y, W, Z), isa(X, Y), isa(X, W).
has(X, V, Z) :- isa(X, Y), some(Y, V, Z).
has(X, V, Z) :- has(X, U, Z), wider(U, V).
isa(X, E) :- has(X, V, Y), isa(Y, W), any(V, W, E).
isa(X, Y) :- said(X, Y).
"""


def facts(rng, n, *arities, low=0):
    return [{tuple(rng.randrange(low, n) for _ in range(a)) for _ in range(n)} for a in arities]


def made(name, rng):
    if name == "points_to":
        return POINTS_TO, dict(zip(("takes", "copies", "reads", "writes"), facts(rng, 14, 2, 2, 2, 2)))
    if name == "aliases":
        return ALIASES, dict(zip(("moves", "derefs"), facts(rng, 9, 2, 2)))
    if name == "brackets":
        return BRACKETS, dict(zip(("open_a", "close_a", "open_b", "close_b"), facts(rng, 10, 2, 2, 2, 2)))
    if name == "blocks":
        n = 40
        return BLOCKS, {"start": {(0,)}, "after": {(k, k + 1) for k in range(n)}, "stops": {(k,) for k in range(6, n, 7)}, "jumps": {(rng.randrange(n), rng.randrange(n)) for _ in range(6)}}
    if name == "loans":
        goes = {(k, k + 1) for k in range(12)} | {(11, 3)}
        issued, outlives, lives, killed, broken = facts(rng, 6, 3, 3, 2, 2, 2)
        return LOANS, {"goes": goes, "issued": issued, "outlives": outlives, "lives": {(o, p) for o in range(6) for p in range(12) if rng.random() < 0.8} | lives, "killed": killed, "broken": broken}
    return ONTOLOGY, dict(zip(("said", "both", "some", "wider", "any"), facts(rng, 8, 2, 3, 3, 2, 3)))


@pytest.mark.parametrize("name", ["points_to", "aliases", "brackets", "blocks", "loans", "ontology"])
def test_program(spark, name):
    text, data = made(name, random.Random(name))
    p = Program.parse(text)
    e = Engine(spark, p, {r: spark.createDataFrame(sorted(v), ", ".join(f"c{k} long" for k in range(len(next(iter(v)))))) for r, v in data.items()}, sets=set(data), unroll=1)
    want = evaluate(p, data)
    for rel in p.idb:
        got = [tuple(r) for r in e.relation(rel).collect()]
        assert len(got) == len(set(got)) and set(got) == want[rel], rel
