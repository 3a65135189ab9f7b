import pytest

from rulespan.plans.program import ArityError, NotStratifiableError, Program, ProgramError, UnsafeRuleError
from rulespan.plans.syntax import Agg, Atom, Call, Column, Compare, Compound, Const, DatalogSyntaxError, Op, Var, Wild, parse


def test_declarations():
    t = parse(".decl r(a: int32, b: int64, c: string, d: symbol, e: point/2 inline, f: tag/1)")
    assert [c.type for c in t.relations["r"].columns] == ["int32", "int64", "string", "symbol", "point", "tag"]
    assert t.relations["r"].columns[4] == Column("e", "point", 2, "inline") and t.relations["r"].columns[5].tier == "side"


@pytest.mark.parametrize("text", [".decl r(a: float)", ".decl r(a: p/0)", ".decl r(a: p/5 inline)", ".decl r(a int32)", ".decl r(a: int32, a: int32)", ".decl count(a: int32)", ".bogus r", "r(x).", "r(1)", "r(x) :- .", "r(x) :- s(x)", 'r("a', "r(x) :- s(x), x.", "r(x) :- hash(x).", ".input r", ".query r(b, x) .", ".query r(b)", "r(f(1)).", "r(99999999999999999999).", "r(x) :- s(x), band(x) = 1.", "r(-1).", "/* open"])
def test_errors_have_places(text):
    with pytest.raises(DatalogSyntaxError) as e:
        parse(text)
    assert e.value.line == 1 and e.value.col >= 1 and "line 1, col" in str(e.value)


def test_error_line():
    with pytest.raises(DatalogSyntaxError) as e:
        parse("r(1).\n# note\nr(x) :- s(x),, t(x).")
    assert e.value.line == 3


def test_directives():
    t = parse('.input r(filename="f.csv", delimiter=",")\n.input s("g.csv")\n.output r\n.output s("o.csv")\n.output u(filename="p.csv")\n.printsize r\n.query r(b, f) .')
    assert t.relations["r"].inputs == [{"filename": "f.csv", "delimiter": ","}]
    assert t.relations["s"].inputs == [{"filename": "g.csv"}] and t.relations["s"].outputs == [{"filename": "o.csv"}]
    assert t.relations["r"].printsize and t.relations["r"].queries == ["bf"] and t.relations["r"].outputs == [{}]


def test_left_association_without_precedence():
    r = parse("r(a + b * c) :- s(a, b, c).").rules[0]
    assert r.args[0] == Op("*", Op("+", Var("a"), Var("b")), Var("c"))
    assert parse("r(a + (b * c)) :- s(a, b, c).", extended=True).rules[0].args[0] == Op("+", Var("a"), Op("*", Var("b"), Var("c")))


def test_comments_wildcards_and_plan():
    t = parse("// one\n# two\n/* three\n lines */ r(x) :- s(x, _, __). .plan\nr(_x) :- s(_x, _x, _x).")
    assert t.rules[0].planned and not t.rules[1].planned
    assert t.rules[0].body[0].args[1:] == (Wild(), Wild()) and t.rules[1].args == (Var("_x"),)


def test_body_forms():
    r = parse('r(x, count(y), AVG(y)) :- s(x, f(y, g(3))), !t(x, _), x != 3, contains(x, "a"), True.').rules[0]
    assert r.body[0] == Atom("s", (Var("x"), Compound("f", (Var("y"), Compound("g", (Const(3),))))))
    assert r.body[1].negated and r.body[2] == Compare("!=", Var("x"), Const(3)) and r.args[1] == Agg("count", Var("y")) and r.args[2].fn == "avg"
    assert r.body[3].call == Call("contains", (Var("x"), Const("a")))


def test_facts_and_undeclared_columns():
    p = Program.parse('e(1, "a"). e(2, "b").\nr(y, x) :- e(x, y).')
    assert p.facts("e") == [(1, "a"), (2, "b")]
    assert [c.type for c in p.columns["r"]] == ["string", "int64"] and p.columns["e"][1].name == "col1"


def test_strata():
    p = Program.parse("a(x) :- e(x).\nb(x) :- a(x), !c(x).\nc(x) :- e(x), d(x).\nd(x) :- c(x).\nd(1).")
    assert p.rule_count == 4 and p.is_stratified
    order = {r: s.id for s in p.strata for r in s.relations}
    assert order["c"] == order["d"] < order["b"] and [s.recursive for s in p.strata if "c" in s.relations] == [True]
    assert p.affected({"d"}) == {"c", "d", "b"} and "recursive" in p.explain()


@pytest.mark.parametrize(
    "text, error",
    [
        ("p(x) :- e(x), !q(x).\nq(x) :- e(x), p(x).", NotStratifiableError), ("p(x) :- e(x), !p(x).", NotStratifiableError), ("p(x, count(y)) :- p(y, x).", NotStratifiableError),
        ("p(x, sum(y)) :- e(x, y).\np(x, sum(y)) :- p(x, y).", NotStratifiableError), ("p(y) :- e(x).", UnsafeRuleError), ("p(x) :- e(x), y > 1.", UnsafeRuleError), ("p(1) :- !e(1).", UnsafeRuleError),
        ("p(x) :- e(x).\np(x, y) :- e(x), e(y).", ArityError), ("e(1). e(1, 2).", ArityError), (".decl __graph_metadata(a: int64)\np(x) :- e(x).", ProgramError),
    ],
)
def test_program_errors(text, error):
    with pytest.raises(error):
        Program.parse(text)


def test_declared_twice():
    parse(".decl r(a: int32)\n.decl r(a: int32)")
    with pytest.raises(DatalogSyntaxError):
        parse(".decl r(a: int32)\n.decl r(b: int32)")


def test_deep_compounds():
    with pytest.raises(DatalogSyntaxError):
        parse("r(x) :- s(" + "f(" * 70 + "x" + ")" * 70 + ").")
