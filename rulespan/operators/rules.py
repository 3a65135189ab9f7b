"""One rule as one declarative DataFrame; Catalyst picks the physical plan.

Each atom becomes a selection of its relation with one column for each variable;
atoms are joined greedily along shared variables, beginning with the delta if there is one,
so that cross products come last. Comparisons are applied as soon as their variables are there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespan.functions.scalar import INT, STR, Value, compile_comparison, compile_expr
from rulespan.operators.wide import multiplies, wide_join
from rulespan.plans.program import ProgramError
from rulespan.plans.syntax import Agg, Atom, Column, Compare, Compound, Const, Predicate, Rule, Truth, Var, Wild, variables
from rulespan.shared import work_dir


@dataclass(frozen=True)
class Relation:
    """df: columns in declared order. is_set: no row is there twice."""

    df: DataFrame
    is_set: bool = False


def spark_type(c: Column, nested: dict | None = None) -> T.DataType:
    if c.arity:
        inner = (nested or {}).get(c.type) or [T.LongType()] * c.arity
        return T.StructType([T.StructField(f"arg{k}", t) for k, t in enumerate(inner)])
    return T.StringType() if c.type in ("string", "symbol") else T.LongType()


def schema_of(columns: list[Column], nested: dict | None = None) -> T.StructType:
    """Of a relation; one without columns has a hidden constant."""
    if not columns:
        return T.StructType([T.StructField("__unit", T.IntegerType())])
    return T.StructType([T.StructField(c.name, spark_type(c, nested)) for c in columns])


def kind_of(t: T.DataType) -> str:
    return STR if isinstance(t, T.StringType) else INT if isinstance(t, T.LongType) else "struct"


class Body:
    """A partial join: df with a column v_<variable> for each variable in env."""

    def __init__(self, df: DataFrame, kinds: dict[str, str]):
        self.df, self.kinds = df, kinds

    @property
    def env(self) -> dict[str, Value]:
        return {v: Value(F.col(f"v_{v}"), k) for v, k in self.kinds.items()}


def scan(relation: Relation, atom: Atom, columns: list[Column], wild: str | None = None) -> Body:
    """wild: a prefix under which columns at wildcards are kept as variables."""
    df, pick, kinds, tests = relation.df, {}, {}, []
    fields = df.schema.fields

    def bind(arg, col, t, where, declared: Column | None):
        match arg:
            case Var(n):
                if n in pick:
                    tests.append(col == pick[n])
                else:
                    pick[n], kinds[n] = col, kind_of(t)
            case Const(v):
                if kind_of(t) != (STR if isinstance(v, str) else INT):
                    raise ProgramError(f"{atom.rel}: {v!r} is compared with a column of kind {kind_of(t)}")
                tests.append(col == F.lit(v))
            case Compound(f, args):
                if not isinstance(t, T.StructType) or len(t.fields) != len(args) or (declared is not None and declared.arity and declared.type != f):
                    tests.append(F.lit(False))
                    for v in variables(arg):
                        pick.setdefault(v, F.lit(None).cast("long"))
                        kinds.setdefault(v, INT)
                    return
                tests.append(col.isNotNull())
                for k, (a, fld) in enumerate(zip(args, t.fields)):
                    bind(a, col[fld.name], fld.dataType, f"{where}_{k}", None)
            case Wild():
                if wild is not None:
                    pick[f"{wild}{where}"], kinds[f"{wild}{where}"] = col, kind_of(t)

    for k, (arg, fld) in enumerate(zip(atom.args, fields)):
        bind(arg, df[f"`{fld.name}`"], fld.dataType, str(k), columns[k] if k < len(columns) else None)
    for t in tests:
        df = df.filter(t)
    if not pick:
        return Body(df.select(F.lit(1).alias("__unit")), {})
    return Body(df.select(*[c.alias(f"v_{v}") for v, c in pick.items()]), kinds)


def order_atoms(atoms: list[tuple[int, Atom]], first: int | None) -> list[tuple[int, Atom]]:
    """Greedy: next comes the atom that shares most variables with those before, then the one with most constants, then the first in the text."""
    todo, have, out = list(atoms), set(), []
    while todo:
        if not out and first is not None:
            best = next(x for x in todo if x[0] == first)
        else:
            best = max(todo, key=lambda x: (len(have & set(variables(x[1]))), sum(isinstance(a, Const) for a in x[1].args), -x[0]))
        todo.remove(best)
        out.append(best)
        have |= set(variables(best[1]))
    return out


def join(a: Body, b: Body) -> Body:
    on = [v for v in a.kinds if v in b.kinds]
    for v in on:
        if a.kinds[v] != b.kinds[v]:
            raise ProgramError(f"{v} joins {a.kinds[v]} with {b.kinds[v]}")
    left = a.df.drop("__unit") if a.kinds else a.df
    right = b.df.drop("__unit") if b.kinds else b.df
    if on:
        df = left.join(right, [f"v_{v}" for v in on])
    elif not b.kinds:  # a test: is there any row
        df = left.join(right.select(F.lit(1).alias("__any")).limit(1), F.lit(True), "left_semi")
    elif not a.kinds:
        df = right.join(left.select(F.lit(1).alias("__any")).limit(1), F.lit(True), "left_semi")
    else:
        df = left.crossJoin(right)
    return Body(df, a.kinds | b.kinds)


def compile_body(spark: SparkSession, rule: Rule, lookup, columns: dict[str, list[Column]], first: int | None = None, semijoins: bool = False) -> Body:
    """lookup(i, atom): the relation that the i-th literal reads. first: the literal to begin with."""
    keep_wild = rule.aggregates
    scans = {}
    atoms = [(i, b) for i, b in enumerate(rule.body) if isinstance(b, Atom) and not b.negated]
    for i, a in atoms:
        scans[i] = scan(lookup(i, a), a, columns.get(a.rel, []), f"_{i}_" if keep_wild else None)
    tests = existential(rule, first) if first is None or semijoins else []
    order = order_atoms([x for x in atoms if x[0] not in tests], first)
    if semijoins and len(order) >= 3:
        scans = reduce_by_semijoins(order, scans)
    rest = [b for b in rule.body if not (isinstance(b, Atom) and not b.negated)]
    body: Body | None = None
    for i, _ in order:
        body = scans[i] if body is None else join(body, scans[i])
        body, rest = apply_tests(body, rest)
    if body is None:
        body = Body(spark.range(1).select(F.lit(1).alias("__unit")), {})
        body, rest = apply_tests(body, rest)
    for i in tests:
        on = [f"v_{v}" for v in scans[i].kinds if v in body.kinds]
        for v in on:
            if body.kinds[v[2:]] != scans[i].kinds[v[2:]]:
                raise ProgramError(f"{v[2:]} joins {body.kinds[v[2:]]} with {scans[i].kinds[v[2:]]}")
        body = Body(body.df.join(scans[i].df.select(*on), on, "left_semi"), body.kinds)
    for b in rest:
        if isinstance(b, Atom):
            body = anti(body, b, lookup(rule.body.index(b), b), columns.get(b.rel, []))
        else:
            raise ProgramError(f"line {rule.line}: a comparison has variables without a value")
    return body


def existential(rule: Rule, first: int | None = None) -> list[int]:
    """The atoms that only ask whether a row is there: they give no variable that anything else doesn't have without them.
    They become left semi-joins. Aggregates count bindings, so that none of their atoms is left out."""
    if rule.aggregates:
        return []
    keep = {i: set(variables(b)) for i, b in enumerate(rule.body) if isinstance(b, Atom) and not b.negated}
    wanted = {v for a in rule.args for v in variables(a)} | {v for b in rule.body if not (isinstance(b, Atom) and not b.negated) for v in variables(b)}
    everything, out = dict(keep), []
    for i in sorted(keep, reverse=True):
        rest = {j: v for j, v in keep.items() if j != i}
        have = set().union(*rest.values()) if rest else set()
        others = wanted.union(*(v for j, v in everything.items() if j != i))
        if i != first and everything[i] & have and everything[i] & others <= have:
            keep, out = rest, [i, *out]
    return out


def reduce_by_semijoins(order, scans):
    """Each atom is first reduced by the next one that shares variables with it."""
    out = dict(scans)
    for (i, _), (j, _) in zip(order, order[1:]):
        on = [f"v_{v}" for v in scans[i].kinds if v in scans[j].kinds]
        if on:
            out[i] = Body(out[i].df.join(scans[j].df.select(*on), on, "left_semi"), out[i].kinds)
    return out


def apply_tests(body: Body, rest: list) -> tuple[Body, list]:
    """Comparisons and predicates whose variables are all there; equations bind a variable that isn't."""
    changed = True
    while changed:
        changed, left = False, []
        for b in rest:
            have = set(body.kinds)
            match b:
                case Truth(v):
                    if not v:
                        body = Body(body.df.filter(F.lit(False)), body.kinds)
                    changed = True
                case Predicate(c) if set(variables(c)) <= have:
                    v = compile_expr(c, body.env)
                    if v.kind != INT:
                        raise ProgramError(f"{c.fn} isn't a predicate")
                    body = Body(body.df.filter(v.col != 0), body.kinds)
                    changed = True
                case Compare() if set(variables(b)) <= have:
                    body = Body(body.df.filter(compile_comparison(b, body.env)), body.kinds)
                    changed = True
                case Compare("=", Var(n), e) if n not in have and set(variables(e)) <= have:
                    v = compile_expr(e, body.env)
                    df = body.df.withColumn(f"v_{n}", v.col)
                    body = Body(df, body.kinds | {n: v.kind})
                    changed = True
                case Compare("=", e, Var(n)) if n not in have and set(variables(e)) <= have:
                    v = compile_expr(e, body.env)
                    df = body.df.withColumn(f"v_{n}", v.col)
                    body = Body(df, body.kinds | {n: v.kind})
                    changed = True
                case _:
                    left.append(b)
        rest = left
    return body, rest


def anti(body: Body, atom: Atom, relation: Relation, columns: list[Column]) -> Body:
    """Rows without a match; variables that only the negated atom has are existential."""
    right = scan(relation, atom, columns)
    on = [f"v_{v}" for v in right.kinds if v in body.kinds]
    if on:
        return Body(body.df.join(right.df.select(*on), on, "left_anti"), body.kinds)
    some = right.df.select(F.lit(1).alias("__any")).limit(1)
    return Body(body.df.join(some, F.lit(True), "left_anti"), body.kinds)


AGGREGATES = {
    "count": lambda c: F.count(F.lit(1)),
    "sum": lambda c: F.sum(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "avg": lambda c: F.call_function("div", F.sum(c), F.count(c)),
}


def head_value(a, body: Body) -> Value:
    if isinstance(a, Compound):
        inner = [head_value(x, body) for x in a.args]
        return Value(F.struct(*[v.col.alias(f"arg{k}") for k, v in enumerate(inner)]), "struct")
    return compile_expr(a, body.env)


def compile_rule(spark: SparkSession, rule: Rule, lookup, columns: dict[str, list[Column]], first: int | None = None, semijoins: bool = False) -> Relation:
    """The rule's rows with the head's columns."""
    if first is None and not semijoins and (wide := compile_wide(spark, rule, lookup, columns)) is not None:
        return wide
    body = compile_body(spark, rule, lookup, columns, first, semijoins)
    names = [c.name for c in columns[rule.rel]]
    if not rule.args:
        return Relation(body.df.select(F.lit(1).alias("__unit")).limit(1), True)
    if not rule.aggregates:
        values = [head_value(a, body) for a in rule.args]
        check_types(rule, values, columns[rule.rel])
        df = body.df.select(*[v.col.alias(n) for v, n in zip(values, names)])
        tests = existential(rule, first) if first is None or semijoins else []
        joined = [(i, a) for i, a in enumerate(rule.body) if isinstance(a, Atom) and not a.negated and i not in tests]
        return Relation(df, keeps_bindings(rule, [a for _, a in joined]) and all(lookup(i, a).is_set for i, a in joined))
    # bindings of all variables and wildcards: distinct if the relations are sets
    df = body.df if all(lookup(i, a).is_set for i, a in enumerate(rule.body) if isinstance(a, Atom) and not a.negated) else body.df.distinct()
    body = Body(df, body.kinds)
    keys, measures, values = [], [], []
    for k, a in enumerate(rule.args):
        if isinstance(a, Agg):
            v = Value(F.lit(1), INT) if a.fn == "count" else compile_expr(a.arg, body.env)
            if a.fn in ("sum", "avg") and v.kind != INT:
                raise ProgramError(f"line {rule.line}: {a.fn} takes integers")
            measures.append(AGGREGATES[a.fn](v.col).alias(f"c{k}"))
            values.append(Value(F.col(f"c{k}"), v.kind))
        else:
            v = head_value(a, body)
            keys.append(v.col.alias(f"c{k}"))
            values.append(Value(F.col(f"c{k}"), v.kind))
    check_types(rule, values, columns[rule.rel])
    if keys:
        out = df.groupBy(*keys).agg(*measures)
    else:
        out = df.agg(*measures, F.count(F.lit(1)).alias("__n")).filter("__n > 0")
    return Relation(out.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)]), True)


def compile_wide(spark: SparkSession, rule: Rule, lookup, columns: dict[str, list[Column]]) -> Relation | None:
    """A rule whose atoms meet in one key and give many more rows than they have; None of any other rule. Repetitions are taken out of
    the atoms and not of the result: where the head's variables of each atom tell its row, no row of the result can repeat. Rows of an atom
    that share these with another row are joined apart, and only what they give is made distinct."""
    joined = [(i, a) for i, a in enumerate(rule.body) if isinstance(a, Atom) and not a.negated]
    rest = [b for b in rule.body if not isinstance(b, Atom)]
    if rule.aggregates or len(joined) < 2 or len(joined) + len(rest) < len(rule.body):
        return None
    scans = {i: scan(lookup(i, a), a, columns.get(a.rel, [])) for i, a in joined}
    tests = existential(rule)
    main = [i for i in scans if i not in tests]
    shared = [set(scans[i].kinds) & set(scans[j].kinds) for i in main for j in main if i < j]
    kinds = [(v, k) for b in scans.values() for v, k in b.kinds.items()]
    if not shared or not shared[0] or any(k != shared[0] for k in shared) or len(set(kinds)) > len(dict(kinds)):
        return None
    plain = {a.name for a in rule.args if isinstance(a, Var)}
    wanted = shared[0] | {v for x in (*rule.args, *rest) for v in variables(x)}
    for i in tests:  # each asks one of the others
        on = {v for v in scans[i].kinds if any(v in scans[j].kinds for j in main)}
        at = next((j for j in main if on and on <= set(scans[j].kinds)), None)
        if at is None:
            return None
        names = [f"v_{v}" for v in sorted(on)]
        scans[at] = Body(scans[at].df.join(scans[i].df.select(*names), names, "left_semi"), scans[at].kinds)
    for i in main:
        own = [b for b in rest if not isinstance(b, Truth) and set(variables(b)) <= set(scans[i].kinds)]
        b = apply_tests(scans[i], own)[0]
        rest = [x for x in rest if x not in own]
        scans[i] = Body(b.df.select(*[f"v_{v}" for v in b.kinds if v in wanted]), {v: k for v, k in b.kinds.items() if v in wanted})
    on = [f"v_{v}" for v in sorted(shared[0])]
    if not all(plain & set(scans[i].kinds) for i in main) or not multiplies([scans[i].df for i in main], on):
        return None
    every, single, several = [], [], []
    for i in main:
        head, names = [f"v_{v}" for v in scans[i].kinds if v in plain], [f"v_{v}" for v in scans[i].kinds]
        path = f"{work_dir(spark, 'wide')}/{i}"
        rows = scans[i].df.distinct()
        same = F.lit(1).cast("long") if len(head) == len(names) else F.count(F.lit(1)).over(Window.partitionBy(*head))
        rows = rows.withColumn("__same", same)
        rows.write.parquet(path)
        rows = spark.read.schema(rows.schema).parquet(path)
        every.append(rows.select(*names))
        single.append(rows.filter("__same = 1").select(*names))
        several.append(rows.filter("__same > 1").select(*names))

    def given(frames: list[DataFrame]) -> DataFrame:
        body, left = apply_tests(Body(wide_join(frames, on), dict(kinds)), rest)
        if left:
            raise ProgramError(f"line {rule.line}: a comparison has variables without a value")
        values = [head_value(a, body) for a in rule.args]
        check_types(rule, values, columns[rule.rel])
        return body.df.select(*[v.col.alias(c.name) for v, c in zip(values, columns[rule.rel])])

    out = given(single)
    more = [given([*single[:k], several[k], *every[k + 1 :]]) for k in range(len(main)) if not several[k].isEmpty()]
    return Relation(out.union(reduce(DataFrame.union, more).distinct()) if more else out, True)


def keeps_bindings(rule: Rule, atoms: list[Atom]) -> bool:
    """The head holds every variable of the atoms that are joined and nothing was projected away: rows can't repeat."""
    flat = [x for a in atoms for x in a.args]
    if any(isinstance(x, Wild) or isinstance(x, Compound) for x in flat):
        return False
    plain = {a.name for a in rule.args if isinstance(a, Var)}
    return {v for a in atoms for v in variables(a)} <= plain


def check_types(rule: Rule, values: list[Value], columns: list[Column]):
    for v, c in zip(values, columns):
        want = "struct" if c.arity else STR if c.type in ("string", "symbol") else INT
        if v.kind != want:
            raise ProgramError(f"line {rule.line}: {rule.rel}.{c.name} is {c.type}, the rule gives {v.kind}")


def union(parts: list[Relation]) -> Relation:
    """Set union. One shuffle, and none if there is one part that is a set."""
    if len(parts) == 1:
        return parts[0] if parts[0].is_set else Relation(parts[0].df.distinct(), True)
    return Relation(reduce(lambda a, b: a.union(b), (p.df for p in parts)).distinct(), True)
