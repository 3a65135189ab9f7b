"""A checked program: schemas, dependencies, strata."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from functools import cached_property

from rulespan.plans.syntax import Agg, Atom, Call, Column, Compare, Compound, Const, Expr, Op, Predicate, Rule, Source, Text, Truth, Var, Wild, parse, variables

log = logging.getLogger("rulespan.plans")
GRAPH_METADATA = "__graph_metadata"
GRAPH_COLUMNS = tuple("graph_id tenant timestamp location risk description".split())
GRAPH_ID = "__graph_id"


class ProgramError(ValueError):
    pass


class NotStratifiableError(ProgramError):
    """A negation, or an aggregate other than min and max, within a recursion."""


class UnsafeRuleError(ProgramError):
    """A variable that no positive atom or binding gives a value."""


class ArityError(ProgramError):
    pass


@dataclass(frozen=True)
class Stratum:
    id: int
    relations: tuple[str, ...]
    rules: tuple[Rule, ...]
    recursive: bool


class Program:
    """strict: a program that can't be stratified is refused at once, and not only when it is evaluated."""

    def __init__(self, text: Text, source: str = "", strict: bool = True):
        self.text, self.source = text, source
        self.relations: dict[str, Source] = text.relations
        self.rules: list[Rule] = text.rules
        meta = self.relations.get(GRAPH_METADATA)
        if meta is None or meta.columns is None:
            if meta is not None or self._uses(GRAPH_METADATA):
                text.source(GRAPH_METADATA).columns = [Column(c, "int64") for c in GRAPH_COLUMNS]
        elif len(meta.columns) != len(GRAPH_COLUMNS):
            raise ProgramError(f"{GRAPH_METADATA} has {len(GRAPH_COLUMNS)} columns")
        for r in self.rules:
            for a in r.body:
                if isinstance(a, Atom) and a.rel not in self.relations:
                    log.warning("line %d: relation %s isn't declared and has no rules: it is empty", r.line, a.rel)
                    text.source(a.rel)
        self._check_arity()
        for r in self.rules:
            check_safe(r)
        if strict:
            self.strata  # noqa: B018  raises if it can't be stratified

    def _uses(self, rel: str) -> bool:
        return any(isinstance(a, Atom) and a.rel == rel for r in self.rules for a in r.body)

    @classmethod
    def parse(cls, text: str, extended: bool = False, functions: dict[str, int] | None = None, strict: bool = True) -> Program:
        return cls(parse(text, extended, functions), text, strict)

    @classmethod
    def load(cls, path: str, extended: bool = False) -> Program:
        with open(path, encoding="utf-8") as f:
            return cls.parse(f.read(), extended)

    def _check_arity(self):
        self.arity: dict[str, int] = {}
        for rel, s in self.relations.items():
            if s.columns is not None:
                self.arity[rel] = len(s.columns)

        def seen(rel: str, n: int, where: str):
            if self.arity.setdefault(rel, n) != n:
                raise ArityError(f"{where}: {rel} has {self.arity[rel]} columns, not {n}")

        for rel, rows in self.text.facts.items():
            for row in rows:
                seen(rel, len(row), "fact")
        for r in self.rules:
            seen(r.rel, len(r.args), f"line {r.line}")
        for r in self.rules:
            for a in r.body:
                if isinstance(a, Atom):
                    seen(a.rel, len(a.args), f"line {r.line}")
        for rel, s in self.relations.items():
            for q in s.queries:
                seen(rel, len(q), ".query")

    # --- schemas

    @cached_property
    def columns(self) -> dict[str, list[Column]]:
        """Declared ones, and for the others col0 ... with the types that facts and rules show."""
        out: dict[str, list[Column]] = {}
        for rel, s in self.relations.items():
            if s.columns is not None:
                out[rel] = s.columns
        open_ = {rel: [None] * self.arity.get(rel, 0) for rel in self.relations if rel not in out}
        for rel, rows in self.text.facts.items():
            if rel in open_:
                open_[rel] = [Column(f"col{k}", "string" if isinstance(v, str) else "int64") if not isinstance(v, tuple) else Column(f"col{k}", v[0], len(v) - 1, "side") for k, v in enumerate(rows[0])]
        for _ in range(len(open_) + 1):
            changed = False
            for r in self.rules:
                if r.rel in open_:
                    for k, a in enumerate(r.args):
                        if open_[r.rel][k] is None and (t := self._type_in(r, a, out | open_)):
                            open_[r.rel][k] = Column(f"col{k}", t.type, t.arity, t.tier)
                            changed = True
            if not changed:
                break
        for rel, cols in open_.items():
            out[rel] = [c or Column(f"col{k}", "int64") for k, c in enumerate(cols)]
        return out

    def _type_in(self, rule: Rule, e: Expr, known: dict) -> Column | None:
        match e:
            case Const(v):
                return Column("", "string" if isinstance(v, str) else "int64")
            case Var(n):
                for a in rule.body:
                    if isinstance(a, Atom) and not a.negated:
                        for k, x in enumerate(a.args):
                            if x == e and known.get(a.rel) and known[a.rel][k]:
                                return known[a.rel][k]
                    if isinstance(a, Compare) and a.op == "=" and a.left == e and n not in variables(a.right):
                        return self._type_in(rule, a.right, known)
                return None
            case Agg(fn, a):
                return self._type_in(rule, a, known) if fn in ("min", "max") else Column("", "int64")
            case Call(fn, _):
                return Column("", "string" if fn in STRING_RESULT else "int64")
            case Compound(f, args):
                return Column("", f, len(args), "side")
        return Column("", "int64")

    # --- dependencies

    @property
    def idb(self) -> set[str]:
        return {r.rel for r in self.rules}

    @property
    def edb(self) -> set[str]:
        return set(self.relations) - self.idb

    def edges(self) -> set[tuple[str, str, str]]:
        """(head, body relation, positive | negative | aggregate), derived relations only."""
        out, idb = set(), self.idb
        for r in self.rules:
            for a in r.body:
                if isinstance(a, Atom) and a.rel in idb:
                    out.add((r.rel, a.rel, "negative" if a.negated else "aggregate" if r.aggregates else "positive"))
        return out

    @cached_property
    def strata(self) -> list[Stratum]:
        edges = self.edges()
        graph = {n: sorted({b for a, b, _ in edges if a == n}) for n in dict.fromkeys(r.rel for r in self.rules)}
        out = []
        for k, part in enumerate(components(graph)):
            inside = set(part)
            for a, b, kind in sorted(edges):
                if a in inside and b in inside and kind == "negative":
                    raise NotStratifiableError(f"{a} depends on its own negation by {b}")
            rules = tuple(r for r in self.rules if r.rel in inside)
            recursive = len(part) > 1 or any(a == b and a in inside for a, b, _ in edges)
            if recursive:
                check_recursive_aggregates(rules, inside)
            out.append(Stratum(k, tuple(sorted(part)), rules, recursive))
        return out

    @property
    def is_stratified(self) -> bool:
        try:
            self.strata  # noqa: B018
        except NotStratifiableError:
            return False
        return True

    @property
    def rule_count(self) -> int:
        return len(self.rules)

    def schema(self, rel: str) -> list[Column]:
        return self.columns[rel]

    def facts(self, rel: str) -> list[tuple]:
        return list(self.text.facts.get(rel, []))

    def outputs(self) -> list[str]:
        """Relations with .output, or all derived ones if there are none."""
        some = [r for r, s in self.relations.items() if s.outputs]
        return some or [r for r in self.relations if r in self.idb]

    def affected(self, changed: set[str]) -> set[str]:
        """Derived relations that depend on changed ones."""
        todo, out = list(changed), set()
        users: dict[str, set[str]] = {}
        for r in self.rules:
            for a in r.body:
                if isinstance(a, Atom):
                    users.setdefault(a.rel, set()).add(r.rel)
        while todo:
            for u in users.get(todo.pop(), ()):
                if u not in out:
                    out.add(u)
                    todo.append(u)
        return out

    def explain(self) -> str:
        lines = []
        for s in self.strata:
            lines.append(f"stratum {s.id}{' recursive' if s.recursive else ''}: {', '.join(s.relations)}")
            lines += [f"  {show(r)}" for r in s.rules]
        return "\n".join(lines)


STRING_RESULT = {"cat", "substr", "to_upper", "to_lower", "str_replace", "trim", "to_string", "md5", "sha1", "sha256", "sha512", "hmac_sha256", "uuid4", "uuid5"}


def components(graph: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected components, those that others need first (Tarjan, without recursion)."""
    index, low, on, stack, out, n = {}, {}, set(), [], [], 0
    for root in graph:
        if root in index:
            continue
        work = [(root, iter(graph[root]))]
        index[root] = low[root] = n
        n += 1
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in graph:
                    continue
                if w not in index:
                    index[w] = low[w] = n
                    n += 1
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(graph[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    out.append(part)
    return out


def check_recursive_aggregates(rules: tuple[Rule, ...], inside: set[str]):
    for r in rules:
        if r.aggregates and any(a.rel in inside for a in r.atoms):
            kinds = [a.fn for a in r.args if isinstance(a, Agg)]
            if any(k not in ("min", "max") for k in kinds):
                raise NotStratifiableError(f"line {r.line}: only min and max may be recursive, not {', '.join(kinds)}")
            if len(kinds) > 1:
                raise NotStratifiableError(f"line {r.line}: one recursive aggregate a rule")
    shapes: dict[str, set] = {}
    for r in rules:
        if r.aggregates:
            shapes.setdefault(r.rel, set()).add(tuple((k, a.fn) for k, a in enumerate(r.args) if isinstance(a, Agg)))
    for rel, s in shapes.items():
        if len(s) > 1:
            raise NotStratifiableError(f"{rel} is aggregated in several ways within a recursion")


def bound_by(rule: Rule) -> set[str]:
    """Variables with a value: of positive atoms, then of equations whose other side has one."""
    have = {v for a in rule.atoms for v in variables(a)}
    while True:
        more = {c.left.name for c in rule.body if isinstance(c, Compare) and c.op == "=" and isinstance(c.left, Var) and set(variables(c.right)) <= have}
        more |= {c.right.name for c in rule.body if isinstance(c, Compare) and c.op == "=" and isinstance(c.right, Var) and set(variables(c.left)) <= have}
        if more <= have:
            return have
        have |= more


def check_safe(rule: Rule):
    have = bound_by(rule)
    if not rule.atoms and not (all(not variables(a) and not isinstance(a, Agg) for a in rule.args) and all(isinstance(b, Truth) for b in rule.body)):
        if not have or rule.negations:
            raise UnsafeRuleError(f"line {rule.line}: the body has no positive atom")
    for a in rule.args:
        if missing := [v for v in variables(a) if v not in have]:
            raise UnsafeRuleError(f"line {rule.line}: {missing[0]} in the head has no value")
    for b in rule.body:
        if isinstance(b, (Compare, Predicate)) and (missing := [v for v in variables(b) if v not in have]):
            raise UnsafeRuleError(f"line {rule.line}: {missing[0]} has no value")


def show(x) -> str:
    match x:
        case Var(n):
            return n
        case Const(v):
            return f'"{v}"' if isinstance(v, str) else str(v)
        case Wild():
            return "_"
        case Op(op, a, b):
            return f"{show(a)} {op} {show(b)}"
        case Call(f, args) | Compound(f, args) | Agg(f, args):
            return f"{f}({', '.join(map(show, args if isinstance(args, tuple) else (args,)))})"
        case Atom(rel, args, neg):
            return f"{'!' if neg else ''}{rel}({', '.join(map(show, args))})"
        case Compare(op, a, b):
            return f"{show(a)} {op} {show(b)}"
        case Predicate(c):
            return show(c)
        case Truth(v):
            return str(v)
        case Rule(rel, args, body):
            return f"{rel}({', '.join(map(show, args))}) :- {', '.join(map(show, body))}."
    return repr(x)
