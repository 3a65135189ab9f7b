"""Magic sets: a program that derives only what a query with bound positions demands.

Rules are taken from left to right; a derived relation that is called with some positions
bound is renamed by its adornment and guarded by a demand relation. Relations that are aggregated, or reached by
negation, are derived in full, which keeps the program stratified.
"""

from __future__ import annotations

from dataclasses import dataclass

from rulespan.plans.program import Program, bound_by
from rulespan.plans.syntax import Atom, Compare, Const, Rule, Source, Text, Truth, Var, variables


@dataclass
class MagicStats:
    adorned: int = 0
    demand_rules: int = 0
    guarded_rules: int = 0


def adorned(rel: str, ad: str) -> str:
    return f"{rel}__{ad}"


def demand(rel: str, ad: str) -> str:
    return f"m__{rel}__{ad}"


def base(rel: str) -> str:
    return f"{rel}__given"


def magic(program: Program, rel: str, bound: dict[int, int | str], given: frozenset[str] = frozenset()) -> tuple[Program, str, MagicStats]:
    """(program, relation that answers, statistics). given: derived relations that have inputs of their own,
    which the caller supplies as base(relation)."""
    full = {r.rel for r in program.rules if r.aggregates}
    full |= {a.rel for r in program.rules for a in r.negations if a.rel in program.idb}
    if rel not in program.idb or rel in full or not bound:
        return program, rel, MagicStats()
    stats, out = MagicStats(), Text()
    query = "".join("b" if k in bound else "f" for k in range(program.arity[rel]))
    todo, seen, need_full, copied = [(rel, query)], set(), set(), set()

    def columns(name: str, cols):
        out.relations.setdefault(name, Source()).columns = list(cols)

    def add_demand(q: str, ad: str):
        columns(demand(q, ad), [c for c, a in zip(program.columns[q], ad) if a == "b"])

    while todo:
        item = todo.pop()
        if item in seen:
            continue
        seen.add(item)
        q, ad = item
        stats.adorned += 1
        columns(adorned(q, ad), program.columns[q])
        add_demand(q, ad)
        own = [r for r in program.rules if r.rel == q]
        if q in given or program.facts(q):
            vs = tuple(Var(f"x{k}") for k in range(program.arity[q]))
            own.append(Rule(q, vs, (Atom(base(q), vs),)))
            columns(base(q), program.columns[q])
            copied.add(q)
        for r in own:
            guard, checks = [], []
            for k, (a, b) in enumerate(zip(r.args, ad)):
                if b == "b":
                    if isinstance(a, (Var, Const)):
                        guard.append(a)
                    else:
                        v = Var(f"m__{k}")
                        guard.append(v)
                        checks.append(Compare("=", v, a))
            guard_atom = Atom(demand(q, ad), tuple(guard))
            have = set(variables(guard_atom))
            body, before = [guard_atom], [guard_atom]
            for lit in r.body:
                if isinstance(lit, Atom) and not lit.negated and lit.rel in program.idb and lit.rel not in full:
                    sub = "".join("b" if isinstance(a, Const) or isinstance(a, Var) and a.name in have else "f" for a in lit.args)
                    if "b" in sub:
                        args = tuple(a for a, b in zip(lit.args, sub) if b == "b")
                        head = demand(lit.rel, sub)
                        if before != [Atom(head, args)]:
                            out.rules.append(Rule(head, args, tuple(x for x in before if _usable(x, before)), r.line))
                            stats.demand_rules += 1
                        add_demand(lit.rel, sub)
                        todo.append((lit.rel, sub))
                        lit = Atom(adorned(lit.rel, sub), lit.args)
                    else:
                        need_full.add(lit.rel)
                elif isinstance(lit, Atom) and lit.rel in program.idb:
                    need_full.add(lit.rel)
                body.append(lit)
                if isinstance(lit, Atom) and not lit.negated:
                    have |= set(variables(lit))
                    before.append(lit)
                elif isinstance(lit, (Compare, Truth)):
                    before.append(lit)
                have = bound_by(Rule("", (), tuple(b for b in before if isinstance(b, (Atom, Compare)))))
            out.rules.append(Rule(adorned(q, ad), r.args, tuple(body + checks), r.line, r.planned))
            stats.guarded_rules += 1
    seed = demand(rel, query)
    out.facts.setdefault(seed, []).append(tuple(bound[k] for k in sorted(bound)))
    for q in copied:
        if program.facts(q):
            out.facts[base(q)] = program.facts(q)
    # what is needed in full comes with all that it depends on
    todo = list(need_full)
    done: set[str] = set()
    while todo:
        q = todo.pop()
        if q in done:
            continue
        done.add(q)
        for r in program.rules:
            if r.rel == q:
                out.rules.append(r)
                todo += [a.rel for a in r.body if isinstance(a, Atom) and a.rel in program.idb]
    for name, s in program.relations.items():
        if name in program.edb or name in done:
            out.relations.setdefault(name, Source(columns=program.columns[name]))
            if program.facts(name):
                out.facts[name] = program.facts(name)
    return Program(out), adorned(rel, query), stats


def _usable(lit, before) -> bool:
    """Comparisons go into a demand rule only if their variables have values there."""
    if isinstance(lit, Compare):
        have = bound_by(Rule("", (), tuple(b for b in before if isinstance(b, (Atom, Compare)))))
        return set(variables(lit)) <= have
    return True
