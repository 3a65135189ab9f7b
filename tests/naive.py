"""A tiny bottom-up evaluator over Python sets: the standard that programs are held against."""

from __future__ import annotations

from rulespan.plans.program import Program
from rulespan.plans.syntax import Agg, Atom, Call, Compare, Const, Op, Predicate, Truth, Var, Wild


def wrap(x):
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def value(e, env):
    match e:
        case Const(v):
            return v
        case Var(n):
            return env[n]
        case Op(op, a, b):
            x, y = value(a, env), value(b, env)
            if op in "/%":
                if y == 0:
                    return 0
                q = abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1)
                return wrap(q if op == "/" else x - q * y)
            return wrap({"+": x + y, "-": x - y, "*": x * y}[op])
        case Call("strlen", (x,)):
            return len(value(x, env))
    raise NotImplementedError(e)


def compare(op, x, y):
    return {"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]


def bindings(rule, rels):
    envs = [{}]
    atoms = [(k, b) for k, b in enumerate(rule.body) if isinstance(b, Atom) and not b.negated]
    for k, a in atoms:
        out = []
        for env in envs:
            for row in rels.get(a.rel, ()):
                e = dict(env)
                for j, (arg, v) in enumerate(zip(a.args, row)):
                    if isinstance(arg, Const) and arg.value != v or isinstance(arg, Var) and e.setdefault(arg.name, v) != v:
                        break
                    if isinstance(arg, Wild):
                        e[f"_{k}_{j}"] = v
                else:
                    out.append(e)
        envs = out
    for b in rule.body:
        match b:
            case Compare("=", Var(n), x) if envs and n not in envs[0]:
                envs = [e | {n: value(x, e)} for e in envs]
            case Compare(op, x, y):
                envs = [e for e in envs if compare(op, value(x, e), value(y, e))]
            case Truth(v):
                envs = envs if v else []
            case Predicate(c):
                envs = [e for e in envs if value(c, e)]
            case Atom(rel, args, True):
                def hit(e):
                    return any(all(isinstance(x, Wild) or isinstance(x, Const) and x.value == v or isinstance(x, Var) and e.get(x.name, v) == v for x, v in zip(args, row)) for row in rels.get(rel, ()))
                envs = [e for e in envs if not hit(e)]
    return envs


def derive(rule, rels):
    envs = bindings(rule, rels)
    if not rule.aggregates:
        return {tuple(value(a, e) for a in rule.args) for e in envs}
    groups = {}
    for e in {tuple(sorted(e.items())): e for e in envs}.values():
        groups.setdefault(tuple(value(a, e) for a in rule.args if not isinstance(a, Agg)), []).append(e)
    out = set()
    for key, es in groups.items():
        key, row = list(key), []
        for a in rule.args:
            if not isinstance(a, Agg):
                row.append(key.pop(0))
            elif a.fn == "count":
                row.append(len(es))
            else:
                v = [value(a.arg, e) for e in es]
                row.append({"sum": sum, "min": min, "max": max, "avg": lambda v: int(sum(v) / len(v))}[a.fn](v))
        out.add(tuple(row))
    return out


def evaluate(program: Program, inputs: dict[str, set] | None = None) -> dict[str, set]:
    rels = {r: set(program.facts(r)) | set((inputs or {}).get(r, ())) for r in program.relations}
    for s in program.strata:
        while True:
            before = {r: set(rels[r]) for r in s.relations}
            for r in s.rules:
                new = derive(r, rels)
                at = next((k for k, a in enumerate(r.args) if isinstance(a, Agg)), None)
                if s.recursive and r.aggregates:
                    best = {}
                    for row in rels[r.rel] | new:
                        key = row[:at] + row[at + 1 :]
                        pick = min if r.args[at].fn == "min" else max
                        best[key] = pick(best.get(key, row[at]), row[at])
                    rels[r.rel] = {k[:at] + (v,) + k[at:] for k, v in best.items()}
                else:
                    rels[r.rel] |= new
            if before == {r: rels[r] for r in s.relations}:
                break
    return rels
