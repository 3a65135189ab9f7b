"""Evaluation of strata: semi-naive loops with set semantics.

Every pass is declarative: one DataFrame for each rule and each of its recursive atoms, that
atom reading the delta and the others everything so far.  What a pass derives is written as Parquet to
the shared folder and read back: that cuts the lineage, survives lost executors, and gives
Catalyst sizes, so that small deltas are broadcast and large ones aren't.  What is there already is kept in
parts (``operators.store``), large ones bucketed by the relation's key: a pass shuffles what it derives, and neither the relation
so far nor the best values of an aggregate are shuffled or written again.  While deltas are tiny and rules
linear, a job takes several steps at once, since then its latency is what costs.
"""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.operators.rules import Relation, compile_rule, schema_of, union
from rulespan.operators.store import Part, Store
from rulespan.plans.program import Program, Stratum
from rulespan.plans.syntax import Agg, Atom, Rule, Var
from rulespan.shared import input_bytes, work_dir

log = logging.getLogger("rulespan.fixpoint")
MAX_ITERATIONS = 32_768
UNROLL, UNROLL_ROWS = 3, 2_000
LARGE_BYTES, LARGE_ROWS = 1 << 20, 20_000  # a first part of more, and a delta after one of more, is bucketed


class IterationLimitError(RuntimeError):
    """No fixpoint within max_iterations passes."""


@dataclass
class Pass:
    stratum: int
    number: int
    rows: dict[str, int]
    seconds: float


def aggregate_position(rules: tuple[Rule, ...], rel: str) -> tuple[int, str] | None:
    """(column, min or max) of a relation that is aggregated within its recursion."""
    for r in rules:
        if r.rel == rel and r.aggregates:
            return next((k, a.fn) for k, a in enumerate(r.args) if isinstance(a, Agg))
    return None


def best(df: DataFrame, names: list[str], at: tuple[int, str]) -> DataFrame:
    k, fn = at
    keys = [n for j, n in enumerate(names) if j != k]
    value = (F.min if fn == "min" else F.max)(names[k]).alias(names[k])
    out = df.groupBy(*keys).agg(value) if keys else df.agg(value).filter(F.col(names[k]).isNotNull())
    return out.select(*names)


class Fixpoint:
    """One recursive stratum. lookup gives relations of other strata. stores: of the stratum's relations, to go on with; what
    they lack is then found by small deltas first (``Store.absent_small``)."""

    def __init__(self, spark: SparkSession, program: Program, stratum: Stratum, lookup, seeds: dict[str, Relation], max_iterations: int = MAX_ITERATIONS, doubling: bool = False, unroll: int = UNROLL, unroll_rows: int = UNROLL_ROWS, semijoins: bool = False, nested: dict | None = None, stores: dict[str, Store] | None = None):
        self.spark, self.program, self.stratum, self.lookup, self.seeds = spark, program, stratum, lookup, seeds
        self.max_iterations, self.unroll, self.unroll_rows, self.semijoins, self.nested = max_iterations, unroll, unroll_rows, semijoins, nested
        self.inside = set(stratum.relations)
        self.rules = doubled(stratum.rules) if doubling else stratum.rules
        self.columns = program.columns
        self.agg = {r: aggregate_position(stratum.rules, r) for r in stratum.relations}
        self.linear = all(sum(a.rel in self.inside for a in r.atoms) <= 1 for r in self.rules)
        self.folder = work_dir(spark, "fixpoint")
        self.going_on = stores is not None
        self.stores = stores or {r: self._store(r) for r in stratum.relations}
        self.passes: list[Pass] = []
        self.pinned: dict[str, Relation] = {}

    def _store(self, rel: str) -> Store:
        schema = schema_of(self.columns[rel], self.nested)
        return Store(self.spark, schema, f"{self.folder}/{rel}", [c for k, c in enumerate(schema.names) if not self.agg[rel] or k != self.agg[rel][0]])

    def names(self, rel: str) -> list[str]:
        return [f.name for f in self.stores[rel].schema.fields]

    def outside(self, rel: str) -> Relation:
        """Relations that no pass changes are written once, if they aren't plain scans."""
        if rel not in self.pinned:
            r = self.lookup(rel)
            if not is_scan(r.df) or not r.is_set:
                path = f"{self.folder}/_{rel}"
                (r.df if r.is_set else r.df.distinct()).write.mode("overwrite").parquet(path)
                r = Relation(self.spark.read.schema(r.df.schema).parquet(path), True)
            self.pinned[rel] = r
        return self.pinned[rel]

    def recursive_rules(self) -> list[Rule]:
        return [r for r in self.rules if any(a.rel in self.inside for a in r.atoms)]

    def step(self, delta: dict[str, Relation], full: dict[str, Relation], changed: set[str]) -> dict[str, DataFrame]:
        """What the rules derive with one recursive atom from delta and the others from full."""
        out: dict[str, list[Relation]] = {}
        for r in self.recursive_rules():
            for i, a in enumerate(r.body):
                if isinstance(a, Atom) and not a.negated and a.rel in self.inside and a.rel in changed:

                    def find(j, b, i=i):
                        if b.rel not in self.inside:
                            return self.outside(b.rel)
                        return delta[b.rel] if j == i else full[b.rel]

                    out.setdefault(r.rel, []).append(compile_rule(self.spark, r, find, self.columns, i, self.semijoins))
        done = {}
        for rel, parts in out.items():
            df = parts[0].df
            for p in parts[1:]:
                df = df.union(p.df)
            done[rel] = best(df, self.names(rel), self.agg[rel]) if self.agg[rel] else df.distinct()
        return done

    def fresh(self, rel: str, df: DataFrame) -> Part:
        """Writes the rows that aren't there yet; of aggregates, those that are better."""
        store = self.stores[rel]
        if self.going_on:
            found = store.write(df)
            return store.write(store.absent_small(found)) if found.n and store.parts else found
        better = self.agg[rel][1] if self.agg[rel] else None
        found = store.absent(df, better)
        if store.keys and store.parts and store.parts[-1].n > LARGE_ROWS:  # as many as the last time: worth buckets
            return store.write_bucketed(found, placed=bool(store.parts[0].table))
        return store.write(found)

    def absorb(self, rel: str, part: Part):
        s = self.stores[rel]
        s.add(part)
        if not self.going_on:
            s.compact((lambda df: best(df, self.names(rel), self.agg[rel])) if self.agg[rel] else None)

    def present(self, rel: str) -> Relation:
        """Everything so far; of an aggregated relation the best values."""
        df = self.stores[rel].df
        return Relation(best(df, self.names(rel), self.agg[rel]) if self.agg[rel] and len(self.stores[rel].parts) > 1 else df, True)

    def start(self) -> dict[str, Part]:
        out = {}
        for rel in self.stratum.relations:
            parts = [self.seeds[rel]] if rel in self.seeds else []
            for r in self.rules:
                if r.rel == rel and not any(a.rel in self.inside for a in r.atoms):
                    parts.append(compile_rule(self.spark, r, lambda _, a: self.outside(a.rel), self.columns, None, self.semijoins))
            if parts:
                r = union(parts)
                df = best(r.df, self.names(rel), self.agg[rel]) if self.agg[rel] else r.df
                store = self.stores[rel]
                out[rel] = (store.write_bucketed if store.keys and input_bytes(df) > LARGE_BYTES else store.write)(df)
        return out

    def run(self, delta: dict[str, Part] | None = None) -> dict[str, Relation]:
        """delta: what is new in this stratum already (and in its stores); else from the start."""
        if delta is None:
            began = time.time()
            delta = self.start()
            self.note(0, delta, began)
            for rel, part in delta.items():
                self.absorb(rel, part)
        number = 0
        while any(p.n for p in delta.values()):
            number += 1
            if number > self.max_iterations:
                raise IterationLimitError(f"no fixpoint of {', '.join(self.stratum.relations)} after {self.max_iterations} passes")
            began = time.time()
            rows = sum(p.n for p in delta.values())
            steps = self.unroll if rows <= self.unroll_rows and self.linear and not any(self.agg.values()) else 1
            d = {r: Relation(self.stores[r].read(p), True) for r, p in delta.items() if p.n}
            full = {r: self.present(r) for r in self.inside}
            found: dict[str, list[DataFrame]] = {}
            for _ in range(steps):
                new = self.step(d, full, set(d))
                for r, df in new.items():
                    found.setdefault(r, []).append(df)
                if steps > 1:
                    d = {r: Relation(df, True) for r, df in new.items()}
                    full = {r: Relation(full[r].df.union(new[r]), False) if r in new else full[r] for r in full}
            delta = {}
            for r, many in found.items():
                df = many[0] if len(many) == 1 else reduce(DataFrame.union, many)
                if len(many) > 1:
                    df = best(df, self.names(r), self.agg[r]) if self.agg[r] else df.distinct()
                delta[r] = self.fresh(r, df)
            for r, part in delta.items():
                self.absorb(r, part)
            self.note(number, delta, began)
        out = {r: self.present(r) for r in self.stores}
        if not self.going_on:
            for r, x in out.items():
                if self.agg[r] and len(self.stores[r].parts) > 1:
                    s = self.stores[r]
                    s.parts = [s.write(x.df)]
                    out[r] = Relation(s.df, True)
                self.stores[r].drop_tables()
        return out

    def note(self, number: int, delta: dict, began: float):
        p = Pass(self.stratum.id, number, {r: x.n for r, x in delta.items()}, time.time() - began)
        self.passes.append(p)
        log.info("stratum %d pass %d: %s in %.2f s", p.stratum, p.number, p.rows, p.seconds)


def is_scan(df: DataFrame) -> bool:
    """A file or local table, perhaps filtered and projected: cheap to read again."""
    kinds = str(df._jdf.queryExecution().optimizedPlan().toString())
    return not any(k in kinds for k in ("Join", "Aggregate", "Distinct", "Window", "Generate", "MapInArrow", "Pandas", "Python", "Deduplicate", "Sort", "LogicalRDD"))


def doubled(rules: tuple[Rule, ...]) -> tuple[Rule, ...]:
    """A plain linear closure r = e+ as r = e, r = r r: the same set in a logarithm of the passes."""
    base = [r for r in rules if not any(a.rel == r.rel for a in r.atoms)]
    step = [r for r in rules if r not in base]
    if len(base) != 1 or len(step) != 1 or len({r.rel for r in rules}) != 1:
        return rules
    b, s = base[0], step[0]
    if len(b.args) != 2 or not (len(b.body) == 1 and len(s.body) == 2 and all(isinstance(x, Atom) and not x.negated and all(isinstance(a, Var) for a in x.args) for x in b.body + s.body)):
        return rules
    if b.args != b.body[0].args or b.args[0] == b.args[1] or len(s.args) != 2 or not all(isinstance(a, Var) for a in s.args):
        return rules
    x, z = s.args
    e = b.body[0].rel
    one, two = s.body
    pair = {one.rel, two.rel}
    if pair != {e, b.rel} or len(one.args) != 2 or len(two.args) != 2:
        return rules
    first, second = (one, two) if one.args[0] == x else (two, one)
    if first.args[0] != x or second.args[1] != z or first.args[1] != second.args[0] or len({x, z, first.args[1]}) < 3:
        return rules
    y = first.args[1]
    return (b, Rule(b.rel, (x, z), (Atom(b.rel, (x, y)), Atom(b.rel, (y, z))), s.line))
