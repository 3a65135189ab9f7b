"""Sessions: rows are inserted and removed, and a step tells what appeared and disappeared.

After every step the derived relations are what a fresh evaluation of the inputs would give.
Strata that no change reaches are left alone. Where what changed is only joined (no negation, no aggregate), a stratum is
maintained: rows with a derivation from a removed row are taken away, those of them that still have another one
are put back, rows that insertions give are added, and the fixpoint goes on from both; the work follows the change, not the state
(delete and rederive); a recursive stratum of whose input more than a 20th has changed isn't.  As long as these are few rows (``FEW_ROWS``) they are part of the plans, and only what a step has changed in the end
is written.  Elsewhere the stratum is evaluated anew and compared with what it was. All states are Parquet in
the shared folder, in parts (``operators.store``): a step adds parts of the size of what it changed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespan.engine import Engine, _functions
from rulespan.operators.fixpoint import MAX_ITERATIONS, UNROLL, Fixpoint
from rulespan.operators.rules import Relation, compile_rule, schema_of, union
from rulespan.operators.signed import DIFF
from rulespan.operators.store import FEW_ROWS, SMALL_ROWS, Part, Store, few, local
from rulespan.plans.program import ArityError, Program, ProgramError, Stratum
from rulespan.plans.syntax import Atom, Const, Rule, Var
from rulespan.shared import remove_dir, work_dir
from rulespan.sources.adapters import conform

COUNT, GONE = "__count", "__gone"
ANEW_ROWS, ANEW_SHARE = FEW_ROWS, 20  # changes of more rows than that, and than a 20th of what is there, aren't followed


class States(Mapping):
    """The present rows of each relation."""

    def __init__(self, stores: dict[str, Store]):
        self.stores = stores

    def __getitem__(self, rel: str) -> DataFrame:
        return self.stores[rel].df

    def __iter__(self):
        return iter(self.stores)

    def __len__(self):
        return len(self.stores)


class Session:
    """on_delta: called with (relation, row, +1 or -1) for every change of a derived relation. Ends with close(), or as a context manager.
    nulls: as in Engine."""

    def __init__(self, spark: SparkSession, program: Program | str, *, on_delta: Callable[[str, tuple, int], None] | None = None, max_iterations: int = MAX_ITERATIONS, unroll: int = UNROLL, base_dir: str = ".", load_inputs: bool = True, extended: bool = False, nulls: str = "raise"):
        spark.conf.set("spark.sql.ansi.enabled", "false")
        self.spark = spark
        self.program = program if isinstance(program, Program) else Program.parse(program, extended, _functions)
        self.on_delta = on_delta
        self.options = dict(max_iterations=max_iterations, unroll=unroll)
        self.folder = work_dir(spark, "session")
        self.epoch = 0
        self.steps: list[dict] = []
        self.nulls, self.closed = nulls, False
        engine = Engine(spark, self.program, base_dir=base_dir)
        self.nested = engine.nested
        self.base: dict[str, list[str]] = {}  # parts of rows and how often each is there, to be added up
        self.stores: dict[str, Store] = {}
        self.state = States(self.stores)
        self.pending: dict[str, list[DataFrame | tuple[int, list[tuple]]]] = {}
        self.rows: dict[tuple[str, int], list[tuple]] = {}
        for rel in self.program.relations:
            self.base[rel] = []
            self.stores[rel] = Store(spark, self.schema(rel), f"{self.folder}/{rel}")
            if rel in engine.program.text.facts or load_inputs and self.program.relations[rel].inputs:
                self._stage(rel, engine.given(rel).df, 1)

    def schema(self, rel: str) -> T.StructType:
        return schema_of(self.program.columns[rel], self.nested)

    def _empty(self, rel: str) -> DataFrame:
        return self.spark.createDataFrame([], self.schema(rel))

    def _stage(self, rel: str, df: DataFrame, sign: int):
        self.pending.setdefault(rel, []).append(df.select(*[F.col(f"`{c}`") for c in self.schema(rel).names], F.lit(sign).cast("long").alias(DIFF)))

    def close(self) -> None:
        """Removes its files. The states can't be read any more."""
        if not self.closed:
            self.closed = True
            for s in self.stores.values():
                s.drop_tables()
            remove_dir(self.folder)

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _check(self, rel: str, n: int):
        if self.closed:
            raise ProgramError("the session is closed")
        if rel not in self.program.relations:
            raise ProgramError(f"{rel} isn't in the program")
        if n != len(self.program.columns[rel]) and not (n == 0 and not self.program.columns[rel]):
            raise ArityError(f"{rel} has {len(self.program.columns[rel])} columns, not {n}")

    # --- changes

    def insert(self, rel: str, *rows: Iterable) -> None:
        """Rows as tuples, or one DataFrame. They count from the next step on."""
        self._change(rel, rows, 1)

    def remove(self, rel: str, *rows: Iterable) -> None:
        """One copy of each row; rows that aren't there are passed over."""
        self._change(rel, rows, -1)

    insert_sym = insert
    remove_sym = remove

    def insert_incremental(self, rel: str, *rows: Iterable) -> list[tuple[str, tuple, int]]:
        """insert and step."""
        self.insert(rel, *rows)
        return self.step()

    @staticmethod
    def intern(value: str) -> str:
        """Strings stand for themselves."""
        return value

    def _change(self, rel: str, rows, sign: int):
        if len(rows) == 1 and isinstance(rows[0], DataFrame):
            self._check(rel, len(rows[0].columns))
            self._flush_rows()
            self._stage(rel, conform(rows[0], self.schema(rel), rel, self.nulls), sign)
            return
        for row in rows:
            row = tuple(row)
            self._check(rel, len(row))
            for v, f in zip(row, self.schema(rel).fields):
                if isinstance(f.dataType, T.StringType) != isinstance(v, str) and not isinstance(f.dataType, T.StructType):
                    raise ProgramError(f"{rel}.{f.name} is {f.dataType.simpleString()}, not {v!r}")
            last = next(reversed(self.rows), None)
            if last is not None and last != (rel, sign):
                self._flush_rows()
            self.rows.setdefault((rel, sign), []).append(row or (1,))

    def _flush_rows(self):
        for (rel, sign), rows in self.rows.items():
            if len(rows) <= FEW_ROWS and self._plain_types(rel):
                self.pending.setdefault(rel, []).append((sign, rows))
            else:
                self._stage(rel, self.spark.createDataFrame(rows, self.schema(rel)), sign)
        self.rows = {}

    def _plain_types(self, rel: str) -> bool:
        return not any(isinstance(f.dataType, T.StructType) for f in self.schema(rel).fields)

    def _local(self, rel: str, rows) -> DataFrame:
        return local(self.spark, rows, self.schema(rel))

    # --- steps

    def step_frame(self) -> dict[str, DataFrame]:
        """Evaluates pending changes; for each derived relation that changed, its rows and ``__diff``."""
        if self.closed:
            raise ProgramError("the session is closed")
        self._flush_rows()
        pending, self.pending = self.pending, {}
        self.epoch += 1
        before = {rel: list(s.parts) for rel, s in self.stores.items()}
        plus: dict[str, DataFrame] = {}
        minus: dict[str, DataFrame] = {}
        self.few_plus: dict[str, set] = {}  # of plus and minus, those that the driver has
        self.few_minus: dict[str, set] = {}
        given: dict[str, tuple[Part, Part]] = {}  # what changed of the facts of derived relations
        for rel, changes in pending.items():
            more, less = self._change_base(rel, changes)
            if rel in self.program.idb:
                given[rel] = more, less
            else:
                self._keep(rel, [less, more], plus, minus)
        touched = set(plus) | set(minus) | {r for r, (more, less) in given.items() if more.n or less.n}
        out, ran = {}, []
        for s in self.program.strata:
            reads = {a.rel for r in s.rules for a in r.body if isinstance(a, Atom)}
            changed = {r for r in reads - set(s.relations) if r in plus or r in minus}
            if not changed and not set(s.relations) & touched:
                continue
            if self.epoch > 1 and self._joins_only(s, changed) and not (s.recursive and self._large(s, changed, before, given)):
                ran.append((s.id, "continued"))
                found = self._maintain_few(s, changed, plus, minus, before, given) or self._maintain(s, changed, plus, minus, before, given)
            else:
                ran.append((s.id, "anew"))
                found = self._anew(s)
            for rel, parts in found.items():
                self._tell(rel, parts, plus, minus, out)
        for rel, s in self.stores.items():
            s.compact()
        self.steps.append({"epoch": self.epoch, "strata": ran})
        return out

    def _read(self, rel: str, part: Part) -> DataFrame:
        return self.stores[rel].read(part)

    def _keep(self, rel: str, parts: list[Part], plus, minus) -> None:
        self.stores[rel].add(*parts)
        for p in parts:
            if p.n:
                (minus if p.gone else plus)[rel] = self._read(rel, p)

    def _tell(self, rel: str, parts: tuple[Part, Part], plus, minus, out) -> None:
        more, less = parts
        for p in parts:
            if p.n:
                (minus if p.gone else plus)[rel] = self._read(rel, p)
        frames = [self._read(rel, p).withColumn(DIFF, F.lit(-1 if p.gone else 1).cast("long")) for p in (more, less) if p.n]
        if frames:
            out[rel] = reduce(DataFrame.union, frames)

    def _change_base(self, rel: str, changes: list[DataFrame]) -> tuple[Part, Part]:
        """Changes apply in order, a removal sees what was inserted before it, and no count falls below 0. Returns the rows that appear and
        those that go. Only the rows that are named are looked up."""
        store, names = self.stores[rel], self.schema(rel).names
        if (few_ := self._change_few(rel, changes)) is not None:
            return few_
        frames = [c if isinstance(c, DataFrame) else self._local(rel, c[1]).withColumn(DIFF, F.lit(c[0]).cast("long")) for c in changes]
        sums = [c.groupBy(*names).agg(F.sum(DIFF).alias(f"__{k}")) for k, c in enumerate(frames)]
        all_ = sums[0]
        if len(sums) > 1:
            all_ = reduce(DataFrame.union, (s.select(*names) for s in sums)).distinct()
            for s in sums:
                all_ = all_.join(s, names, "left")
        schema = T.StructType([*self.schema(rel).fields, T.StructField(COUNT, T.LongType())])
        had = F.lit(0).cast("long")
        if self.base[rel]:
            part = Store(self.spark, all_.schema, f"{self.folder}/{rel}-named").write(all_)
            all_ = self.spark.read.schema(all_.schema).parquet(part.path)
            rows = all_.select(*names)
            base = self.spark.read.schema(schema).parquet(*self.base[rel])
            base = base.join(F.broadcast(rows) if part.n <= SMALL_ROWS else rows, names, "left_semi").groupBy(*names).agg(F.sum(COUNT).alias("__had"))
            all_, had = all_.join(base, names, "left"), F.coalesce(F.col("__had"), F.lit(0))
        now = had
        for k in range(len(sums)):
            now = F.greatest(now + F.coalesce(F.col(f"__{k}"), F.lit(0)), F.lit(0))
        diff = F.when((now > 0) & (had == 0), F.lit(1)).when((now == 0) & (had > 0), F.lit(-1)).otherwise(F.lit(0))
        more, less = store.write_signed(all_.select(*names, diff.cast("long").alias(DIFF), (now - had).cast("long").alias(COUNT)).filter(f"{COUNT} != 0"))
        self._keep_base(rel, more.path)
        return more, less

    def _keep_base(self, rel: str, path: str) -> None:
        names = self.schema(rel).names
        schema = T.StructType([*self.schema(rel).fields, T.StructField(COUNT, T.LongType())])
        self.base[rel].append(path)
        if len(self.base[rel]) > 16:  # the first is kept as it is, unless the others have come to as much
            rest = self.spark.read.schema(schema).parquet(*self.base[rel][1:]).groupBy(*names).agg(F.sum(COUNT).alias(COUNT)).filter(f"{COUNT} != 0")
            self.base[rel][1:] = [Store(self.spark, schema, f"{self.folder}/{rel}-base").write(rest).path]

    def _change_few(self, rel: str, changes: list) -> tuple[Part, Part] | None:
        """The same for few rows that the driver has."""
        if any(isinstance(c, DataFrame) for c in changes) or sum(len(c[1]) for c in changes) > FEW_ROWS:
            return None
        names, had = self.schema(rel).names, {}
        schema = T.StructType([*self.schema(rel).fields, T.StructField(COUNT, T.LongType())])
        named = {row for _, rows in changes for row in rows}
        if self.base[rel]:
            found = few(self.spark.read.schema(schema).parquet(*self.base[rel]).join(self._local(rel, named), names, "left_semi"))
            if found is None:
                return None
            for *row, n in found:
                had[tuple(row)] = had.get(tuple(row), 0) + n
        now = {row: had.get(row, 0) for row in named}
        for sign, rows in changes:
            step = {}
            for row in rows:
                step[row] = step.get(row, 0) + sign
            for row, n in step.items():
                now[row] = max(0, now[row] + n)
        rows = [(*row, (n > 0) - (had.get(row, 0) > 0), n - had.get(row, 0)) for row, n in now.items() if n != had.get(row, 0)]
        more, less = ({r[:-2] for r in rows if r[-2] == sign} for sign in (1, -1))
        self.few_plus[rel], self.few_minus[rel] = more, less
        store = self.stores[rel]
        if not rows:
            return Part("", 0), Part("", 0)
        path = store._path()
        wide = T.StructType([*self.schema(rel).fields, T.StructField(DIFF, T.LongType()), T.StructField(COUNT, T.LongType())])
        local(self.spark, rows, wide).coalesce(1).write.mode("overwrite").parquet(path)
        self._keep_base(rel, path)
        return Part(path, len(more), False, f"{DIFF} > 0"), Part(path, len(less), True, f"{DIFF} < 0")

    def _large(self, s: Stratum, changed: set[str], before: dict[str, list[Part]], given: dict[str, tuple[Part, Part]]) -> bool:
        """So much of what a recursive stratum reads has changed that following it would move more than an evaluation: each pass of
        delete and rederive moves the state, those of a fixpoint don't (its parts are bucketed)."""
        for rel in changed:
            was = sum(-p.n if p.gone else p.n for p in before[rel])
            if sum(p.n for p in self.stores[rel].parts if p not in before[rel]) > max(ANEW_ROWS, was // ANEW_SHARE):
                return True
        for rel in set(given) & set(s.relations):
            if sum(p.n for p in given[rel]) > max(ANEW_ROWS, self.stores[rel].rows // ANEW_SHARE):
                return True
        return False

    def _joins_only(self, s: Stratum, changed: set[str]) -> bool:
        """No rule negates or aggregates what changed, nor aggregates at all."""
        return not any(r.aggregates or any(a.rel in changed or a.rel in s.relations for a in r.negations) for r in s.rules)

    def _lookup(self, rel: str) -> Relation:
        return Relation(self.state[rel], True)

    def _given(self, rel: str) -> Relation:
        names = self.schema(rel).names
        if not self.base[rel]:
            return Relation(self._empty(rel), True)
        schema = T.StructType([*self.schema(rel).fields, T.StructField(COUNT, T.LongType())])
        base = self.spark.read.schema(schema).parquet(*self.base[rel])
        return Relation(base.groupBy(*names).agg(F.sum(COUNT).alias(COUNT)).filter(f"{COUNT} > 0").select(*names), True)

    def _anew(self, s: Stratum) -> dict[str, tuple[Part, Part]]:
        """Evaluates the stratum, and compares it with what it was by one shuffle of both."""
        if s.recursive:
            f = Fixpoint(self.spark, self.program, s, self._lookup, {r: self._given(r) for r in s.relations}, nested=self.nested, **self.options)
            new = {r: x.df for r, x in f.run().items()}
        else:
            (rel,) = s.relations
            parts = [self._given(rel)] + [compile_rule(self.spark, r, lambda _, a: self._lookup(a.rel), self.program.columns) for r in s.rules]
            new = {rel: union(parts).df}
        out = {}
        for rel, df in new.items():
            store, names = self.stores[rel], self.schema(rel).names
            signed = df.select(*names, F.lit(1).cast("long").alias(DIFF))
            if store.parts:
                signed = signed.unionByName(store.df.select(*names, F.lit(-1).cast("long").alias(DIFF))).groupBy(*names).agg(F.sum(DIFF).alias(DIFF)).filter(F.col(DIFF) != 0)
            more, less = store.write_signed(signed)
            store.add(less, more)
            out[rel] = more, less
        if s.recursive:
            remove_dir(f.folder)
        return out

    # --- maintenance

    def _derive(self, s: Stratum, first: Callable[[int, Atom], DataFrame | None], rest: Callable[[Atom], Relation]) -> dict[str, DataFrame]:
        """What the rules give with one atom reading ``first`` (None: not this one), the others ``rest``."""
        found: dict[str, list[DataFrame]] = {}
        for r in s.rules:
            for i, a in enumerate(r.body):
                if isinstance(a, Atom) and not a.negated and (df := first(i, a)) is not None:
                    find = lambda j, b, i=i, df=df: Relation(df, True) if j == i else rest(b)
                    found.setdefault(r.rel, []).append(compile_rule(self.spark, r, find, self.program.columns, i).df)
        return {rel: reduce(DataFrame.union, parts) for rel, parts in found.items()}

    def _maintain_few(self, s: Stratum, changed: set[str], plus, minus, before, given) -> dict[str, tuple[Part, Part]] | None:
        """As _maintain, while all that changes is few rows; None, and nothing done, if it isn't. Each pass is two jobs: what the rules
        give, and what of that is there."""
        if not all(r in self.few_plus and r in self.few_minus for r in changed | (set(given) & set(s.relations))) or not all(map(self._plain_types, s.relations)):
            return None
        own = s.relations
        gone: dict[str, set] = {r: set() for r in own}
        added: dict[str, set] = {r: set() for r in own}

        def rows_of(frames: dict[str, DataFrame]) -> dict[str, set] | None:
            out = {}
            for rel, df in frames.items():
                if (rows := few(df)) is None:
                    return None
                out[rel] = set(rows)
            return out

        def there(rel: str, rows: set, parts: list[Part]) -> set | None:
            if not rows or not parts:
                return set()
            found = few(self.stores[rel].of(parts).join(self._local(rel, rows), self.schema(rel).names, "left_semi"))
            return None if found is None else set(found)

        def old(rel: str) -> Relation:
            return Relation(self.stores[rel].of(before[rel]), True)

        def now(rel: str) -> Relation:
            df = self.stores[rel].df
            if gone.get(rel):
                df = df.join(self._local(rel, gone[rel]), self.schema(rel).names, "left_anti")
            if added.get(rel):
                df = df.union(self._local(rel, added[rel]))
            return Relation(df, True)

        def derive(delta: dict[str, set], rest: Callable[[str], Relation], steps: int = 1) -> dict[str, DataFrame]:
            """steps: several at once; rows of two steps before meet in the next pass."""
            frames, out = {r: self._local(r, rows) for r, rows in delta.items() if rows}, {}
            for _ in range(steps):
                frames = self._derive(s, lambda i, a, frames=frames: frames.get(a.rel), lambda a: rest(a.rel))
                for r, df in frames.items():
                    out[r] = out[r].union(df) if r in out else df
            return out

        steps = 1  # most changes end soon; those that don't are followed further in a job
        found, first = rows_of(derive({r: self.few_minus[r] for r in changed}, old)), True
        while found is not None:
            delta = {}
            for rel in own:
                rows = found.get(rel, set()) | (self.few_minus[rel] if rel in given and first else set())
                hit = there(rel, rows - gone[rel], before[rel])
                if hit is None or len(gone[rel]) + len(hit) > FEW_ROWS:
                    return None
                gone[rel] |= hit
                if hit:
                    delta[rel] = hit
            first = False
            if not delta or not s.recursive:
                break
            found, steps = rows_of(derive(delta, old, steps)), self.options["unroll"]
        if found is None:
            return None
        frames = derive({r: self.few_plus[r] for r in changed}, lambda r: now(r) if r in own else self._lookup(r))
        for rel in own:
            for df in self._rederive(s, rel, self._local(rel, gone[rel]), now) if gone[rel] else ():
                frames[rel] = frames[rel].union(df) if rel in frames else df
        found = rows_of(frames)
        first, steps = True, 1
        while found is not None:
            delta = {}
            for rel in own:
                rows = (found.get(rel, set()) | (self.few_plus[rel] if rel in given and first else set())) - added[rel]
                hit = there(rel, rows - gone[rel], before[rel])
                if hit is None or len(added[rel]) + len(rows) > FEW_ROWS:
                    return None
                if rows - hit:
                    delta[rel] = rows - hit
                    added[rel] |= delta[rel]
            first = False
            if not delta or not s.recursive:
                break
            found, steps = rows_of(derive(delta, lambda r: now(r) if r in own else self._lookup(r), steps)), self.options["unroll"]
        if found is None:
            return None
        out = {}
        for rel in own:
            store, parts = self.stores[rel], []
            self.few_plus[rel], self.few_minus[rel] = added[rel] - gone[rel], gone[rel] - added[rel]
            for rows, is_gone in ((self.few_plus[rel], False), (self.few_minus[rel], True)):
                path = store._path()
                if rows:
                    self._local(rel, rows).coalesce(1).write.mode("overwrite").parquet(path)
                parts.append(Part(path, len(rows), is_gone))
            store.add(parts[1], parts[0])
            out[rel] = parts[0], parts[1]
        return out

    def _maintain(self, s: Stratum, changed: set[str], plus, minus, before, given) -> dict[str, tuple[Part, Part]]:
        was = {rel: list(self.stores[rel].parts) for rel in s.relations}
        gone = self._overdelete(s, changed, minus, before, given)
        for rel, parts in gone.items():
            self.stores[rel].add(*parts)
        lost = {rel: self.stores[rel]._plain(parts) for rel, parts in gone.items() if parts}
        # candidates: what insertions give, what is given, and of what was taken away all that has a derivation left
        found = self._derive(s, lambda i, a: plus[a.rel] if a.rel in changed and a.rel in plus else None, lambda a: self._lookup(a.rel))
        for rel in s.relations:
            more = [self._read(rel, given[rel][0])] if rel in given and given[rel][0].n else []
            if rel in lost:
                more += self._rederive(s, rel, lost[rel])
            if rel in found:
                more.append(found[rel])
            if more:
                found[rel] = reduce(DataFrame.union, more)
        delta = {}
        for rel, df in found.items():
            store = self.stores[rel]
            made = store.write(df.distinct())
            delta[rel] = store.write(store.absent_small(made)) if made.n and store.parts else made
        for rel, part in delta.items():
            self.stores[rel].add(part)
        if s.recursive and any(p.n for p in delta.values()):
            f = Fixpoint(self.spark, self.program, s, self._lookup, {}, nested=self.nested, stores={r: self.stores[r] for r in s.relations}, **self.options)
            f.run(delta)
            remove_dir(f.folder)
        out = {}
        for rel in s.relations:
            store = self.stores[rel]
            less = gone.get(rel, [])
            more = [p for p in store.parts if p not in was[rel] and not p.gone]
            if less and more:  # what came back isn't a change
                a, b = store._plain(less), store._plain(more)
                names = self.schema(rel).names
                signed = b.join(a, names, "left_anti").withColumn(DIFF, F.lit(1).cast("long")).unionByName(a.join(b, names, "left_anti").withColumn(DIFF, F.lit(-1).cast("long")))
                out[rel] = store.write_signed(signed)
            elif less or more:
                parts = less or more
                only = parts[0] if len(parts) == 1 else Part("", 0)
                if len(parts) > 1:
                    only = store.write(store._plain(parts), gone=bool(less))
                out[rel] = (Part("", 0), only) if less else (only, Part("", 0))
        return out

    def _overdelete(self, s: Stratum, changed: set[str], minus, before, given) -> dict[str, list[Part]]:
        """Rows with a derivation from a removed row, by the states before the step."""
        out: dict[str, list[Part]] = {}
        old = lambda rel: Relation(self.stores[rel].of(before[rel]), True)
        found = self._derive(s, lambda i, a: minus[a.rel] if a.rel in changed and a.rel in minus else None, lambda a: old(a.rel))
        for rel in s.relations:
            if rel in given and given[rel][1].n:
                df = self._read(rel, given[rel][1])
                found[rel] = found[rel].union(df) if rel in found else df
        while found:
            delta = {}
            for rel, df in found.items():
                store = self.stores[rel]
                made = store.write(df.distinct())
                if not made.n:
                    continue
                rows = store.read(made)
                names = self.schema(rel).names
                there = old(rel).df.join(F.broadcast(rows) if made.n <= SMALL_ROWS else rows, names, "left_semi")
                if out.get(rel):
                    there = there.join(store._plain(out[rel]), names, "left_anti")
                part = store.write(there, gone=True)
                if part.n:
                    out.setdefault(rel, []).append(part)
                    delta[rel] = store.read(part)
            if not delta or not s.recursive:
                break
            found = self._derive(s, lambda i, a: delta[a.rel] if a.rel in delta else None, lambda a: old(a.rel))  # noqa: B023
        return out

    def _rederive(self, s: Stratum, rel: str, lost: DataFrame, now: Callable[[str], Relation] | None = None) -> list[DataFrame]:
        """Of rows that were taken away, those that a rule still gives or that are given. Rules begin with the rows that are asked for."""
        out, names = [], self.schema(rel).names
        look = now or self._lookup
        if self.base[rel]:
            out.append(self._given(rel).df.join(lost, names, "left_semi"))
        for r in s.rules:
            if r.rel != rel:
                continue
            if r.args and all(isinstance(a, (Var, Const)) for a in r.args):
                asked = Rule(r.rel, r.args, (Atom(GONE, r.args), *r.body), r.line)
                columns = self.program.columns | {GONE: self.program.columns[rel]}
                find = lambda j, b: Relation(lost, True) if b.rel == GONE else look(b.rel)
                out.append(compile_rule(self.spark, asked, find, columns, 0).df)
            else:
                df = compile_rule(self.spark, r, lambda _, a: look(a.rel), self.program.columns).df
                out.append(df.join(lost, names, "left_semi"))
        return out

    def step(self) -> list[tuple[str, tuple, int]]:
        """The changes as (relation, row, +1 or -1): for each stratum those that appeared, then those that disappeared."""
        frames = self.step_frame()
        out = []
        for s in self.program.strata:
            rows = [(rel, tuple(r)[:-1] if self.program.columns[rel] else (), r[DIFF]) for rel in s.relations if rel in frames for r in frames[rel].collect()]
            rows.sort(key=lambda x: (-x[2], x[0], repr(x[1])))
            out += rows
        for x in out:
            if self.on_delta:
                self.on_delta(*x)
        return out

    def _call(self, frames: dict[str, DataFrame]) -> None:
        """Tells the changes: of each stratum those that appeared, then those that disappeared. They are sorted by Spark, and the driver has
        one partition of them at a time."""
        for s in self.program.strata:
            known = [rel for rel in sorted(s.relations) if rel in frames]
            for sign in (1, -1):
                for rel in known:
                    names = self.schema(rel).names
                    rows = frames[rel].filter(F.col(DIFF) == sign).orderBy(*[F.col(f"`{c}`") for c in names])
                    for r in rows.toLocalIterator():
                        self.on_delta(rel, tuple(r)[:-1] if self.program.columns[rel] else (), sign)

    def set_delta_callback(self, fn: Callable[[str, tuple, int], None] | None) -> None:
        self.on_delta = fn

    def snapshot(self, rel: str | None = None) -> dict[str, DataFrame] | DataFrame:
        """The present state (pending changes are evaluated first, and told)."""
        if self.pending or self.rows:
            frames = self.step_frame()
            if self.on_delta:
                self._call(frames)
        return self.state[rel] if rel else {r: self.state[r] for r in self.program.outputs()}
