"""Programs over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespan.functions import scalar
from rulespan.operators.fixpoint import MAX_ITERATIONS, UNROLL, UNROLL_ROWS, Fixpoint, Pass, is_scan
from rulespan.operators.rules import Relation, compile_rule, schema_of, spark_type, union
from rulespan.plans.magic import base, magic
from rulespan.plans.program import ArityError, Program, ProgramError
from rulespan.plans.syntax import Atom
from rulespan.shared import work_dir
from rulespan.sources.adapters import Context, conform, read_input
from rulespan.sources.sinks import write_output

_functions: dict[str, int] = {}


def register_function(name: str, kinds: tuple[str, ...], result: str, fn: Callable[..., Column]) -> None:
    """A scalar function for programs: kinds and result are "int" or "string", fn takes and gives columns."""
    scalar.register(name, kinds, result, fn)
    _functions[name] = len(kinds)


class Engine:
    """Evaluates a program. inputs: DataFrames of relations, by position of columns.

    Non-recursive relations stay lazy plans; what is used by several others or within a recursion is
    written to the shared folder once. sets: inputs that have no row twice, which saves a shuffle each.
    nulls: "raise", or "drop" to leave rows of inputs out that have one. unroll_rows: deltas of at most so many rows take several steps a job."""

    def __init__(
        self, spark: SparkSession, program: Program | str, inputs: dict[str, DataFrame] | None = None, *, sets: frozenset[str] | set[str] = frozenset(), base_dir: str = ".",
        max_iterations: int = MAX_ITERATIONS, doubling: bool = False, unroll: int = UNROLL, unroll_rows: int = UNROLL_ROWS, semijoins: bool = False, extended: bool = False, nulls: str = "raise",
    ):
        spark.conf.set("spark.sql.ansi.enabled", "false")  # integers wrap
        self.spark = spark
        self.program = program if isinstance(program, Program) else Program.parse(program, extended, _functions)
        self.options = dict(max_iterations=max_iterations, doubling=doubling, unroll=unroll, unroll_rows=unroll_rows, semijoins=semijoins)
        self.base_dir, self.sets, self.nulls = base_dir, sets, nulls
        self.inputs = dict(inputs or {})
        self.nested: dict[str, list[T.DataType]] = {}
        for rel, df in self.inputs.items():
            if rel not in self.program.relations:
                raise ProgramError(f"{rel} isn't in the program")
            if self.program.relations[rel].columns is None and rel not in self.program.arity:
                self.program.relations[rel].columns = None
            if len(df.columns) != self.program.arity.get(rel, len(df.columns)):
                raise ArityError(f"{rel} has {self.program.arity[rel]} columns, not {len(df.columns)}")
            self._learn(rel, df)
        self._learn_facts()
        self.done: dict[str, Relation] = {}
        self.passes: list[Pass] = []
        self.strata = {r: s for s in self.program.strata for r in s.relations}

    # --- types of compounds

    def _learn(self, rel: str, df: DataFrame):
        for c, f in zip(self.program.columns.get(rel, []), df.schema.fields):
            if c.arity and isinstance(f.dataType, T.StructType):
                self.nested[c.type] = [T.LongType() if isinstance(x.dataType, T.IntegralType) else x.dataType for x in f.dataType.fields]

    def _learn_facts(self):
        def of(v):
            if isinstance(v, tuple):
                inner = self.nested.setdefault(v[0], [of(x) for x in v[1:]])
                return T.StructType([T.StructField(f"arg{k}", t) for k, t in enumerate(inner)])
            return T.StringType() if isinstance(v, str) else T.LongType()

        for rows in self.program.text.facts.values():
            for v in rows[0]:
                of(v)

    def schema(self, rel: str) -> T.StructType:
        return schema_of(self.program.columns[rel], self.nested)

    # --- relations

    def given(self, rel: str) -> Relation | None:
        """Facts, inputs and .input together, or None."""
        parts = []
        schema = self.schema(rel)
        if facts := self.program.facts(rel):
            strip = lambda v: tuple(map(strip, v[1:])) if isinstance(v, tuple) else v
            rows = list(dict.fromkeys(tuple(strip(v) for v in row) or (1,) for row in facts))
            parts.append(Relation(self.spark.createDataFrame(rows, schema), True))
        if rel in self.inputs:
            parts.append(Relation(conform(self.inputs[rel], schema, rel, self.nulls), rel in self.sets))
        else:
            for params in self.program.relations[rel].inputs:
                parts.append(Relation(read_input(Context(self.spark, rel, schema, params, self.base_dir)), False))
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else union(parts)

    def lookup(self, rel: str) -> Relation:
        if rel not in self.done:
            if rel in self.strata:
                self._evaluate(self.strata[rel])
            else:
                r = self.given(rel)
                self.done[rel] = r or Relation(self.spark.createDataFrame([], self.schema(rel)), True)
        return self.done[rel]

    def _evaluate(self, stratum):
        if stratum.recursive:
            seeds = {r: g for r in stratum.relations if (g := self.given(r))}
            f = Fixpoint(self.spark, self.program, stratum, self.lookup, seeds, nested=self.nested, **self.options)
            self.done |= f.run()
            self.passes += f.passes
            return
        (rel,) = stratum.relations
        parts = [g] if (g := self.given(rel)) else []
        for r in stratum.rules:
            parts.append(compile_rule(self.spark, r, lambda _, a: self.lookup(a.rel), self.program.columns, None, self.options["semijoins"]))
        out = union(parts)
        uses = sum(isinstance(a, Atom) and a.rel == rel for r in self.program.rules for a in r.body)
        if uses > 1 and not is_scan(out.df):  # else it would be computed by each of them
            path = f"{work_dir(self.spark, 'relation')}/{rel}"
            out.df.write.parquet(path)
            out = Relation(self.spark.read.schema(out.df.schema).parquet(path), True)
        self.done[rel] = out

    def relation(self, rel: str) -> DataFrame:
        """The set of its tuples."""
        if rel not in self.program.relations:
            raise ProgramError(f"{rel} isn't in the program")
        r = self.lookup(rel)
        return r.df if r.is_set else r.df.distinct()

    def run(self) -> dict[str, DataFrame]:
        """All output relations."""
        return {r: self.relation(r) for r in self.program.outputs()}

    def count(self, rel: str) -> int:
        return self.relation(rel).count()

    def sizes(self) -> dict[str, int]:
        """Of the relations with .printsize."""
        return {r: self.count(r) for r, s in self.program.relations.items() if s.printsize}

    def query(self, rel: str, bound: dict[int, int | str] | None = None, adornment: str | None = None) -> DataFrame:
        """Tuples of rel with the bound positions, by magic sets. adornment: one of rel's .query directives that the positions must fit."""
        bound = bound or {}
        if adornment is not None and (adornment not in self.program.relations[rel].queries or {k for k, c in enumerate(adornment) if c == "b"} != set(bound)):
            raise ProgramError(f".query {rel}({', '.join(adornment)}) isn't declared, or other positions are bound")
        given = frozenset(r for r in self.program.idb if r in self.inputs or self.program.relations[r].inputs)
        program, answer, self.magic_stats = magic(self.program, rel, bound, given)
        if answer == rel:
            df = self.relation(rel)
        else:
            inputs = {}
            for r in program.relations:
                origin = r[: -len(base(""))] if r.endswith(base("")) else r
                if origin in self.program.relations and (origin in self.inputs or self.program.relations[origin].inputs):
                    inputs[r] = self.given_inputs(origin)
            e = Engine(self.spark, program, inputs, sets=self.sets, base_dir=self.base_dir, nulls=self.nulls, **self.options)
            df = e.relation(answer)
            self.passes = e.passes
        names = df.columns
        for k, v in bound.items():
            df = df.filter(F.col(f"`{names[k]}`") == F.lit(v))
        return df

    def given_inputs(self, rel: str) -> DataFrame:
        if rel in self.inputs:
            return self.inputs[rel]
        parts = [read_input(Context(self.spark, rel, self.schema(rel), p, self.base_dir)) for p in self.program.relations[rel].inputs]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def write_outputs(self) -> list[str]:
        """Writes the relations whose .output names a file; returns the others, which are to be shown."""
        shown = []
        for rel in self.program.outputs():
            files = [p for p in self.program.relations[rel].outputs if p.get("filename")]
            for p in files:
                write_output(self.relation(rel), p, self.base_dir)
            if not files:
                shown.append(rel)
        return shown

    def explain(self) -> str:
        return self.program.explain()


__all__ = ["Engine", "register_function", "spark_type"]
