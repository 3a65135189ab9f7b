"""python -m rulespan PROGRAM.dl [--delta] [--watch [N]] [--workers N] [--load-adapter MODULE[:FUNCTION]]"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

from rulespan.engine import Engine
from rulespan.plans.program import Program, ProgramError
from rulespan.plans.syntax import DatalogSyntaxError
from rulespan.sources.adapters import load_plugin
from rulespan.sources.sinks import show_delta, show_tuple
from rulespan.streaming.session import Session


def watch_lines(lines: Iterable[str], session: Session) -> Iterator[list[tuple[str, tuple, int]]]:
    """Each line ``rel v1 v2`` or ``rel,v1,v2`` is an insertion and a step, ``-rel ...`` a removal; # begins a comment."""
    for line in lines:
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        rel, *values = [x.strip() for x in line.split(",")] if "," in line else line.split()
        change = session.insert
        if rel.startswith("-"):
            rel, change = rel[1:], session.remove
        if rel not in session.program.relations:
            raise ProgramError(f"{rel} isn't in the program")
        kinds = [c.type in ("string", "symbol") for c in session.program.columns[rel]]
        if len(kinds) != len(values):
            raise ProgramError(f"{rel} has {len(kinds)} columns, not {len(values)}")
        change(rel, tuple(v.strip('"') if s else int(v) for v, s in zip(values, kinds)))
        yield session.step()


def run_text(spark: SparkSession, program: Program, base_dir: str = ".") -> Iterator[str]:
    """The lines that a program shows; files are written."""
    e = Engine(spark, program, base_dir=base_dir)
    for rel in e.write_outputs():
        rows = [tuple(r) if program.columns[rel] else () for r in e.relation(rel).toLocalIterator()]
        for row in sorted(rows, key=repr):
            yield show_tuple(rel, row)
    for rel, n in e.sizes().items():
        yield f"{rel}\t{n}"


def run_delta(spark: SparkSession, program: Program, base_dir: str = ".") -> Iterator[str]:
    for x in Session(spark, program, base_dir=base_dir).step():
        yield show_delta(*x)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None, stdin=None) -> int:
    p = argparse.ArgumentParser(prog="rulespan", description=__doc__)
    p.add_argument("program")
    p.add_argument("--delta", action="store_true", help="show derived tuples as changes")
    p.add_argument("--watch", nargs="?", type=int, const=0, default=None, metavar="N", help="read changes from standard input, N lines at most")
    p.add_argument("--workers", type=int, default=None, help="cores of a local Spark (1 to 256)")
    p.add_argument("--load-adapter", action="append", default=[], metavar="MODULE")
    p.add_argument("--base-dir", default=".")
    p.add_argument("--explain", action="store_true")
    p.add_argument("--extended", action="store_true", help="allow brackets, unary minus and compound heads")
    a = p.parse_args(argv)
    out = out or sys.stdout
    if a.workers is not None and not 1 <= a.workers <= 256:
        p.error("--workers is from 1 to 256")
    try:
        for m in a.load_adapter:
            load_plugin(m)
        program = Program.load(a.program, a.extended)
        if a.explain:
            print(program.explain(), file=out)
            return 0
        spark = spark or SparkSession.builder.master(f"local[{a.workers or '*'}]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
        if a.watch is not None:
            session = Session(spark, program, base_dir=a.base_dir)
            for x in session.step():
                print(show_delta(*x), file=out)
            for k, changes in enumerate(watch_lines(stdin or sys.stdin, session), 1):
                for x in changes:
                    print(show_delta(*x), file=out)
                out.flush()
                if a.watch and k >= a.watch:
                    break
        else:
            for line in (run_delta if a.delta else run_text)(spark, program, a.base_dir):
                print(line, file=out)
    except (DatalogSyntaxError, ProgramError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
