"""Queries over the test tables: a program each, and the SQL that gives the same rows.

Integers load as BIGINT, money as cents, timestamps as microseconds; the SQL does the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulespan.engine import Engine, register_function
from rulespan.operators import signed
from rulespan.shared import work_dir
from rulespan.streaming.session import Session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

cents = lambda c: F.round(F.col(c) * 100).cast("long").alias(c)
micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
big = lambda c: F.col(c).cast("long").alias(c)
CENTS = "cast(round({0} * 100) as bigint)"


def table(spark: SparkSession, sf_dir: str, name: str, *columns) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[big(c) if isinstance(c, str) and df.schema[c].dataType.typeName() in ("integer", "long") else c for c in columns])


def region(s, d): return table(s, d, "region", "r_regionkey", "r_name")  # noqa: E704
def nation(s, d): return table(s, d, "nation", "n_nationkey", "n_name", "n_regionkey")  # noqa: E704
def customer(s, d): return table(s, d, "customer", "c_custkey", "c_nationkey", cents("c_acctbal"), "c_mktsegment")  # noqa: E704
def supplier(s, d): return table(s, d, "supplier", "s_suppkey", "s_name", "s_nationkey", cents("s_acctbal"))  # noqa: E704
def part(s, d): return table(s, d, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size", cents("p_retailprice"))  # noqa: E704
def orders(s, d): return table(s, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", cents("o_totalprice"), micros("o_orderdate"), "o_orderpriority")  # noqa: E704
def lineitem(s, d): return table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", big("l_quantity"), cents("l_extendedprice"), "l_returnflag")  # noqa: E704
def events(s, d): return table(s, d, "events", "event_id", "user_id", micros("ts"), "event_type")  # noqa: E704


def chain(s: SparkSession, d: str) -> DataFrame:
    """Consecutive events of a user, in sessions of 12."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return events(s, d).select(F.lag("event_id").over(w).alias("a"), F.col("event_id").alias("b"), F.row_number().over(w).alias("k")).filter("k % 12 != 1").select("a", "b")


CHAIN_SQL = "chain as (select lag(event_id) over (partition by user_id order by event_id) as a, event_id as b, row_number() over (partition by user_id order by event_id) as k from events), edge as (select a, b from chain where k % 12 <> 1)"


def trade(s: SparkSession, d: str) -> DataFrame:
    """Nations of customers and of the suppliers that served them."""
    li = lineitem(s, d).select("l_orderkey", "l_suppkey")
    o = orders(s, d).select("o_orderkey", "o_custkey")
    c, p = customer(s, d).select("c_custkey", "c_nationkey"), supplier(s, d).select("s_suppkey", "s_nationkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(p, F.col("l_suppkey") == F.col("s_suppkey")).filter("(c_nationkey + s_nationkey) % 7 = 0").select("c_nationkey", "s_nationkey").distinct()


TRADE_SQL = "trade as (select distinct c_nationkey::bigint as a, s_nationkey::bigint as b from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where (c_nationkey + s_nationkey) % 7 = 0)"

DECL = {
    "region": ".decl region(k: int64, name: string)",
    "nation": ".decl nation(k: int64, name: string, r: int64)",
    "customer": ".decl customer(c: int64, n: int64, bal: int64, seg: string)",
    "supplier": ".decl supplier(s: int64, name: string, n: int64, bal: int64)",
    "part": ".decl part(p: int64, name: string, brand: string, type: string, size: int64, price: int64)",
    "orders": ".decl orders(o: int64, c: int64, status: string, total: int64, day: int64, prio: string)",
    "lineitem": ".decl lineitem(o: int64, line: int64, p: int64, s: int64, qty: int64, price: int64, flag: string)",
    "events": ".decl events(e: int64, u: int64, ts: int64, kind: string)",
    "edge": ".decl edge(a: int64, b: int64)",
    "trade": ".decl trade(a: int64, b: int64)",
}
LOAD = {"region": region, "nation": nation, "customer": customer, "supplier": supplier, "part": part, "orders": orders, "lineitem": lineitem, "events": events, "edge": chain, "trade": trade}


def inputs_of(spark: SparkSession, sf_dir: str, text: str) -> tuple[str, dict[str, DataFrame]]:
    words = {w for w in DECL if f"{w}(" in text.replace("!", " ")}
    return "\n".join(DECL[w] for w in sorted(words)) + "\n" + text, {w: LOAD[w](spark, sf_dir) for w in sorted(words)}


def engine(spark: SparkSession, sf_dir: str, text: str, **options) -> Engine:
    program, inputs = inputs_of(spark, sf_dir, text)
    return Engine(spark, program, inputs, sets=frozenset(inputs), **options)


def add(name: str, out: str, text: str, sql: str | None, **options):
    QUERIES[name] = partial(_run, out=out, text=text, options=options)
    if sql:
        ORACLE[name] = sql


def _run(spark: SparkSession, sf_dir: str, out: str, text: str, options: dict) -> DataFrame:
    return engine(spark, sf_dir, text, **options).relation(out)


# --- scans, filters, expressions

add("scan_project", "q", ".decl q(name: string, r: int64)\nq(N, R) :- nation(_, N, R).", "select distinct n_name as name, n_regionkey::bigint as r from nation")
add("filter_const", "q", '.decl q(o: int64, total: int64)\nq(O, T) :- orders(O, _, "F", T, _, _), T > 20000000.', f"select o_orderkey as o, {CENTS.format('o_totalprice')} as total from orders where o_orderstatus = 'F' and {CENTS.format('o_totalprice')} > 20000000")
add("repeated_var", "q", ".decl q(x: int64)\nq(X) :- trade(X, X).", f"with {TRADE_SQL} select a as x from trade where a = b")
add("arith_left_assoc", "q", ".decl q(p: int64, v: int64)\nq(P, S + P * 3 - 1) :- part(P, _, _, _, S, _).", "select distinct p_partkey as p, (p_size::bigint + p_partkey) * 3 - 1 as v from part")
add("div_by_zero", "q", ".decl q(p: int64, d: int64, m: int64)\nq(P, P / Z, P % Z) :- part(P, _, _, _, S, _), Z = S % 5.", "select distinct p_partkey as p, case when p_size % 5 = 0 then 0 else p_partkey // (p_size % 5) end as d, case when p_size % 5 = 0 then 0 else p_partkey % (p_size % 5) end as m from part")
add(
    "bitwise_ops", "q", ".decl q(p: int64, a: int64, b: int64, c: int64, n: int64, l: int64, r: int64)\nq(P, band(P, S), bor(P, S), bxor(P, S), bnot(P), bshl(P, 3), bshr(P, 2)) :- part(P, _, _, _, S, _).",
    "select distinct p_partkey as p, p_partkey & p_size::bigint as a, p_partkey | p_size::bigint as b, xor(p_partkey, p_size::bigint) as c, ~p_partkey as n, p_partkey << 3 as l, p_partkey >> 2 as r from part",
)
add("string_predicates", "q", '.decl q(p: int64)\nq(P) :- part(P, N, B, T, _, _), contains(T, "E"), str_prefix(B, "B"), str_suffix(B, "1").', "select distinct p_partkey as p from part where contains(p_type, 'E') and starts_with(p_brand, 'B') and ends_with(p_brand, '1')")
add(
    "string_scalar", "q", '.decl q(p: int64, n: int64, up: string, low: string, sub: string, rep: string, ord: int64, cat: string, num: int64)\nq(P, strlen(N), to_upper(N), to_lower(N), substr(N, 1, 4), str_replace(N, "a", "##"), str_ord(N), cat(trim(N), to_string(P)), to_number(to_string(P))) :- part(P, N, _, _, _, _).',
    "select distinct p_partkey as p, length(p_name)::bigint as n, upper(p_name) as up, lower(p_name) as low, substr(p_name, 2, 4) as sub, replace(p_name, 'a', '##') as rep, ord(p_name)::bigint as ord, trim(p_name) || p_partkey::varchar as cat, p_partkey as num from part",
)
add("comparisons", "q", ".decl q(a: int64, b: int64)\nq(A, B) :- nation(A, NA, _), nation(B, NB, _), NA < NB, A >= B, A != B.", "select x.n_nationkey::bigint as a, y.n_nationkey::bigint as b from nation x, nation y where x.n_name < y.n_name and x.n_nationkey >= y.n_nationkey and x.n_nationkey <> y.n_nationkey")
add("boolean_literals", "q", ".decl q(k: int64)\nq(K) :- region(K, _), True.\nq(K) :- nation(K, _, _), False.", "select r_regionkey::bigint as k from region")
add("binding_equation", "q", ".decl q(c: int64, v: int64)\nq(C, V) :- customer(C, N, B, _), V = B / 100 + N, V > 5000.", f"select * from (select distinct c_custkey as c, (case when {CENTS.format('c_acctbal')} >= 0 then {CENTS.format('c_acctbal')} // 100 else -(-{CENTS.format('c_acctbal')} // 100) end) + c_nationkey as v from customer) where v > 5000")
add("inline_facts", "q", '.decl tier(seg: string, t: int64)\ntier("BUILDING", 1). tier("MACHINERY", 2). tier("BUILDING", 1).\n.decl q(c: int64, t: int64)\nq(C, T) :- customer(C, _, _, S), tier(S, T).', "select c_custkey as c, case c_mktsegment when 'BUILDING' then 1::bigint else 2::bigint end as t from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")

# --- joins, negation, set operations

add("equi_join_2", "q", ".decl q(c: int64, o: int64, seg: string)\nq(C, O, S) :- customer(C, _, _, S), orders(O, C, _, _, _, _).", "select c_custkey as c, o_orderkey as o, c_mktsegment as seg from customer join orders on c_custkey = o_custkey")
add(
    "join_chain_4", "q", ".decl q(r: string, o: int64)\nq(R, O) :- region(K, R), nation(N, _, K), customer(C, N, _, _), orders(O, C, _, _, _, _).",
    "select r_name as r, o_orderkey as o from region join nation on r_regionkey = n_regionkey join customer on n_nationkey = c_nationkey join orders on c_custkey = o_custkey",
)
add("join_multi_key", "q", ".decl q(o: int64, p: int64, l1: int64, l2: int64)\nq(O, P, A, B) :- lineitem(O, A, P, _, _, _, _), lineitem(O, B, P, _, _, _, _), A < B.", "select distinct a.l_orderkey as o, a.l_partkey as p, a.l_linenumber::bigint as l1, b.l_linenumber::bigint as l2 from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey = b.l_partkey and a.l_linenumber < b.l_linenumber")
add("cross_join_small", "q", ".decl q(a: string, b: string)\nq(A, B) :- region(_, A), region(_, B).", "select distinct x.r_name as a, y.r_name as b from region x, region y")
add("theta_join", "q", ".decl q(a: int64, b: int64)\nq(A, B) :- supplier(A, _, N, X), supplier(B, _, N, Y), X > Y, A != B.", f"select x.s_suppkey as a, y.s_suppkey as b from supplier x join supplier y on x.s_nationkey = y.s_nationkey and {CENTS.format('x.s_acctbal')} > {CENTS.format('y.s_acctbal')} and x.s_suppkey <> y.s_suppkey")
add("multiway_one_key", "q", ".decl q(n: int64, c: int64, s: string)\nq(N, C, S) :- nation(N, _, _), customer(C, N, _, _), supplier(_, S, N, _).", "select distinct n_nationkey::bigint as n, c_custkey as c, s_name as s from nation join customer on c_nationkey = n_nationkey join supplier on s_nationkey = n_nationkey")
add("semijoin_idiom", "q", ".decl q(c: int64)\nq(C) :- customer(C, _, _, _), orders(_, C, _, _, _, _).", "select c_custkey as c from customer where c_custkey in (select o_custkey from orders)", semijoins=True)
add("negation_anti", "q", ".decl q(c: int64)\n.decl buys(c: int64)\nbuys(C) :- orders(_, C, _, T, _, _), T > 40000000.\nq(C) :- customer(C, _, _, _), !buys(C).", f"select c_custkey as c from customer where c_custkey not in (select o_custkey from orders where {CENTS.format('o_totalprice')} > 40000000)")
add("negation_wildcard", "q", ".decl q(p: int64)\nq(P) :- part(P, _, _, _, _, _), !lineitem(_, 1, P, _, _, _, _).", "select p_partkey as p from part where p_partkey not in (select l_partkey from lineitem where l_linenumber = 1)")
add("negation_unshared", "q", ".decl q(k: int64)\n.decl huge(o: int64)\nhuge(O) :- orders(O, _, _, T, _, _), T > 900000000000.\nq(K) :- region(K, _), !huge(_).", f"select r_regionkey::bigint as k from region where not exists (select 1 from orders where {CENTS.format('o_totalprice')} > 900000000000)")
add("union_rules", "q", ".decl q(n: int64)\nq(N) :- customer(_, N, B, _), B > 900000.\nq(N) :- supplier(_, _, N, B), B > 900000.", f"select c_nationkey::bigint as n from customer where {CENTS.format('c_acctbal')} > 900000 union select s_nationkey::bigint from supplier where {CENTS.format('s_acctbal')} > 900000")
add("set_difference", "q", ".decl c(n: int64)\n.decl s(n: int64)\n.decl q(n: int64)\nc(N) :- customer(_, N, _, _).\ns(N) :- supplier(_, _, N, B), B > 500000.\nq(N) :- c(N), !s(N).", f"select c_nationkey::bigint as n from customer except select s_nationkey::bigint from supplier where {CENTS.format('s_acctbal')} > 500000")
add("set_intersection", "q", ".decl q(n: int64)\nq(N) :- customer(_, N, B, _), supplier(_, _, N, C), B > 800000, C > 800000.", f"select c_nationkey::bigint as n from customer where {CENTS.format('c_acctbal')} > 800000 intersect select s_nationkey::bigint from supplier where {CENTS.format('s_acctbal')} > 800000")

# --- aggregates

add("agg_count", "q", ".decl q(c: int64, n: int64)\nq(C, count(O)) :- orders(O, C, _, _, _, _).", "select o_custkey as c, count(*) as n from orders group by 1")
add("agg_sum_expr", "q", ".decl q(flag: string, v: int64)\nq(F, sum(P * Q)) :- lineitem(_, _, _, _, Q, P, F).", f"select l_returnflag as flag, cast(sum({CENTS.format('l_extendedprice')} * cast(l_quantity as bigint)) as bigint) as v from lineitem group by 1")
add("agg_min_max", "q", ".decl q(lo: int64, n: int64, hi: int64)\nq(min(B), N, max(B)) :- customer(_, N, B, _).", f"select min({CENTS.format('c_acctbal')}) as lo, c_nationkey::bigint as n, max({CENTS.format('c_acctbal')}) as hi from customer group by 2")
add("agg_average", "q", ".decl q(c: int64, v: int64)\nq(C, average(T)) :- orders(_, C, _, T, _, _).", f"select o_custkey as c, cast(sum({CENTS.format('o_totalprice')}) as bigint) // count(*) as v from orders group by 1")
add("agg_global", "q", ".decl q(n: int64, m: int64)\nq(count(O), max(T)) :- orders(O, _, _, T, _, _).", f"select count(*) as n, max({CENTS.format('o_totalprice')}) as m from orders")
add("agg_global_empty", "q", ".decl q(n: int64)\nq(count(O)) :- orders(O, _, _, T, _, _), T < 0.", "select 1::bigint as n where false")
add("agg_join_body", "q", ".decl q(r: string, n: int64)\nq(R, count(C)) :- region(K, R), nation(N, _, K), customer(C, N, _, _).", "select r_name as r, count(*) as n from region join nation on r_regionkey = n_regionkey join customer on c_nationkey = n_nationkey group by 1")
add("having_idiom", "q", ".decl n(c: int64, n: int64)\n.decl q(c: int64)\nn(C, count(O)) :- orders(O, C, _, _, _, _).\nq(C) :- n(C, N), N > 12.", "select o_custkey as c from orders group by 1 having count(*) > 12")
add("lww_latest", "q", ".decl last(c: int64, t: int64)\n.decl q(c: int64, o: int64, t: int64)\nlast(C, max(T)) :- orders(_, C, _, _, T, _).\nq(C, O, T) :- last(C, T), orders(O, C, _, _, T, _).", "select o_custkey as c, o_orderkey as o, epoch_us(o_orderdate) as t from orders qualify rank() over (partition by o_custkey order by o_orderdate desc) = 1")
add(
    "multi_source_reconcile", "q", '.decl a(n: int64, src: string)\n.decl q(n: int64, src: string, k: int64)\na(N, "c") :- customer(_, N, _, _).\na(N, "s") :- supplier(_, _, N, _).\n.decl inc(n: int64)\ninc(N) :- customer(_, N, _, _).\n.decl merged(n: int64, src: string)\nmerged(N, "c") :- inc(N).\nmerged(N, "s") :- supplier(_, _, N, _), !inc(N).\n.decl size(n: int64, k: int64)\nsize(N, count(S)) :- a(N, S).\nq(N, S, K) :- merged(N, S), size(N, K).',
    "with a as (select distinct c_nationkey::bigint as n, 'c' as src from customer union select s_nationkey, 's' from supplier), m as (select n, src from a where src = 'c' union all select n, src from a where src = 's' and n not in (select n from a where src = 'c')) select m.n, m.src, (select count(*) from a where a.n = m.n) as k from m",
)

# --- recursion

TC = ".decl tc(a: int64, b: int64)\ntc(A, B) :- edge(A, B).\n"
TC_SQL = f"with recursive {CHAIN_SQL}, tc as (select a, b from edge union select tc.a, edge.b from tc join edge on tc.b = edge.a) select a, b from tc"
add("tc_linear", "tc", TC + "tc(A, C) :- tc(A, B), edge(B, C).", TC_SQL)
add("tc_nonlinear", "tc", TC + "tc(A, C) :- tc(A, B), tc(B, C).", TC_SQL)
add("tc_doubling", "tc", TC + "tc(A, C) :- tc(A, B), edge(B, C).", TC_SQL, doubling=True)
add("reach_from_seed", "r", ".decl r(x: int64)\nr(3).\nr(Y) :- r(X), trade(X, Y).", f"with recursive {TRADE_SQL}, r as (select 3::bigint as x union select b from r join trade on x = a) select x from r")
add("same_generation", "sg", ".decl sg(x: int64, y: int64)\nsg(X, Y) :- trade(P, X), trade(P, Y), X != Y.\nsg(X, Y) :- trade(A, X), sg(A, B), trade(B, Y).", f"with recursive {TRADE_SQL}, sg as (select x.b as x, y.b as y from trade x join trade y on x.a = y.a and x.b <> y.b union select t.b, u.b from sg join trade t on t.a = sg.x join trade u on u.a = sg.y) select x, y from sg")


def graph_of(name: str, make: Callable[[DataFrame], DataFrame]) -> None:
    """A graph over the numbers of suppliers."""
    LOAD[name] = lambda s, d: make(supplier(s, d).select("s_suppkey")).select("a", "b").distinct()
    DECL[name] = f".decl {name}(a: int64, b: int64)"


#: Chains of 100, and a graph in which a hundredth of the nodes have most of the edges.
graph_of("chain100", lambda n: n.filter("s_suppkey < 400 and s_suppkey % 100 != 99").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b")))
graph_of("hubs", lambda n: n.filter("s_suppkey < 600").select(F.col("s_suppkey").alias("a"), F.expr("if(s_suppkey % 3 = 0, s_suppkey * 7 % 600, s_suppkey % 6 * 100)").alias("b")))
LONG_SQL = "chain100 as (select s_suppkey as a, s_suppkey + 1 as b from supplier where s_suppkey < 400 and s_suppkey % 100 <> 99)"
HUBS_SQL = "hubs as (select distinct s_suppkey as a, case when s_suppkey % 3 = 0 then s_suppkey * 7 % 600 else s_suppkey % 6 * 100 end as b from supplier where s_suppkey < 600)"
for _graph, _sql in (("chain100", LONG_SQL), ("hubs", HUBS_SQL)):
    _tc = f"with recursive {_sql}, tc as (select a, b from {_graph} union select tc.a, g.b from tc join {_graph} g on tc.b = g.a) select a, b from tc"
    for _how, _options in (("linear", {}), ("doubling", {"doubling": True})):
        add(f"tc_{_graph}_{_how}", "tc", f".decl tc(a: int64, b: int64)\ntc(A, B) :- {_graph}(A, B).\ntc(A, C) :- tc(A, B), {_graph}(B, C).", _tc, **_options)
add("cc_hubs", "cc", ".decl cc(x: int64, l: int64)\ncc(X, min(X)) :- hubs(X, _).\ncc(Y, min(Y)) :- hubs(_, Y).\ncc(Y, min(L)) :- cc(X, L), hubs(X, Y).\ncc(X, min(L)) :- cc(Y, L), hubs(X, Y).", f"with recursive {HUBS_SQL}, e as (select a, b from hubs union select b, a from hubs), r as (select a as x, a as l from e union select e.b, r.l from r join e on r.x = e.a) select x, min(l) as l from r group by 1")
add(
    "mutual_recursion_bipartite", "red", ".decl red(x: int64)\n.decl blue(x: int64)\nred(X) :- edge(X, _), !inner(X).\n.decl inner(x: int64)\ninner(Y) :- edge(_, Y).\nblue(Y) :- red(X), edge(X, Y).\nred(Y) :- blue(X), edge(X, Y).",
    f"with recursive {CHAIN_SQL}, c as (select a as x, 0 as k from edge where a not in (select b from edge) union select b, 1 - k from c join edge on x = a) select x from c where k = 0",
)
add("cc_min_label", "cc", ".decl cc(x: int64, l: int64)\ncc(X, min(X)) :- edge(X, _).\ncc(Y, min(Y)) :- edge(_, Y).\ncc(Y, min(L)) :- cc(X, L), edge(X, Y).\ncc(X, min(L)) :- cc(Y, L), edge(X, Y).", f"with {CHAIN_SQL}, s as (select b as event_id, user_id, (k - 1) // 12 as g from chain join events on b = event_id), u as (select event_id, min(event_id) over (partition by user_id, g) as l, count(*) over (partition by user_id, g) as n from s) select event_id as x, l from u where n > 1")
add("sssp_min", "dist", ".decl w(a: int64, b: int64, c: int64)\nw(A, B, C) :- trade(A, B), C = A * B % 11 + 1.\n.decl dist(x: int64, d: int64)\ndist(3, 0).\ndist(Y, min(D + C)) :- dist(X, D), w(X, Y, C).", f"with recursive {TRADE_SQL}, w as (select a, b, a * b % 11 + 1 as c from trade), p as (select 3::bigint as x, 0::bigint as d union select b, d + c from p join w on a = x where d + c <= 300) select x, min(d) as d from p group by 1")
add("stratified_neg_over_recursion", "q", ".decl r(x: int64)\nr(3).\nr(Y) :- r(X), trade(X, Y).\n.decl q(n: int64)\nq(N) :- nation(N, _, _), !r(N).", f"with recursive {TRADE_SQL}, r as (select 3::bigint as x union select b from r join trade on x = a) select n_nationkey::bigint as n from nation where n_nationkey not in (select x from r)")
add("geo_hierarchy", "part_of", '.decl up(a: string, b: string)\nup(cat("c", to_string(C)), cat("n", to_string(N))) :- customer(C, N, _, _).\nup(cat("n", to_string(N)), cat("r", to_string(R))) :- nation(N, _, R).\n.decl part_of(a: string, b: string)\npart_of(A, B) :- up(A, B).\npart_of(A, C) :- part_of(A, B), up(B, C).', "select 'c' || c_custkey as a, 'n' || c_nationkey as b from customer union select 'n' || n_nationkey, 'r' || n_regionkey from nation union select 'c' || c_custkey, 'r' || n_regionkey from customer join nation on c_nationkey = n_nationkey")


def magic_reach_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = 0
    e = engine(spark, sf_dir, ".query tc(b, f) .\n" + TC + "tc(A, C) :- edge(A, B), tc(B, C).")
    return e.query("tc", {0: first}, "bf")


QUERIES["magic_reach_bound"] = magic_reach_bound
ORACLE["magic_reach_bound"] = f"with recursive {CHAIN_SQL}, tc as (select a, b from edge where a = 0 union select tc.a, edge.b from tc join edge on tc.b = edge.a) select a, b from tc"


# --- named graphs, compounds, hashes


def named_graph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of an event type is its graph; graphs of an even tenant are trusted."""
    e = events(spark, sf_dir)
    triples = e.select("user_id", "event_type", (F.col("user_id") % 7).alias("g"))
    meta = e.select((F.col("user_id") % 7).alias("g")).distinct().select("g", (F.col("g") % 2).alias("tenant"), *[F.lit(0).cast("long").alias(c) for c in ("t", "l", "r", "d")])
    text = ".decl quad(s: int64, p: string, __graph_id: int64)\n.decl safe(s: int64, p: string)\nsafe(U, K) :- quad(U, K, H), __graph_metadata(H, 0, _, _, _, _)."
    return Engine(spark, text, {"quad": triples, "__graph_metadata": meta}).relation("safe")


QUERIES["named_graph_filter"] = named_graph_filter
ORACLE["named_graph_filter"] = "select distinct user_id as s, event_type as p from events where user_id % 7 % 2 = 0"


def compound_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part with its size and price as one term."""
    items = part(spark, sf_dir).select("p_partkey", F.struct(F.col("p_size").alias("a"), F.col("p_retailprice").alias("b")).alias("t"))
    text = ".decl item(k: int64, t: tag/2 inline)\n.decl hot(k: int64, price: int64)\nhot(K, P) :- item(K, tag(S, P)), S > 40."
    return Engine(spark, text, {"item": items}).relation("hot")


QUERIES["compound_struct"] = compound_struct
ORACLE["compound_struct"] = f"select distinct p_partkey as k, {CENTS.format('p_retailprice')} as price from part where p_size > 40"


def _crc_sql(text: str, polynomial: int) -> str:
    """Bit by bit over the bytes of a text."""
    octets = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::ubigint)"
    octet = f"list_reduce(list_prepend(xor(a, b), range(8)::ubigint[]), lambda x, k: xor(x >> 1, (x & 1) * {polynomial}::ubigint))"
    return f"xor(list_reduce(list_prepend(4294967295::ubigint, {octets}), lambda a, b: {octet}), 4294967295::ubigint)::bigint"


def _xxh3_sql(rows: str, key: str) -> str:
    """XXH3-64 of an integer's bytes, by arithmetic of 128 bits."""
    two64 = f"{1 << 64}::uhugeint"
    turned = lambda v, n: f"(({v} * {1 << n}::uhugeint) % {two64} + {v} // {1 << (64 - n)}::uhugeint)"
    prime = f"{0x9FB21C651E98DF25}::uhugeint"
    sql = f"select *, {key}::uhugeint as v from ({rows})"
    for name, e in (
        ("h0", f"xor({turned('v', 32)}, {0x1CAD21F72C81017C ^ 0xDB979083E96DD4DE}::uhugeint)"), ("h1", f"(xor(xor(h0, {turned('h0', 49)}), {turned('h0', 24)}) * {prime}) % {two64}"),
        ("h2", f"(xor(h1, h1 // {1 << 35}::uhugeint + 8::uhugeint) * {prime}) % {two64}"), ("h3", f"xor(h2, h2 // {1 << 28}::uhugeint)"),
    ):
        sql = f"select *, {e} as {name} from ({sql})"
    return f"select {key}, case when h3 >= {1 << 63}::uhugeint then (h3::hugeint - {1 << 64}::hugeint)::bigint else h3::bigint end as h from ({sql})"


def _hmac_sql(text: str, key: bytes) -> str:
    inner, outer = (bytes(x ^ pad for x in key.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({text}))))"


def _uuid5_sql(text: str, space: uuid.UUID) -> str:
    h = f"sha1(unhex('{space.hex}') || encode({text}))"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', (('0x' || substr({h}, 17, 1))::int & 3) + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


add("crc32_check", "q", '.decl q(p: int64, c: int64)\nq(P, crc32_castagnoli(N)) :- part(P, N, _, _, _, _), crc32_ethernet(N) != 0.', f"select distinct p_partkey as p, {_crc_sql('p_name', 0x82F63B78)} as c from part where {_crc_sql('p_name', 0xEDB88320)} <> 0")
add("crc32_ethernet", "q", ".decl q(p: int64, c: int64)\nq(P, crc32_ethernet(N)) :- part(P, N, _, _, _, _).", f"select distinct p_partkey as p, {_crc_sql('p_name', 0xEDB88320)} as c from part")
add("md5_sha", "q", ".decl q(p: int64, m: string, h: string)\nq(P, md5(N), sha256(N)) :- part(P, N, _, _, _, _).", "select distinct p_partkey as p, md5(p_name) as m, sha256(p_name) as h from part")
add(
    "sha1_hmac_uuid5", "q", '.decl q(p: int64, a: string, c: string, u: string)\nq(P, sha1(N), hmac_sha256(N, "key"), uuid5("example.org", N)) :- part(P, N, _, _, _, _).',
    f"select distinct p_partkey as p, sha1(p_name) as a, {_hmac_sql('p_name', b'key')} as c, {_uuid5_sql('p_name', uuid.uuid5(uuid.NAMESPACE_DNS, 'example.org'))} as u from part",
)
add("sha512_hash", "q", ".decl q(p: int64, b: string)\nq(P, sha512(N)) :- part(P, N, _, _, _, _).", None)
add("xxh3_hash", "q", ".decl q(p: int64, h: int64)\nq(P, hash(P)) :- part(P, _, _, _, _, _).", _xxh3_sql("select distinct p_partkey as p from part", "p"))
add("to_number_of_anything", "q", ".decl q(t: string, n: int64)\nq(T, to_number(T)) :- part(_, _, B, _, _, _), T = str_replace(B, \"Brand#\", \" -\").", "select distinct replace(p_brand, 'Brand#', ' -') as t, coalesce(try_cast(regexp_extract(replace(p_brand, 'Brand#', ' -'), '^[ ]*([+-]?[0-9]+)', 1) as bigint), 0) as n from part")


# --- sessions and signed relations

REACH = ".decl edge(a: int64, b: int64)\n.decl reach(a: int64, b: int64)\nreach(A, B) :- edge(A, B).\nreach(A, C) :- reach(A, B), edge(B, C)."


def _session(spark: SparkSession, sf_dir: str) -> tuple[Session, DataFrame, DataFrame]:
    edges = chain(spark, sf_dir)
    early, late = edges.filter("b % 10 != 0"), edges.filter("b % 10 = 0")
    s = Session(spark, REACH)
    s.insert("edge", early)
    s.step_frame()
    return s, early, late


def session_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges come in two epochs: the state is that of all."""
    s, _, late = _session(spark, sf_dir)
    s.insert("edge", late)
    s.step_frame()
    return s.state["reach"]


def session_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to events of 10, 20, ... go: the state is that of the others."""
    s = Session(spark, REACH)
    edges = chain(spark, sf_dir)
    s.insert("edge", edges)
    s.step_frame()
    s.remove("edge", edges.filter("b % 10 = 0"))
    s.step_frame()
    return s.state["reach"]


def _one_edge(spark: SparkSession, sf_dir: str) -> tuple[Session, tuple[int, int]]:
    """A session over all edges, and one edge between the ends of two chains; of the step that follows, bench.py takes the time."""
    edges = chain(spark, sf_dir)
    s = Session(spark, REACH)
    s.insert("edge", edges)
    s.step_frame()
    (row,) = edges.agg(F.max("b"), F.min("a")).collect()
    return s, tuple(row)


def session_insert_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge from the greatest event that has a predecessor to the least that has a successor: what that adds."""
    s, edge = _one_edge(spark, sf_dir)
    s.insert("edge", edge)
    return s.step_frame()["reach"].withColumnRenamed(signed.DIFF, "diff")


def session_retract_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same edge comes and goes, and another one goes with it: what that takes away."""
    s, edge = _one_edge(spark, sf_dir)
    s.insert("edge", edge)
    s.step_frame()
    s.remove("edge", edge)
    return s.step_frame()["reach"].withColumnRenamed(signed.DIFF, "diff")


def session_net_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes and goes within a step isn't a change, nor is a second copy or the removal of what isn't there."""
    s, early, late = _session(spark, sf_dir)
    s.insert("edge", late)
    s.remove("edge", late)
    s.insert("edge", early.filter("b % 7 = 0"))
    s.remove("edge", spark.createDataFrame([(-1, -2)], "a long, b long"))
    out = s.step_frame()
    return out["reach"].drop(signed.DIFF) if "reach" in out else spark.createDataFrame([], "a long, b long")


def session_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending changes are evaluated before a snapshot is taken."""
    s, early, _ = _session(spark, sf_dir)
    s.remove("edge", early.filter("b % 7 = 0"))
    return s.snapshot("reach")


def delta_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second epoch adds and takes away."""
    s, early, late = _session(spark, sf_dir)
    s.insert("edge", late)
    s.remove("edge", early.filter("b % 7 = 0"))
    return s.step_frame()["reach"].withColumnRenamed(signed.DIFF, "diff")


def _reach_sql(name: str, where: str) -> str:
    return f"{name}_e as (select a, b from edge where {where}), {name} as (select a, b from {name}_e union select {name}.a, {name}_e.b from {name} join {name}_e on {name}.b = {name}_e.a)"


QUERIES |= {f.__name__: f for f in (session_insert, session_retract, session_insert_one, session_retract_one, session_net_zero, session_snapshot, delta_output)}
ORACLE["session_snapshot"] = f"with recursive {CHAIN_SQL}, {_reach_sql('r', 'b % 10 <> 0 and b % 7 <> 0')} select a, b from r"
ORACLE["session_net_zero"] = "select 1::bigint as a, 1::bigint as b where false"
ONE_SQL = f"{CHAIN_SQL}, top as (select max(b) as x, min(a) as y from edge), up as (select x as k from top union select a from up join edge on b = k), down as (select y as k from top union select b from down join edge on a = k)"
ORACLE["session_insert_one"] = f"with recursive {ONE_SQL} select up.k as a, down.k as b, 1::bigint as diff from up, down"
ORACLE["session_retract_one"] = f"with recursive {ONE_SQL} select up.k as a, down.k as b, -1::bigint as diff from up, down"
ORACLE["session_insert"] = TC_SQL
ORACLE["session_retract"] = f"with recursive {CHAIN_SQL}, {_reach_sql('r', 'b % 10 <> 0')} select a, b from r"
ORACLE["delta_output"] = f"with recursive {CHAIN_SQL}, {_reach_sql('o', 'b % 10 <> 0')}, {_reach_sql('n', 'b % 7 <> 0 or b % 10 = 0')} select a, b, 1::bigint as diff from (select a, b from n except select a, b from o) union all select a, b, -1::bigint from (select a, b from o except select a, b from n)"


def weighted_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order counts by customer, as signed changes from low to high priority."""
    o = orders(spark, sf_dir)
    now, before = o.filter("o_orderpriority < '3'").select("o_custkey"), o.filter("o_orderpriority >= '3'").select("o_custkey")
    return signed.delta(now, before).withColumnRenamed(signed.DIFF, "diff")


def weighted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers times suppliers by nation: multiplicities multiply."""
    left = signed.consolidate(signed.with_diff(customer(spark, sf_dir).select(F.col("c_nationkey").alias("n"))))
    right = signed.consolidate(signed.with_diff(supplier(spark, sf_dir).select(F.col("s_nationkey").alias("n"))))
    return signed.join_weighted(left, right, ["n"]).withColumnRenamed(signed.DIFF, "diff")


def weighted_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signed.count_weighted(signed.delta(orders(spark, sf_dir).select("o_custkey"), customer(spark, sf_dir).select(F.col("c_custkey").alias("o_custkey"))))


def multiway_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, customers and suppliers, placed by nation once: the joins don't shuffle again."""
    parts = [df.withColumnRenamed(df.columns[0], "n") for df in (nation(spark, sf_dir).select("n_nationkey"), customer(spark, sf_dir).select("c_nationkey", "c_custkey"), supplier(spark, sf_dir).select("s_nationkey", "s_suppkey"))]
    return signed.multiway_join(parts, "n", 8).toDF("n", "c", "s")


def exchange_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of a customer are in one partition."""
    placed = signed.exchange(orders(spark, sf_dir).select("o_custkey"), 8, "o_custkey").withColumn("p", F.spark_partition_id())
    return placed.groupBy("o_custkey").agg(F.countDistinct("p").alias("places"), F.count(F.lit(1)).alias("n"))


QUERIES |= {"weighted_delta": weighted_delta, "weighted_join": weighted_join, "weighted_count": weighted_count, "multiway_placed": multiway_placed, "exchange_by_key": exchange_by_key}
ORACLE["multiway_placed"] = "select n_nationkey::bigint as n, c_custkey as c, s_suppkey as s from nation join customer on c_nationkey = n_nationkey join supplier on s_nationkey = n_nationkey"
ORACLE["exchange_by_key"] = "select o_custkey, 1::bigint as places, count(*) as n from orders group by 1"
ORACLE["weighted_delta"] = "select * from (select o_custkey, cast(sum(case when o_orderpriority < '3' then 1 else -1 end) as bigint) as diff from orders group by 1) where diff <> 0"
ORACLE["weighted_join"] = "select c.n, c.k * s.k as diff from (select c_nationkey::bigint as n, count(*) as k from customer group by 1) c join (select s_nationkey::bigint as n, count(*) as k from supplier group by 1) s on c.n = s.n"
ORACLE["weighted_count"] = "select (select count(*) from orders) - (select count(*) from customer) as count"


# --- adapters, sinks, tooling


def _through(adapter: str, write: Callable[[DataFrame, str], None], spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written by Spark and read by an adapter."""
    folder = f"{work_dir(spark, 'queries')}/supplier.{adapter}"
    write(supplier(spark, sf_dir).select("s_suppkey", "s_name", "s_nationkey"), folder)
    text = f'.decl s(k: int64, name: string, n: int64)\n.input s(io="{adapter}", filename="{folder}", delimiter=",")\n.decl q(k: int64, name: string, n: int64)\nq(K, N, R) :- s(K, N, R), R > 3.'
    return Engine(spark, text).relation("q")


def text_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_dir(spark, 'queries')}/names"
    nation(spark, sf_dir).select("n_name").write.text(folder)
    return Engine(spark, f'.decl l(t: string)\n.input l(io="text", filename="{folder}")\n.decl q(t: string, n: int64)\nq(T, strlen(T)) :- l(T).').relation("q")


def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What .output writes, read again."""
    path = f"{work_dir(spark, 'queries')}/out.csv".removeprefix("file://")
    program, inputs = inputs_of(spark, sf_dir, f'.decl q(k: int64, name: string)\n.output q(filename="{path}", delimiter="|")\nq(K, N) :- nation(K, N, _), K > 4.')
    Engine(spark, program, inputs).write_outputs()
    return spark.read.option("sep", "|").schema("k long, name string").csv(path)


def printed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, ".printsize big\n.printsize all\n.decl big(c: int64)\n.decl all(c: int64)\nbig(C) :- customer(C, _, B, _), B > 500000.\nall(C) :- customer(C, _, _, _).")
    return spark.createDataFrame(sorted(e.sizes().items()), "rel string, n long")


def own_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """register_function: a scalar function of the user's."""
    register_function("clamp100", ("int",), "int", lambda c: F.least(c, F.lit(100).cast("long")))
    return engine(spark, sf_dir, ".decl q(p: int64, v: int64)\nq(P, clamp100(P)) :- part(P, _, _, _, _, _).").relation("q")


_SUPPLIER_SQL = "select s_suppkey as k, s_name as name, s_nationkey::bigint as n from supplier where s_nationkey > 3"
for _io, _write in (("csv", lambda df, p: df.write.option("sep", ",").csv(p)), ("parquet", lambda df, p: df.toDF("k", "name", "n").write.parquet(p)), ("json", lambda df, p: df.toDF("k", "name", "n").write.json(p))):
    QUERIES[f"{_io}_adapter"] = partial(_through, _io, _write)
    ORACLE[f"{_io}_adapter"] = _SUPPLIER_SQL
QUERIES |= {f.__name__: f for f in (text_adapter, csv_sink, printed_sizes, own_function)}
ORACLE["text_adapter"] = "select n_name as t, length(n_name)::bigint as n from nation"
ORACLE["csv_sink"] = "select n_nationkey::bigint as k, n_name as name from nation where n_nationkey > 4"
ORACLE["printed_sizes"] = f"select 'all' as rel, count(*) as n from customer union all select 'big', count(*) from customer where {CENTS.format('c_acctbal')} > 500000"
ORACLE["own_function"] = "select p_partkey as p, least(p_partkey, 100) as v from part"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that reaches everything along consecutive events."""
    return QUERIES["tc_linear"](spark, sf_dir)
