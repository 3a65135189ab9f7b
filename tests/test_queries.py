"""Every query against its SQL, on the smallest tables; the entry points."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from rulespan import queries as Q

SF = os.environ.get("RULESPAN_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"session_insert", "session_insert_one", "session_retract_one", "session_snapshot", "session_net_zero", "session_retract", "delta_output", "tc_nonlinear", "cc_min_label"}  # covered by tests of their own


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in Q.ORACLE if n not in SLOW])
def test_query(spark, sql, name):
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    r = sql.execute(Q.ORACLE[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(row[k] for k in at) for row in r.fetchall()), key=repr)


def test_entry_points(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 55
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
