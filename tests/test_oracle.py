"""Every query with SQL against DuckDB on the smallest tables, where they are at hand; all others run."""

import os
from collections import Counter

import pytest

import __spark_entry__

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
Q, S = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{D}/{f}'")
    return con


def rows(found):
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(S))
def test_equals_sql(spark, duck, name):
    df = Q[name](spark, D)
    cols = sorted(df.columns)
    want = duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({S[name]}) q")
    assert sorted(want.columns) == cols
    assert rows(tuple(r) for r in df.select(*cols).collect()) == rows(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q) - set(S)))
def test_others_run(spark, name):
    assert Q[name](spark, D).count() > 0


def test_stanzas_parsed_again_are_those_of_the_archive(spark):
    """Where the archive has a directive that isn't garbled away, parsing its text gives the same directive and object."""
    archive = {r["stanza_id"]: r for r in spark.read.parquet(f"{D}/ujo_jil_stanza.parquet").where("directive is not null").select("stanza_id", "directive", "object_name").collect()}
    parsed = {}
    for r in Q["stanza_parse"](spark, D).collect():
        parsed.setdefault(r["stanza_id"], []).append((r["directive"], r["object_name"]))
    same = sum((a["directive"], a["object_name"]) in parsed.get(i, ()) for i, a in archive.items())
    assert same >= 0.98 * len(archive)


def test_all_sql_belongs_to_queries():
    assert set(S) <= set(Q)
