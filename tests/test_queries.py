import duckdb
import pytest

import __spark_entry__ as entry
from premia.plans import catalog
from premia.plans.registry import TABLES

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["perf_summary", "information_ratio", "dsr", "risk_exposures", "loadings_apply", "weight_summary", "spread_ladder", "pbo"]


def test_the_contract_names_agree():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert not set(catalog()) - set(oracles)
    assert entry.queries().keys() == queries.keys()


def test_the_flagship_runs(spark):
    assert entry.entry(spark).count() == 25


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_against_the_oracle(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = sorted((tuple(row) for row in result.fetchall()), key=repr)
    got = sorted((tuple(row) for row in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)
    assert sorted(df.columns) == sorted(names)
    assert got == want
