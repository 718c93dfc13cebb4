"""Every query of the reference's operators against its SQL, over the smallest tables."""

import duckdb
import pandas as pd
import pytest

from lodestrata.plans import binding_queries, callgraph_queries, cmake_queries, finding_queries, lexer_queries, parser_queries, scan_queries, version_queries  # noqa: F401
from lodestrata.plans.driver_queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(frame, columns):
    value = lambda x: None if pd.api.types.is_scalar(x) and pd.isna(x) else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(repr([value(x) for x in row]) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got, sorted(got.columns)) == canonical(want, sorted(got.columns))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5 and set(entry.oracle_sql()) <= set(entry.queries())
