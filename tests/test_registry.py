"""Every registered query of the workflow-history operators against its DuckDB SQL at the smallest size."""

import os

import duckdb
import pandas as pd
import pytest

from flowsift.jobs import registry

DIR = "/root/testdata/sf0.001"
FAST = list(registry.oracle_sql())


def canon(df):
    df = df[sorted(df.columns)].astype(object)
    plain = lambda x: None if pd.isna(x) else int(x) if isinstance(x, float) and x.is_integer() else x
    return sorted(str(tuple(map(plain, r))) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in os.listdir(DIR):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_same_rows(spark, duck, name):
    ours, theirs = registry.queries()[name](spark, DIR).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canon(ours) == canon(theirs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
