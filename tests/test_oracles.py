"""Every registered catalog query against its SQL twin."""

import pandas as pd
import pytest

from shelfspark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df):
    df = df[sorted(df.columns)]
    tidy = lambda x: x if isinstance(x, (bool, str)) else None if pd.isna(x) else round(float(x), 9)
    return sorted(repr([tidy(x.item() if hasattr(x, "item") else x) for x in row]) for row in df.itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    ours, theirs = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs)


def test_signature_is_one_row(spark, sf_dir):
    a, b = (registry.QUERIES["q4_signature"](spark, sf_dir).collect() for _ in range(2))
    assert len(a) == 1 and a == b


def test_entry_module_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.QUERIES) <= set(e.queries())
