"""Each registered query against its DuckDB equivalent, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from brackwater.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return db


def normal(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted((tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v if v is None else str(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    got, want = registry.queries()[name](spark, DIR).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
    assert len(want) > 0 or name == "q_rapid"  # the smallest table has no two events within a second


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows(spark, name):
    assert registry.queries()[name](spark, DIR).count() > 0
