"""Every registered query of the engine against its SQL on a second engine."""

import os

import duckdb
import pandas as pd
import pytest

from tokenweft.plans.catalogue import QUERIES, SQL


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return con


def sorted_frame(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return df.map(lambda x: round(float(x), 5) + 0.0 if isinstance(x, int | float) and not isinstance(x, bool) else x).astype(str).sort_values(sorted(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf_dir, sql, name):
    got, want = sorted_frame(QUERIES[name](spark, sf_dir).toPandas()), sorted_frame(sql.execute(SQL[name]).df())
    pd.testing.assert_frame_equal(got, want)
    assert len(got)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_works_without_the_training_data_part(spark, monkeypatch):
    import importlib

    import __spark_entry__

    real = importlib.import_module

    def gone(name, *a):
        if name.startswith(("tokenweft.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name=name)
        return real(name, *a)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", gone)
    assert set(__spark_entry__.queries()) == set(QUERIES) and set(__spark_entry__.oracle_sql()) == set(SQL)
    assert __spark_entry__.entry(spark).columns == ["query_id", "rank", "doc_id", "score"]
