"""Every registered query of the format library against its SQL, over whole tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from siftwell.plans import registry


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def lines(frame: pd.DataFrame) -> list[str]:
    def show(x) -> str:
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted("|".join(map(show, row)) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(name, spark, sf_dir, tables):
    found, wanted = registry.QUERIES[name](spark, sf_dir).toPandas(), tables.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert lines(found) == lines(wanted)


def test_wild_documents_give_rows(spark, sf_dir):
    rows = registry.logfmt_wild_documents(spark, sf_dir).toPandas()
    assert len(rows) == registry.table(spark, sf_dir, "documents").count()
    assert (rows["ok"] == rows["error"].isna()).all()


def test_entry_and_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
