"""Every registered query of the core against its SQL on the small tables."""

import glob
import os

import duckdb
import pytest

from breakline.oracle import SQL
from breakline.queries import QUERIES


def rows(columns, got):
    keep = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(map(keep, r)) for r in got), key=str)


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = db.sql(f"select {quoted} from ({SQL[name]})").fetchall()
    assert rows(columns, df.select(*[f"`{c}`" for c in columns]).collect()) == rows(columns, want)


def test_all_named():
    assert set(QUERIES) - set(SQL) == {"phase_cluster"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
