"""Every registered query against its SQL on the smallest tables, where these are there."""

import os

import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def queries():
    from loomspan.plans.registry import QUERIES

    return sorted(QUERIES)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows_of(frame):
    def plain(v):
        if pd.isna(v):
            return "~"
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", queries())
def test_query_equals_its_sql(spark, duck, name):
    from loomspan.plans.registry import QUERIES, SQL

    got = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        assert rows_of(got) == rows_of(duck.execute(SQL[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_boosted_trees_learn_their_labels(spark):
    from loomspan.plans.registry import QUERIES

    rows = QUERIES["gbt_classify"](spark, DATA).toPandas()
    apart = rows[rows["chain_id"] % 5 == 0]
    assert ((apart["p"] >= 0.5) == (apart["y"] == 1)).mean() > 0.95 and 0.1 < apart["y"].mean() < 0.9


def test_training_rows_have_both_labels(spark):
    from loomspan.plans.registry import QUERIES

    assert set(QUERIES["training_rows"](spark, DATA).toPandas()["y"]) == {0, 1}
