"""Each query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from cloakframe.plans.queries import ORACLE_SQL, QUERIES


def rows(df):
    plain = lambda x: None if x is None or x is pd.NA or x != x else round(x, 9) if isinstance(x, float) else x.item() if hasattr(x, "item") else x
    return sorted(str([float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in map(plain, r)]) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "conversations", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLE_SQL:
        want = con.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())


def test_jw_pairs_reads_all_customers(spark, sf_dir):
    from cloakframe.functions.similarity import jaro_winkler
    from cloakframe.plans.queries import jw_pairs

    names = {r.c_custkey: r.c_name for r in spark.read.parquet(f"{sf_dir}/customer.parquet").collect()}
    got = {r.c_custkey: (r.c_name, r.other, r.score) for r in jw_pairs(spark, sf_dir).collect()}
    assert got == {k: (v, names[k + 1], jaro_winkler(v, names[k + 1])) for k, v in names.items() if k + 1 in names}
