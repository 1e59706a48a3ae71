"""Every registered query against its DuckDB twin (the driver's gate), at sf0.01,
plus the entry smoke check at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_ORACLE

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_ORACLE}/{t}.parquet')")
    return c


def _canon(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (3, str(v))
    if isinstance(v, (int, float)):
        return (1, "nan") if v != v else (2, repr(float(v)))
    return (5, str(v))


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_canon(r[i]) for i in order) for r in recs)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns == ["Actor1Code", "tone", "is_same", "n",
                                              "avg_scale", "var_scale", "sd_scale"]


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF_ORACLE)
    res = con.sql(entry.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(res.columns)
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(res.columns, res.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_rows_only_queries_run(spark, name):
    from conftest import SF_SMALL
    assert entry.queries()[name](spark, SF_SMALL).count() > 0


def test_model_queries_take_the_whole_table(spark, monkeypatch):
    from conftest import SF_SMALL
    from evstat.plans import modeling
    keys = [r[0] for r in spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select("l_orderkey").collect()]
    held = sum(k % 10 == 0 for k in keys)
    seen = {}

    def spy(module, name, at):
        real = getattr(module, name)

        def run(*args, **more):
            seen[name] = args[at].count()
            return real(*args, **more)
        monkeypatch.setattr(module, name, run)

    spy(modeling.models, "fit_pipeline", 1)
    spy(modeling.models, "score", 1)
    spy(modeling.gram, "search", 0)
    modeling.model_roundtrip(spark, SF_SMALL).count()
    assert modeling.cv_grid(spark, SF_SMALL).count() == 72
    assert seen == {"fit_pipeline": len(keys) - held, "score": held, "search": len(keys) - held}
