"""Registered queries fit the operators' own sizes, and oil prices reach as far as the orders."""

import inspect

import pytest

from shelfcast.operators import forecast as M
from shelfcast.plans import models, profiling, registry, studies
from shelfcast.sources import roles


class Stop(Exception):
    pass


@pytest.mark.parametrize(
    "query, name, want",
    [
        (models.j16, "hybrid_fit", {"rounds": 100, "depth": 6}),
        (models.j18, "tabular_boosted", {"rounds": 300, "depth": 9}),
        (studies.q12_boosted, "tabular_boosted", {"rounds": 300, "depth": 9}),
        (models.k7_boosted, "cv_boosted", {"rounds": 100, "depth": 6, "k": 10}),
    ],
)
def test_registered_models_are_of_full_size(spark, sf_dir, monkeypatch, query, name, want):
    sign = inspect.signature(getattr(M, name))

    def told(*args, **kwargs):
        bound = sign.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Stop({k: bound.arguments[k] for k in want})

    monkeypatch.setattr(M, name, told)
    with pytest.raises(Stop) as e:
        query(spark, sf_dir)
    assert e.value.args[0] == want


def test_registered_band_draws_as_often_as_the_operator(spark, sf_dir, monkeypatch):
    sign = inspect.signature(profiling.S.mean_ci)

    def told(*args, **kwargs):
        bound = sign.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Stop(bound.arguments["reps"])

    monkeypatch.setattr(profiling.S, "mean_ci", told)
    with pytest.raises(Stop, match="1000"):
        profiling.d22(spark, sf_dir)


def test_oil_reaches_late_orders(spark, tmp_path):
    rows = [("2003-03-04", 1000.0), ("1995-02-01", 2000.0)]
    spark.createDataFrame(rows, "o_orderdate string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {str(r["date"]): r["dcoilwtico"] for r in roles.oil(spark, str(tmp_path)).collect()}
    assert got["2003-03-04"] == 1.0 and got["1995-02-01"] == 2.0


def test_oil_and_its_sql_agree_on_late_orders(spark, tmp_path):
    import duckdb

    rows = [("2003-03-04 10:00:00", 1000.0), ("1995-02-01 00:00:00", 2000.0), ("1994-12-30 00:00:00", 500.0)]
    orders = spark.createDataFrame(rows, "d string, o_totalprice double")
    orders.selectExpr("cast(d as timestamp_ntz) o_orderdate", "o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    sql = registry._EXACT_MEAN.sub(registry._exact_mean_sql, roles.with_roles("SELECT * FROM oil"))
    want = {str(r[0]): r[1] for r in con.execute(sql).fetchall()}
    got = {str(r["date"]): r["dcoilwtico"] for r in roles.oil(spark, str(tmp_path)).collect()}
    assert got == want and "2003-03-04" in got and "1994-12-30" in got
