"""Orders per day and store: the rows, and that what a task gets is bounded."""

import re

from shelfcast.sources import roles


def _write(spark, folder, orders, lines):
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate string").selectExpr(
        "o_orderkey", "cast(o_orderdate as timestamp) o_orderdate"
    ).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(f"{folder}/lineitem.parquet")


def test_repeated_and_missing_keys_count_once(spark, tmp_path):
    orders = [(1, "2000-01-01"), (1, "2000-01-01"), (1, "2000-01-02"), (2, "2000-01-01"), (None, "2000-01-01"), (3, None)]
    lines = [(1, 7), (1, 7), (1, 8), (2, 7), (2, None), (None, 7), (3, 7), (4, 7)]
    _write(spark, tmp_path, orders, lines)
    got = {(str(r["date"]), r["store_nbr"]): r["transactions"] for r in roles.transactions(spark, str(tmp_path)).collect()}
    want = {("2000-01-01", 7): 2, ("2000-01-01", 8): 1, ("2000-01-02", 7): 1, ("2000-01-02", 8): 1}
    assert got == want | {("2000-01-01", None): 1, ("None", 7): 1}


def test_tasks_grow_with_the_lines(spark, tmp_path, monkeypatch):
    """What a task sorts and holds is a fixed number of lines, whatever size adaptive execution aims at."""
    _write(spark, tmp_path, [(i, "2000-01-01") for i in range(200)], [(i // 3, i % 5) for i in range(600)])
    monkeypatch.setattr(roles, "LINES_PER_TASK", 25)
    made = roles.transactions(spark, str(tmp_path))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\([lo]_orderkey#\d+L, (\d+)\), REPARTITION_BY_NUM", plan)) == {"24"}
    assert not re.search(r"hashpartitioning\([lo]_orderkey#\d+L, \d+\), ENSURE", plan)
    assert made.agg({"transactions": "sum"}).first()[0] == len({(i // 3, i % 5) for i in range(600)})
