"""Sums in slices, fills at live prices, bars up to now, marks of rows without a symbol."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import asof, backtest, bars, prefix


@pytest.mark.parametrize("width", [1, 7, 10**9])
def test_running_sums(spark, width):
    r = random.Random(width)
    rows = [(r.choice(["a", "b", None]), r.choice([None, r.randrange(60)]) if i % 9 == 0 else r.randrange(60), i, float(r.randrange(9)) if i % 8 else None, i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t long, n long, x double, _of long").repartition(4)
    got = prefix.running_sums(df, ["k"], "t", ["t", "n"], {"s": F.col("x"), "c": F.lit(1)}, width)
    assert got.columns == ["k", "t", "n", "x", "_of", "s", "c"]
    want = {}
    for k in ("a", "b", None):
        s = 0.0
        for c, (_, _, n, x, _) in enumerate(sorted((x for x in rows if x[0] == k), key=lambda x: (x[1] is not None, x[1] or 0, x[2])), 1):
            s += x or 0
            want[n] = s, c
    assert {x.n: (x.s, x.c) for x in got.collect()} == want


def test_ledger_of_one_busy_run(spark):
    """A run's fills are spread over slices, and come to the same as one sum."""
    n = 100_000
    fills = spark.range(n).select(F.lit(1).alias("run_id"), (F.col("id") * 1000).alias("ts_ms"), F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "BUY").otherwise("SELL").alias("side"), F.lit(2.0).alias("qty"),
                                  F.lit(4.0).alias("exec_price"), F.lit(0.5).alias("commission"))
    got = {r.seq: r.cash for r in backtest.cash_ledger(fills, 100.0, ["ts_ms", "seq"], 1_000_000).filter("seq % 999 = 0").collect()}
    assert all(cash == 100 + 7.5 * (i + 1 - (i // 3 + 1)) - 8.5 * (i // 3 + 1) for i, cash in got.items()) and len(got) == 101


def test_live_fills(spark):
    orders = [("A", 10, "BUY", 1000.0, 9.0, None, 1), ("A", 5, "sell", 1000.0, 9.0, "NEW", 2), ("B", 10, "buy", 10.0, 7.0, None, 3), ("B", 10, "BUY", 10.0, 0.0, None, 4), ("A", 10, "BUY", 1.0, 9.0, "CANCELLED", 5),
              (None, 10, "SELL", 10.0, 2.0, None, 6), ("B", 10, "BUY", 10.0, None, None, 7), ("C", 10, "BUY", 1.0, 3.0, None, 8)]
    own = spark.createDataFrame(orders, "symbol string, ts_ms long, side string, qty double, price double, status string, id long")
    b = spark.createDataFrame([("A", 5, 100.0), ("A", 10, 110.0), ("A", 11, 1.0), (None, 1, 55.0), ("C", 1, -1.0)], "symbol string, bar_start long, close double")
    got = {r.id: (r.exec_price, r.commission) for r in backtest.live_fill_costs(own, b).collect()}
    assert got.keys() == {1, 2, 3, 6}
    assert got[1] == pytest.approx((110 * 1.001, 110 * 1.001 * 0.1)) and got[2][0] == pytest.approx(100 * 0.999) and got[3][0] == pytest.approx(7 * 1.00001) and got[6][0] == pytest.approx(2 * 0.99999)


def test_fill_to_now(spark):
    b = spark.createDataFrame([(s, t, c, c, c, c, 1.0) for s, t, c in [("A", 0, 1.0), ("A", 10, 2.0), ("B", 40, 3.0), ("C", 30, 4.0), ("D", -70, 5.0)]], "symbol string, bar_start long, open double, high double, low double, close double, volume double")
    got = sorted((r.symbol, r.bar_start, r.close) for r in bars.fill_to_now(b, 10, 59, max_gap=100, most=3).filter("filled").collect())
    assert got == [("A", 20, 2.0), ("A", 30, 2.0), ("A", 40, 2.0), ("C", 40, 4.0)]
    assert bars.fill_to_now(b.limit(0), 10, 59).count() == 0


def test_rows_without_a_symbol_have_no_mark(spark):
    schema = "symbol string, at long"
    for width in (1, 1000):
        got = asof.nearest(spark.createDataFrame([(None, 5), ("A", 5)], schema), spark.createDataFrame([(None, 3), ("A", 4)], schema), slice_ms=width).collect()
        assert {r.symbol: r.mark and r.mark["at"] for r in got} == {None: None, "A": 4}
