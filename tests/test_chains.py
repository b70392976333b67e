"""Rows that depend on the rows before them, in slices of any size, against plain loops."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.operators import chains, folds, orders


def plain_breaker(rows, failures, cooldown):
    state, fails, at, out = "CLOSED", 0, 0, []
    for ts, ok in rows:
        was_open = state == "OPEN"
        if was_open and ts - at <= cooldown:
            out.append(("REFUSED", "OPEN"))
            continue
        fails = 0 if ok else fails + 1
        if not ok and (was_open or fails >= failures):
            state, at = "OPEN", ts
        else:
            state = "CLOSED"
        out.append(("HALF_OPEN" if was_open else "CLOSED", state))
    return out


def plain_line(rows, interval):
    anchor, out = None, {}
    for ts, price in rows:
        if anchor is None or ts - anchor >= interval:
            anchor = ts
        out[anchor] = price
    return out


def keyed(seed, n=120):
    """Rows of three keys, one of them null, the second with times that go back."""
    r = random.Random(seed)
    times = {"a": sorted(r.randrange(400) for _ in range(n)), "b": [r.randrange(400) for _ in range(n)], None: [i // 3 * 5 for i in range(n)]}
    return {k: [(t, r.random() < 0.4, float(i)) for i, t in enumerate(ts)] for k, ts in times.items()}


@pytest.mark.parametrize("slice_rows", [1, 7, 10**6])
@pytest.mark.parametrize("failures,cooldown", [(1, 0), (2, 9), (3, 40)])
def test_breaker_in_slices(spark, slice_rows, failures, cooldown):
    keys = keyed(failures)
    log = [(k, i, t, None if not ok and i % 2 else ok) for k, rows in keys.items() for i, (t, ok, _) in enumerate(rows)]
    df = spark.createDataFrame([*log, ("a", 999, None, True)], "node string, seq long, ts_ms long, ok boolean").repartition(3)
    got = {(x.node, x.seq): (x.attempt, x.state) for x in chains.breaker(df, failures, cooldown, slice_rows).collect()}
    assert got == {(k, i): s for k, rows in keys.items() for i, s in enumerate(plain_breaker([x[:2] for x in rows], failures, cooldown))}


@pytest.mark.parametrize("slice_rows", [1, 7, 10**6])
@pytest.mark.parametrize("interval", [1, 30])
def test_line_in_slices(spark, slice_rows, interval):
    keys = keyed(interval)
    ticks = [(k, p, 1.0, t, i, "") for k, rows in keys.items() for i, (t, _, p) in enumerate(rows)]
    df = spark.createDataFrame([*ticks, ("a", 5.0, 1.0, None, 998, ""), ("a", 5.0, 1.0, 5, None, "")], "symbol string, price double, size double, ts_ms long, seq long, slice string").repartition(3)
    got = [((x.symbol, x.time), x.value) for x in chains.anchored_line(df, interval, slice_rows).collect()]
    want = {(k, t): p for k, rows in keys.items() for t, p in plain_line([(t, p) for t, _, p in rows], interval).items()}
    assert dict(got) == want and len(got) == len(want)


def test_slices_are_tasks(spark):
    """One key's rows are spread over many tasks, and the tables handed on are short."""
    rows = spark.range(20_000).select(F.lit("x").alias("symbol"), F.col("id").alias("seq"), (F.col("id") * 10).alias("ts_ms"), F.col("id").cast("double").alias("price"))
    got = {r.time: r.value for r in chains.anchored_line(rows, 1000, 512).collect()}
    assert got == {t: min(t // 10 + 99, 19_999) for t in range(0, 200_000, 1000)}
    ok = np.arange(512) % 7 > 3
    table = chains.Breaker(pa.table({"ts_ms": np.arange(512) * 10 + 10**6, "ok": ok}), 2, 100).table(10**6 - 10)
    assert len(table[0]) == 2 and len(table[1]) < 20


@pytest.mark.parametrize("short", [0, 3, 64])
def test_fits(monkeypatch, short):
    monkeypatch.setattr(folds, "SHORT", short)
    monkeypatch.setattr(folds, "CHUNK", 8)
    r = random.Random(short)
    for _ in range(200):
        sizes = [r.randrange(1, 30) for _ in range(r.randrange(1, 6))]
        value = [r.choice([r.random() * 10, 0.0, -1.0, float("nan"), 99.0]) for _ in range(sum(sizes))]
        first, left = np.cumsum([0, *sizes[:-1]]), [r.random() * 40 for _ in sizes]
        want, rests = [], list(left)
        for k, n in enumerate(sizes):
            for v in value[first[k]:first[k] + n]:
                want.append(v <= rests[k])
                rests[k] -= v if v <= rests[k] else 0
        got, now = folds.fits(np.array(value), first, np.array(left))
        assert got.tolist() == want and now.tolist() == rests


def test_one_busy_account(spark):
    """A million orders of one account, beside small ones; batches are smaller than the account."""
    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias("order_id"), F.when(F.col("id") % 1000 == 0, F.col("id")).otherwise(-1).alias("account_id"), F.col("id").alias("seq"), F.lit("S").alias("symbol"),
                               (1 + F.col("id") * 7919 % 97).cast("double").alias("value"), F.lit(1e6).alias("margin"))
    began = time.time()
    got = {r.decision: (r.n, r.v) for r in orders.risk_decisions(df, 1e9, keep=("value",)).filter("account_id = -1").groupBy("decision").agg(F.count("*").alias("n"), F.sum("value").alias("v")).collect()}
    took = time.time() - began
    rest, used = 1e6, 0
    for i in range(n):
        if i % 1000:
            v = float(1 + i * 7919 % 97)
            if v <= rest:
                rest, used = rest - v, used + 1
    assert got["APPROVED"] == (used, 1e6 - rest) and sum(x for x, _ in got.values()) == n - n // 1000 and took < 60


def test_odd_orders(spark):
    rows = [(1, 1, 1, None, 5.0, None), (2, 1, 2, "S", 0.0, 9.0), (3, None, 1, "S", 5.0, 7.0), (4, None, 2, "S", 3.0, None), (5, None, 3, "B", 1.0, None), (6, None, 4, "S", None, 1.0), (7, 2, 1, "S", 60.0, 99.0)]
    df = spark.createDataFrame(rows, "order_id long, account_id long, seq long, symbol string, value double, margin double")
    got = {r.order_id: r.decision for r in orders.risk_decisions(df, 50.0, ["B"]).collect()}
    assert got == {1: "INSUFFICIENT_MARGIN", 2: "APPROVED", 3: "APPROVED", 4: "INSUFFICIENT_MARGIN", 5: "BLACKLISTED", 6: "INVALID_ARGUMENTS", 7: "EXCEEDS_MAX_CAP"}
    assert orders.risk_decisions(df.limit(0), 50.0).count() == 0
