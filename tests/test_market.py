"""Market operators against plain computations over inputs made here, and queries against their SQL."""

import math
import os
import random
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from tickloom.functions import calendar as cal
from tickloom.operators import asof, backtest, bars, chains, features, orders, stats
from tickloom.plans import queries as plans
from tickloom.sources import ingest, sinks
from tickloom.streaming.bars import stream_bars, stream_bars_watermark

SF = "/root/testdata/sf0.001"
TICK = "symbol string, price double, size double, ts_ms long, seq long"
W, LATE = 1000, 300


def late_ticks(seed=1, n=400):
    """Ticks of two symbols, of which many come late."""
    r, at, out = random.Random(seed), 0, []
    for seq in range(n):
        at += r.randrange(200)
        out.append((r.choice(["OAK", "ELM"]), float(r.randrange(50, 150)), float(r.randrange(1, 9)), max(0, at - r.choice([0, 0, 0, 250, 700, 1500])), seq))
    return out


def plain_bars(ticks):
    """Kind of each tick, and every version of each bar that is sent, by going through the ticks one by one."""
    kinds, sent, state = {}, [], {}
    for s, p, v, t, seq in ticks:
        w, (cur, prev) = t - t % W, state.get(s, (None, None))

        def add(b):
            b.update(high=max(b["high"], p), low=min(b["low"], p), volume=b["volume"] + v)
            if t >= b["last"]:
                b.update(close=p, last=t)

        if cur is None or w > cur["start"]:
            if cur:
                sent.append((s, dict(cur)))
            kinds[seq], prev, cur = "ROLL", cur, dict(start=w, open=p, high=p, low=p, close=p, volume=v, last=t)
        elif w == cur["start"]:
            kinds[seq] = "ON_TIME"
            add(cur)
        elif prev and w == prev["start"] and t >= cur["start"] - LATE:
            kinds[seq] = "LATE_ACCEPTED"
            add(prev)
            sent.append((s, dict(prev)))
        else:
            kinds[seq] = "LATE_DROPPED"
        state[s] = cur, prev
    for s, (cur, _) in state.items():
        sent.append((s, dict(cur)))
    return kinds, sent


OHLCV = ("open", "high", "low", "close", "volume")


@pytest.mark.parametrize("slice_rows", [1, 7, 90, 1 << 20])
def test_late_ticks(spark, slice_rows):
    rows = late_ticks()
    kinds, sent = plain_bars(rows)
    ticks = spark.createDataFrame(rows, TICK).repartition(3)
    assert {r.seq: r.kind for r in bars.audit(ticks, W, LATE, slice_rows).collect()} == kinds and len(set(kinds.values())) == 4
    last = {(s, b["start"]): tuple(b[c] for c in OHLCV) for s, b in sent}
    assert {(r.symbol, r.bar_start): tuple(r[c] for c in OHLCV) for r in bars.live_bars(ticks, W, LATE, slice_rows).collect()} == last


def test_candles_in_slices(spark):
    ticks = spark.createDataFrame(late_ticks(3), TICK)
    rows = lambda n: sorted(tuple(r) for r in bars.live_candles(ticks, W, n).collect())
    assert rows(5) == rows(1 << 20)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_streams_of_bars(spark, tmp_path, rocks):
    """Every version in the order of sending; by watermark once, when it has passed."""
    rows = late_ticks(2)
    spark.createDataFrame(rows, TICK).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(TICK).parquet(f"{tmp_path}/in")
    sent = sinks.drain(stream_bars(source(), W, LATE), f"{tmp_path}/out", f"{tmp_path}/c", "update").collect()
    want = {}
    for s, b in plain_bars(rows)[1]:
        want.setdefault((s, b["start"]), []).append(tuple(b[c] for c in OHLCV))
    for s in ("OAK", "ELM"):
        del want[s, max(t for x, t in want if x == s)]  # the open bar
    got = {}
    for r in sorted(sent, key=lambda r: r.version):
        got.setdefault((r.symbol, r.bar_start), []).append(tuple(r[c] for c in OHLCV))
    assert got == want
    once = sinks.drain(stream_bars_watermark(source(), "1 second", "1 second"), f"{tmp_path}/o2", f"{tmp_path}/c2").collect()
    assert len({(r.symbol, r.bar_start) for r in once}) == len(once) > 0 and max(r.bar_start for r in once) + W <= max(t[3] for t in rows) - 1000


def test_recorder_replays_a_batch(spark, tmp_path):
    """Ticks and bars of one batch; the same batch again overwrites itself, what another checkpoint recorded stays."""
    spark.createDataFrame(late_ticks()[:50], TICK).coalesce(1).write.parquet(f"{tmp_path}/in")
    for n in (1, 2):
        for again in range(2):
            if again:  # as if the stream had stopped before it knew that the batch was done
                for f in os.listdir(f"{tmp_path}/c{n}/stream/commits"):
                    os.remove(f"{tmp_path}/c{n}/stream/commits/{f}")
            s = spark.readStream.schema(TICK).parquet(f"{tmp_path}/in")
            sinks.start_recorder(s, s.filter("seq < 10").select("symbol", "price"), f"{tmp_path}/out", f"{tmp_path}/c{n}", once=True).awaitTermination()
            assert spark.read.parquet(f"{tmp_path}/out/ticks").count() == 50 * n and spark.read.parquet(f"{tmp_path}/out/bars").count() == 10 * n


def test_tables(spark, tmp_path):
    for _ in range(2):
        sinks.create_tables(spark, "loom_test")
    try:
        assert spark.table("loom_test.ticks").columns[-1] == "date" and spark.table("loom_test.bars").count() == 0
    finally:
        spark.sql("DROP DATABASE loom_test CASCADE")


def test_payloads(spark):
    bad = ["", "[", '{"sym"', '[{"p":1}', '{"sym":"","p":3.5,"t":77}', '{"p":8.0,"s":1,"t":77}', '{"sym":"OAK","p":8.0}', None]
    good = ['{"sym":"OAK","p":8.25,"s":3,"t":77}', ' [{"sym":"ELM","t":5},{"sym":"OAK","p":1,"s":2,"t":6}]']
    df = spark.createDataFrame([(x,) for x in [*bad, *good]], "payload string")
    assert sorted(tuple(r) for r in ingest.parse_ticks(df, "payload").collect()) == [("ELM", 0.0, 0.0, 5), ("OAK", 1.0, 2.0, 6), ("OAK", 8.25, 3.0, 77)]
    typed = spark.createDataFrame([('[{"T":"t","S":"ELM","p":4.5,"s":6,"t":"1970-01-01T00:00:02Z"},{"T":"b","S":"ELM"},{"T":"t","S":"OAK","p":1,"s":1,"t":"?"}]',)], "payload string")
    rows = sorted(tuple(r) for r in ingest.parse_ticks_typed(typed, "payload").collect())
    assert rows[0] == ("ELM", 4.5, 6.0, 2000) and rows[1][:3] == ("OAK", 1.0, 1.0) and rows[1][3] > 1_700_000_000_000
    bar = '{"bars":{"OAK":[{"t":"1970-01-01T00:02:00Z","o":1,"h":2,"l":1,"c":2},{"t":"1970-01-01T00:01:00Z","o":3,"h":4,"l":3,"c":4}],"ELM":[]}}'
    listed = spark.createDataFrame([(bar,), ("{}",), (None,)], "payload string")
    for symbol in (None, "OAK"):
        assert [(r.symbol, r.time, r.close) for r in ingest.parse_bars_map(listed, "payload", symbol).collect()] == [("OAK", 60, 4.0), ("OAK", 120, 2.0)]
    assert ingest.parse_bars_map(listed, "payload", "YEW").count() == 0


def test_archive(spark, tmp_path):
    day = 1_600_000_000_000 // 86_400_000 * 86_400_000  # 2020-09-13
    rows = [("OAK", day - 1, 1.0), ("OAK", day, 2.0), ("ELM", day + 86_399_999, 3.0), ("ELM", day + 86_400_000, 4.0)]
    df = spark.createDataFrame([(s, t, c, c, c, c, 10 * c) for s, t, c in rows], "symbol string, timestamp long, open double, high double, low double, close double, volume double")
    for _ in range(2):
        sinks.archive_day(df, "20200913", str(tmp_path / "a"))
    assert sorted((r.symbol, r.volume) for r in ingest.read_bars(spark, str(tmp_path / "a")).collect()) == [("ELM", 30.0), ("OAK", 20.0)]
    with pytest.raises(ValueError):
        sinks.archive_day(df, "13.9.2020", str(tmp_path / "b"))


@pytest.mark.parametrize("slice_ms", [1, 7, 10_000])
def test_asof(spark, slice_ms):
    """With slices of one time, of a few, and one slice for all; ties, symbols without marks, repeated ids."""
    r = random.Random(slice_ms)
    marks = sorted({(r.choice("AB"), r.randrange(60)) for _ in range(25)})
    rows = [(r.choice("ABC"), r.randrange(70), i % 20) for i in range(80)]
    back = asof.asof_backward(spark.createDataFrame(rows, "symbol string, time long, seq long").repartition(3), spark.createDataFrame(marks, "symbol string, time long"), slice_ms)
    own = lambda s: [t for x, t in marks if x == s]
    want = sorted((s, t, i, max([m for m in own(s) if m <= t], default=min(own(s), default=t))) for s, t, i in rows)
    assert sorted(tuple(x) for x in back.select("symbol", "time", "seq", "candle").collect()) == want
    b = spark.createDataFrame([(s, t, float(t)) for s, t in marks], "symbol string, bar_start long, close double")
    ahead = asof.next_bar(spark.createDataFrame(rows, "symbol string, ts_ms long, order_id long"), b, ("close",), slice_ms)
    first = lambda s, t: min((m for m in own(s) if m > t), default=None)
    assert sorted(map(str, ahead.select("symbol", "ts_ms", "order_id", "fill_start").collect())) == sorted(map(str, spark.createDataFrame(
        [(s, t, i, first(s, t)) for s, t, i in rows], "symbol string, ts_ms long, order_id long, fill_start long").collect()))
    assert ahead.filter("close != fill_start").count() == 0
    for df in (back, ahead):
        assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower()


def test_fill_cost(spark):
    b = spark.createDataFrame([("OAK", 200, 80.0, 4000.0), ("OAK", 300, 90.0, 0.0)], "symbol string, bar_start long, close double, volume double")
    o = spark.createDataFrame([("OAK", 1, 50, "BUY", 200.0), ("OAK", 1, 50, "SELL", 40.0), ("OAK", 2, 250, "SELL", 9.0), ("OAK", 3, 300, "BUY", 1.0)], "symbol string, order_id long, ts_ms long, side string, qty double")
    got = sorted((r.order_id, r.side, r.exec_price, r.commission) for r in backtest.fill_costs(o, b).collect())
    want = []
    for i, side, qty, close, volume in [(1, "BUY", 200, 80, 4000), (1, "SELL", 40, 80, 4000), (2, "SELL", 9, 90, 0)]:
        px = close * (1 + (1 if side == "BUY" else -1) * (0.1 * qty / volume if volume else 0))
        want.append((i, side, px, qty * px * 0.0001 + 1))
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(g[2:] == pytest.approx(w[2:], abs=1e-12) for g, w in zip(got, want, strict=True))


def test_metrics(spark):
    r = random.Random(4)
    series = {1: [5000 + 40 * math.sin(i) + r.uniform(-30, 30) for i in range(60)], 2: [100.0, 100.0, 100.0]}
    nav = spark.createDataFrame([(k, i, v) for k, s in series.items() for i, v in enumerate(s)], "run_id long, step long, nav double")
    got = {x.run_id: x for x in backtest.performance_metrics(nav).collect()}
    s = series[1]
    ret = [b / a - 1 for a, b in zip(s, s[1:], strict=False)]
    year, mean = math.sqrt(252 * 390), statistics.fmean(ret)
    down = math.sqrt(sum(min(x, 0) ** 2 for x in ret) / (len(ret) - 1))
    peak = [max(s[:i + 1]) for i in range(len(s))]
    assert (got[1].final_pnl, got[1].sharpe, got[1].sortino, got[1].max_drawdown) == pytest.approx(
        (s[-1] - s[0], mean / statistics.stdev(ret) * year, mean / down * year, max((p - v) / p for p, v in zip(peak, s, strict=True))))
    assert (got[2].sharpe, got[2].sortino, got[2].max_drawdown) == (0, 0, 0)


def test_margin_is_used_by_approved_orders_only(spark):
    r = random.Random(5)
    rows = [(i, r.randrange(3), i, r.choice(["OAK", "BAD"]), r.choice([None, 10.0, 300.0, 70.0, 9000.0]), 1500.0) for i in range(300)]
    left, want = {}, {}
    for i, a, _, s, v, m in rows:
        rest = left.setdefault(a, m)
        want[i] = ("BLACKLISTED" if s == "BAD" else "INVALID_ARGUMENTS" if v is None else "EXCEEDS_MAX_CAP" if v > 5000 else "INSUFFICIENT_MARGIN" if v > rest else "APPROVED")
        if want[i] == "APPROVED":
            left[a] = rest - v
    df = spark.createDataFrame(rows, "order_id long, account_id long, seq long, symbol string, value double, margin double").repartition(5)
    assert {x.order_id: x.decision for x in orders.risk_decisions(df, 5000.0, ["BAD"]).collect()} == want and len(set(want.values())) == 5


def test_folds_of_no_rows(spark):
    assert chains.breaker(spark.createDataFrame([], "node string, seq long, ts_ms long, ok boolean")).count() == 0
    assert chains.anchored_line(spark.createDataFrame([], TICK), 5).count() == 0


def test_breaker(spark):
    r = random.Random(6)
    log = [(r.choice("xy"), i, i * 100, r.random() < 0.45) for i in range(300)]
    want, state = {}, {}
    for n, i, t, ok in log:
        st, fails, at = state.get(n, ("CLOSED", 0, 0))
        if st == "OPEN" and t - at <= 700:
            want[i] = ("REFUSED", "OPEN")
            continue
        probe, fails = st == "OPEN", 0 if ok else fails + 1
        st, at = ("CLOSED", at) if ok or (not probe and fails < 3) else ("OPEN", t)
        want[i], state[n] = ("HALF_OPEN" if probe else "CLOSED", st), (st, fails, at)
    got = chains.breaker(spark.createDataFrame(log, "node string, seq long, ts_ms long, ok boolean").repartition(3), 3, 700)
    assert {x.seq: (x.attempt, x.state) for x in got.collect()} == want and {a for a, _ in want.values()} == {"REFUSED", "HALF_OPEN", "CLOSED"}


def test_blacklist(spark):
    feed = spark.createDataFrame([("ADD:OAK", 1), ("ADD:ELM", 2), ("REMOVE:OAK", 3), ("ADD", 4), ("DROP:ELM", 5), ("REMOVE:YEW", 6), ("ADD:A:B", 7)], "payload string, seq long")
    assert sorted(r.symbol for r in orders.blacklist(feed).collect()) == ["A:B", "ELM"]


def test_validation(spark):
    rows = [("ABCDE", 0.5, 1.0), ("ABCDEF", 1.0, 1.0), ("Ab", 1.0, 1.0), ("A1", 1.0, 0.0), ("A", 0.0, 2.0), (None, None, None), ("", -1.0, -1.0)]
    got = orders.validate_orders(spark.createDataFrame(rows, "symbol string, price double, quantity double")).collect()
    assert [list(r.violations) for r in got] == [[], ["symbol"], ["symbol"], ["symbol", "quantity"], ["price"], ["symbol", "price", "quantity"], ["symbol", "price", "quantity"]]


def test_statuses(spark):
    codes = spark.range(-1, 10).select(F.col("id"), orders.decode_status(F.col("id")).alias("name"))
    got = {r.id: (r.name, r.back) for r in codes.withColumn("back", orders.encode_status(F.col("name"))).collect()}
    assert got[0] == ("UNSPECIFIED", 0) and got[5][0] == "CANCELED" and got[7][0] == "PENDING_CANCEL" and got[8] == got[-1] == (None, None)
    assert all(got[i][1] == i for i in range(8))


def test_calendar(spark):
    days = {str(r.date): r for r in cal.trading_calendar(spark, "2021-01-01", "2031-12-31").collect()}
    named = {d for d, r in days.items() if r.holiday}
    assert {"2021-05-31", "2021-07-05", "2022-06-20", "2021-12-24", "2023-01-02", "2028-02-21", "2030-11-28", "2025-04-18", "2029-03-30", "2031-04-11"} <= named
    assert "2022-01-01" not in named and "2021-12-31" not in named  # a Saturday's New Year is not moved
    assert days["2024-11-29"].early_close and days["2024-07-03"].close_minute == 780 and not days["2021-12-24"].early_close


def test_sessions(spark):
    at = [("2024-07-03 16:59", "REGULAR"), ("2024-07-03 17:00", "EXTENDED"), ("2024-07-04 15:00", "HOLIDAY"), ("2024-07-06 15:00", "WEEKEND"), ("2024-07-08 19:59", "REGULAR"),
          ("2024-07-08 20:00", "EXTENDED"), ("2024-07-09 00:00", "NIGHT"), ("2024-07-08 08:00", "PRE_MARKET"), ("2024-01-08 14:29", "PRE_MARKET"), ("2024-01-08 14:30", "REGULAR")]
    df = spark.createDataFrame(at, "t string, want string").withColumn("ms", F.unix_millis(F.to_timestamp("t")))
    assert df.filter((cal.market_session(F.col("ms")) != F.col("want")) | (cal.market_closed(F.col("ms")) != (F.col("want") != "REGULAR"))).count() == 0


def test_barrier_does_not_look_ahead(spark):
    rows = [("P", 10, 3.0), ("Q", 20, 7.0), ("P", 30, 5.0), ("Q", 40, 8.0)]
    b = spark.createDataFrame([(s, t, c, c, c, c, 1.0) for s, t, c in rows], "symbol string, bar_start long, open double, high double, low double, close double, volume double")
    got = {(r.symbol, r.bar_start): (r.close, r.volume) for r in asof.align(b, b.select("symbol")).collect()}
    assert got == {("P", 10): (3.0, 1.0), ("P", 20): (3.0, 0.0), ("P", 30): (5.0, 1.0), ("P", 40): (5.0, 0.0),
                   ("Q", 10): (1.0, 0.0), ("Q", 20): (7.0, 1.0), ("Q", 30): (7.0, 0.0), ("Q", 40): (8.0, 1.0)}


def test_rsi(spark):
    r = random.Random(9)
    prices = {s: [50 + r.uniform(-9, 9) for _ in range(n)] for s, n in (("A", 60), ("B", 20), ("C", 13), ("D", 14))}
    df = spark.createDataFrame([(s, i, p) for s, ps in prices.items() for i, p in enumerate(ps)], "symbol string, bar_start long, close double")
    for x in features.rsi(df).collect():
        p, want = prices[x.symbol], 50.0
        d = [b - a for a, b in zip(p, p[1:], strict=False)]
        if len(p) >= 14:
            gain, loss = sum(max(v, 0) for v in d[:13]) / 14, sum(max(-v, 0) for v in d[:13]) / 14
            for v in d[13:]:
                gain, loss = (gain * 13 + max(v, 0)) / 14, (loss * 13 + max(-v, 0)) / 14
            want = round(100 - 100 / (1 + gain / loss), 2)
        assert x.rsi == pytest.approx(want, abs=0.011)


def test_markers_and_sizes(spark):
    t = spark.createDataFrame([("A", 7, "SELL", 10.0, 30.0), ("A", 7, "SELL", 20.0, None), ("A", 9, "BUY", 2.5, 8.0)], "symbol string, candle long, action string, price double, qty double")
    assert [r.text for r in stats.trade_markers(t).orderBy("candle").collect()] == [f"S 2x (130@{(10 * 30 + 20 * 100) / 130:.2f})", "B 8@2.50"]
    rows = [(0.5, 1.0, 1000.0, 50.0, 0), (0.01, 1.0, 1000.0, 1.0, 4), (0.45, 1.0, 1000.0, 100.0, 0), (1.0, 0.5, 1000.0, 100.0, 30), (1.0, 1.0, 1.0, 0.0, 3)]
    s = spark.createDataFrame(rows, "weight double, multiplier double, nav double, price double, quantity long")
    assert [r.order_qty for r in features.order_sizing(s).collect()] == [10, 0, 0, -25, 0]


def test_anchored_line(spark):
    r = random.Random(3)
    rows = [(s, at * 3 + r.randrange(3), float(at), at) for s in "AB" for at in range(50)]
    want = {}
    for s in "AB":
        anchor = None
        for x, t, p, _ in rows:
            if x == s:
                anchor = t if anchor is None or t - anchor >= 10 else anchor
                want[s, anchor] = p
    got = chains.anchored_line(spark.createDataFrame(rows, "symbol string, ts_ms long, price double, seq long").repartition(4), 10)
    assert {(x.symbol, x.time): x.value for x in got.collect()} == want


def test_names_of_frames(spark):
    b = spark.createDataFrame([("A", 0, 1.0)], "symbol string, bar_start long, close double")
    with pytest.raises(ValueError):
        stats.timeframe_filter(b, "2w")
    with pytest.raises(ValueError):
        stats.interval_seconds("7m")
    assert stats.interval_seconds("7m", lenient=True) == 1800 and stats.intervals(spark).filter("seconds IS NULL").count() == 3


@pytest.mark.parametrize("name", ["ohlcv_bars", "live_bars", "gap_fill_bars", "asof_trade_candle", "asof_order_next_bar", "nav_series", "sma_sweep", "risk_decisions", "illegal_transitions", "resolve_cancels",
                                  "decode_status", "market_session", "stream_bars", "scan_order_events"])
def test_oracle(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("events", "orders", "customer", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = plans.queries()[name](spark, SF)
    names = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({plans.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, want))


def test_plans_have_one_exchange(spark):
    t = spark.createDataFrame(late_ticks(), TICK)
    for df in (bars.ohlcv(t), features.features(bars.ohlcv(t), 5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and plan.count("Exchange hashpartitioning") <= 2
