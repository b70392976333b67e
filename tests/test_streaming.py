"""Streams in two batches against the batch operators over the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars, chains, features, orders
from tickloom.streaming import bars as sb
from tickloom.streaming import ordered
from tickloom.streaming import stateful as st

H = 3_600_000
TICK = "symbol string, price double, size double, ts_ms long, seq long"
ROWS = [("A", 10.0, 1.0, 0, 1), ("B", 5.0, 1.0, 100, 2), ("A", 11.0, 2.0, H // 2, 3), ("A", 12.0, 1.0, 3 * H, 4), ("A", 9.0, 1.0, 2 * H, 5),
        ("A", 13.0, 1.0, 3 * H + 5, 6), ("A", 8.0, 1.0, 40 * H, 7), ("B", 6.0, 1.0, H, 8)]


@pytest.fixture
def stream(spark, tmp_path):
    """Runs a stream over rows in some files, one a batch, each one's rows in any order, and gives all rows that were sent."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    count = iter(range(100))

    def run(rows, schema, function, files=2):
        n = next(count)
        cuts = [len(rows) * i // files for i in range(files + 1)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = rows[a:b]
            random.Random(a).shuffle(part)
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{n}")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in{n}")
        q = (function(source).writeStream.format("memory").queryName(f"sent{n}").outputMode("update").option("checkpointLocation", f"{tmp_path}/c{n}")
             .trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.table(f"sent{n}").collect()
    return run


def test_candles(spark, stream):
    sent = stream(ROWS, TICK, lambda t: st.stream_candles(t, H))
    last = {(r.symbol, r.bar_start): (r.open, r.high, r.low, r.close, r.volume, r.filled) for r in sorted(sent, key=lambda r: r.step)}
    whole = bars.gap_fill(bars.live_candles(spark.createDataFrame(ROWS, TICK), H), H)
    assert last == {(r.symbol, r.bar_start): (r.open, r.high, r.low, r.close, r.volume, r.filled) for r in whole.collect()}


def made_ticks(n, seed=4):
    """Ticks of three symbols that go on in time, of which some are late by up to two hours; one symbol is busy."""
    r = random.Random(seed)
    return [(r.choice("AAAAAAB"), float(r.randrange(1, 99)), float(r.randrange(1, 9)), i * H // 20 - r.choice([0, 0, 0, 0, r.randrange(2 * H)]) + 10 * H, i) for i in range(n)]


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_bars_of_several_batches(spark, stream, monkeypatch, chunk):
    """Late ticks of an earlier batch's bar correct it; rows that a batch has too many of go through the state store."""
    monkeypatch.setattr(ordered.Ordered, "chunk", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5 if chunk == 7 else 10_000)
    rows = made_ticks(300)
    sent = stream(rows, TICK, lambda t: sb.stream_bars(t, H, H // 2), files=11)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last = {}
    for r in sent:
        key = r.symbol, r.bar_start
        assert key not in last or last[key][-1] != r.version or last[key] == tuple(r)[2:]
        if key not in last or r.version > last[key][-1]:
            last[key] = tuple(r)[2:]
    whole = bars.live_bars(spark.createDataFrame(rows, TICK), H, H // 2).collect()
    top = {s: max(r.bar_start for r in whole if r.symbol == s) for s in "AB"}
    want = {(r.symbol, r.bar_start): tuple(r)[2:] for r in whole if r.bar_start < top[r.symbol]}
    assert {k: v[:-1] for k, v in last.items()} == want
    late = bars.audit(spark.createDataFrame(rows, TICK), H, H // 2).filter("kind = 'LATE_ACCEPTED'").groupBy("symbol", F.expr(f"ts_ms - ts_ms % {H}").alias("at")).count().collect()
    assert {k: v[-1] for k, v in last.items() if v[-1]} == {(r.symbol, r["at"]): r["count"] for r in late} and len(late) > 3
    assert len({(r.symbol, r.bar_start) for r in sent}) < len(sent)  # some went out again


@pytest.mark.parametrize("chunk,keep", [(7, 500), (1 << 16, 5), (7, 3)])
def test_candles_of_several_batches(spark, stream, monkeypatch, chunk, keep):
    monkeypatch.setattr(ordered.Ordered, "chunk", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5 if chunk == 7 else 10_000)
    rows = made_ticks(200)
    rows = [(s, p, v, t + (9 * H if i > 120 else 0) + (40 * H if i > 160 else 0), i) for s, p, v, t, i in rows]
    sent = stream(rows, TICK, lambda t: st.stream_candles(t, H, keep=keep), files=4)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last = {}
    for r in sorted(sent, key=lambda r: r.step):
        last[r.symbol, r.bar_start] = None if r.evicted else tuple(r)[2:8]
    whole = bars.last_n(bars.gap_fill(bars.live_candles(spark.createDataFrame(rows, TICK), H), H), keep)
    assert {k: v for k, v in last.items() if v} == {(r.symbol, r.bar_start): tuple(r)[2:8] for r in whole.select("symbol", "bar_start", "open", "high", "low", "close", "volume", "filled").collect()}


def test_bars_that_a_timer_closes(spark, stream):
    """A symbol that falls silent: its open bar goes out once the watermark has passed it, and a later tick begins anew."""
    rows = [("A", 1.0, 1.0, 0, 1), ("A", 2.0, 1.0, H // 2, 2), ("B", 5.0, 1.0, H // 3, 3), ("A", 3.0, 1.0, 5 * H, 4), ("A", 4.0, 1.0, 6 * H, 5), ("A", 4.5, 1.0, 6 * H + 1, 6), ("B", 7.0, 1.0, 9 * H, 7), ("A", 5.0, 1.0, 9 * H, 8)]
    rows = [(s, p, v, t + 10 * H, i) for s, p, v, t, i in rows]
    sent = [tuple(r) for r in stream(rows, TICK, lambda t: sb.stream_bars(t, H, 100, closing="1 minute"), files=4)]
    assert ("B", 10 * H, 5.0, 5.0, 5.0, 5.0, 1.0, 0) in sent and len(set(sent)) == len(sent)
    assert {r[1] for r in sent if r[0] == "A"} == {10 * H, 15 * H, 16 * H} and ("A", 10 * H, 1.0, 2.0, 1.0, 2.0, 2.0, 0) in sent


def test_line(spark, stream):
    last = {(r.symbol, r.time): r.value for r in sorted(stream(ROWS, TICK, lambda t: st.stream_line(t, H)), key=lambda r: r.step)}
    assert last == {(r.symbol, r.time): r.value for r in chains.anchored_line(spark.createDataFrame(ROWS, TICK), H).collect()}


def test_features(spark, stream):
    rows = [("A", i, 100.0 + i * i % 7) for i in range(12)]
    schema = "symbol string, bar_start long, close double"
    got = {r.bar_start: tuple(r)[3:] for r in stream(rows, schema, lambda b: st.stream_features(b, 4))}
    want = {r.bar_start: tuple(r)[3:] for r in features.features_warm(spark.createDataFrame(rows, schema), 4).select("symbol", "bar_start", "close", "log_return", "ret_mean", "ret_std", "zscore").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_order_states(stream):
    rows = [(1, 1, "PENDING", 7, 10), (1, 2, "SUBMITTED", 0, 10), (1, 3, "PARTIALLY_FILLED", 4, 10), (2, 1, "PENDING", 0, 5), (1, 4, "SUBMITTED", 0, 10),
            (1, 5, "PARTIALLY_FILLED", 7, 10), (1, 6, "PARTIALLY_FILLED", 6, 10), (1, 7, "CANCELED", 0, 10), (2, 2, "SUBMITTED", 0, 5), (2, 3, "FILLED", 3, 5)]
    got = {(r.order_id, r.event_seq): (r.result, r.state, r.cum_qty) for r in stream(rows, "order_id long, event_seq long, state string, delta_qty int, total_qty long", st.stream_orders)}
    assert [got[1, i] for i in range(1, 8)] == [("ACCEPTED", "PENDING", 0), ("ACCEPTED", "SUBMITTED", 0), ("ACCEPTED", "PARTIALLY_FILLED", 4), ("ILLEGAL", "PARTIALLY_FILLED", 4),
                                                ("OVERFILL", "PARTIALLY_FILLED", 4), ("ACCEPTED", "FILLED", 10), ("ILLEGAL", "FILLED", 10)]
    assert got[2, 3] == ("UNDERFILLED", "FILLED", 3)


def test_barrier(stream):
    rows = [("u", s, t, c, c, c, c, 1.0, i) for i, (s, t, c) in enumerate([("A", 1, 10.0), ("B", 1, 20.0), ("B", 2, 21.0), ("A", 3, 12.0), ("B", 2, 99.0), ("X", 3, 1.0), ("B", 3, 22.0), ("A", 4, 13.0)])]
    schema = "universe string, symbol string, bar_start long, open double, high double, low double, close double, volume double, seq long"
    got = {(r.symbol, r.bar_start): (r.close, r.volume) for r in stream(rows, schema, lambda b: st.stream_barrier(b, ["A", "B"]))}
    assert got == {("A", 1): (10.0, 1.0), ("B", 1): (20.0, 1.0), ("A", 2): (10.0, 0.0), ("B", 2): (21.0, 1.0), ("A", 3): (12.0, 1.0), ("B", 3): (22.0, 1.0)}


def test_risk(spark, stream):
    rows = [(i, 1, i, "AAPL" if i % 5 else "BAD", 600.0 if i != 3 else None, 5000.0) for i in range(20)] + [(99, 2, 1, "AAPL", 60000.0, 1e6)]
    schema = "order_id long, account_id long, seq long, symbol string, value double, margin double"
    bad = spark.createDataFrame([("BAD",)], "symbol string")
    got = sorted(tuple(r) for r in stream(rows, schema, lambda o: st.stream_risk(o, 50000.0, bad)))
    assert got == sorted(tuple(r) for r in orders.risk_decisions(spark.createDataFrame(rows, schema), 50000.0, ["BAD"]).collect())


def test_filters(spark, stream):
    rows = [(1, "A", 5), (1, "A", 6), (2, "B", 7), (2, "B", 8)]
    timed = lambda o: o.withColumn("ts", F.timestamp_millis("ms"))
    assert sorted(r.order_id for r in stream(rows, "order_id long, symbol string, ms long", lambda o: st.stream_dedup_submits(timed(o)))) == [1, 2]
    listed = spark.createDataFrame([("A",), ("A",)], "symbol string")
    assert len(stream(rows, "order_id long, symbol string, ms long", lambda o: st.stream_static_filter(o, listed))) == 2
