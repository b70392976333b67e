"""What is recorded is whole: batches that break off, lists that change, corrections of an archive, universes that wait."""

import os
import random
import time

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tickloom.operators import asof, bars, orders
from tickloom.plans import feeds
from tickloom.plans import queries as plans
from tickloom.sources import sinks, views
from tickloom.streaming import barrier
from tickloom.streaming import stateful as st

TICK = "symbol string, price double, seq long"
BAR = "symbol string, bar_start long, open double, high double, low double, close double, volume double, version int"


def add_file(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def source(spark, path, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def failing(monkeypatch, where):
    """Spark's Parquet writer fails for paths that hold ``where``."""
    write = DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        if where in path:
            raise OSError("disk full")
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)


def test_a_batch_is_recorded_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """The second output fails after the first one was written: a reader sees neither; once mended, both, once."""
    schema = spark.createDataFrame([], TICK).schema
    for i in range(3):
        add_file(spark, f"{tmp_path}/in", [("A", float(i), i), ("B", float(i), 10 + i)], TICK)
    start = lambda: sinks.start_recorder(source(spark, f"{tmp_path}/in", TICK), source(spark, f"{tmp_path}/in", TICK), f"{tmp_path}/out", f"{tmp_path}/c", once=True)
    with monkeypatch.context() as m, pytest.raises(Exception, match="disk full"):
        failing(m, f"{tmp_path}/out/bars")
        start().awaitTermination()
    seen = {kind: sinks.recorded(spark, f"{tmp_path}/out", kind, schema).count() for kind in ("ticks", "bars")}
    assert seen == {"ticks": 0, "bars": 0} and spark.read.parquet(f"{tmp_path}/out/ticks").count() == 2  # ticks are there, but not visible
    start().awaitTermination()
    for kind in ("ticks", "bars"):
        rows = sinks.recorded(spark, f"{tmp_path}/out", kind, schema)
        assert sorted(r.seq for r in rows.collect()) == [0, 1, 2, 10, 11, 12] and rows.groupBy("batch_id").count().filter("count > 2").count() == 0


def test_a_new_checkpoint_keeps_what_was_recorded(spark, tmp_path):
    schema = spark.createDataFrame([], TICK).schema
    add_file(spark, f"{tmp_path}/in", [("A", 1.0, 1)], TICK)
    for c in "xy":
        sinks.start_recorder(source(spark, f"{tmp_path}/in", TICK), None, f"{tmp_path}/out", f"{tmp_path}/{c}", once=True).awaitTermination()
    rows = sinks.recorded(spark, f"{tmp_path}/out", "ticks", schema)
    assert rows.count() == 2 and rows.select("run").distinct().count() == 2
    assert sinks.recorded(spark, f"{tmp_path}/out", "bars", schema).count() == 0


def test_lists_that_change_between_batches(spark, tmp_path, monkeypatch):
    """Each batch sees the list that was newest when it began, and the same one when it is tried again."""
    out = lambda: sorted((r.seq, r.version) for r in sinks.recorded(spark, f"{tmp_path}/out", "listed", spark.createDataFrame([], f"{TICK}, version int").schema).collect())
    run = lambda: sinks.start_listed(source(spark, f"{tmp_path}/in", TICK), f"{tmp_path}/l", f"{tmp_path}/out", f"{tmp_path}/c", once=True)
    names = lambda *s: spark.createDataFrame([(x,) for x in s], "symbol string")
    assert sinks.publish_list(names("A", "A"), f"{tmp_path}/l") == 0
    add_file(spark, f"{tmp_path}/in", [("A", 1.0, 1), ("B", 1.0, 2)], TICK)
    run().awaitTermination()
    assert out() == [(1, 0)]
    assert sinks.publish_list(names("B"), f"{tmp_path}/l") == 1
    add_file(spark, f"{tmp_path}/in", [("A", 2.0, 3), ("B", 2.0, 4)], TICK)
    with monkeypatch.context() as m, pytest.raises(Exception, match="disk full"):
        failing(m, f"{tmp_path}/out/listed")
        run().awaitTermination()
    sinks.publish_list(names("A", "B"), f"{tmp_path}/l")
    run().awaitTermination()
    assert out() == [(1, 0), (4, 1)]
    add_file(spark, f"{tmp_path}/in", [("A", 1.0, 5), ("B", 1.0, 6), (None, 1.0, 7)], TICK)
    run().awaitTermination()
    assert out() == [(1, 0), (4, 1), (5, 2), (6, 2)]


def test_corrections_touch_their_folders_only(spark, tmp_path):
    r, day, path = random.Random(2), 86_400_000, f"{tmp_path}/a"
    rows = [(s, d * day + h * 3_600_000, 1.0, 2.0, 0.5, float(r.randrange(9)), 1.0, 0) for s in "AB" for d in range(3) for h in range(4)]
    rounds = [rows, [("A", day, 1.0, 2.0, 0.5, 50.0, 1.0, 1), ("A", day, 1.0, 2.0, 0.5, 49.0, 1.0, 0), ("C", day, 1.0, 1.0, 1.0, 1.0, 1.0, 0)], [("A", day, 1.0, 2.0, 0.5, 60.0, 1.0, 2), ("B", 0, 1.0, 2.0, 0.5, 70.0, 1.0, 1)]]
    files = lambda: {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(f"{path}/bars") for f in names if f.endswith(".parquet")}
    every = []
    for n, some in enumerate(rounds):
        before = files()
        assert sinks.upsert_bars(spark.createDataFrame(some, BAR), path, n) and not sinks.upsert_bars(spark.createDataFrame(rows, BAR), path, n)
        every += some
        want = {tuple(x) for x in bars.latest_bars(spark.createDataFrame(every, BAR)).collect()}
        got = sinks.archived(spark, path).select(*[c.split()[0] for c in BAR.split(", ")])
        assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
        if n:
            gone = {os.path.relpath(f, f"{path}/bars").rsplit("/", 1)[0] for f, t in before.items() if files().get(f) != t}
            assert gone == {f"date={time.strftime('%Y%m%d', time.gmtime(x[1] // 1000))}/symbol={x[0]}" for x in some if x[0] != "C"}


UNI = "universe string, symbol string, bar_start long, open double, high double, low double, close double, volume double"


def bar(u, s, t, c):
    return u, s, t, c, c + 1, c - 1, c, 2.0


def test_barrier_in_batches(spark, tmp_path):
    """Two universes, one of 40 symbols; bars of a time may come in several batches; late, foreign and repeated ones do not count."""
    r = random.Random(1)
    names = [("u", f"s{i}") for i in range(40)] + [("v", "x"), ("v", "y"), ("v", "x")]
    symbols = spark.createDataFrame(names, "universe string, symbol string")
    rows = [[bar(u, s, t, float(r.randrange(9))) for t in (2 * n, 2 * n + 1) for u, s in dict.fromkeys(names) if r.random() < (1.0 if t == 3 else 0.7)] for n in range(4)]
    rows[1].append(bar("u", "stranger", 3, 1.0))
    rows[1].append(bar("w", "s1", 3, 1.0))
    late = [bar("u", "s0", 0, 99.0)]
    for some in (*rows[:3], [*rows[3], *late]):
        add_file(spark, f"{tmp_path}/in", some, UNI)
    for _ in range(2):  # the second call finds nothing new
        barrier.start_barrier(source(spark, f"{tmp_path}/in", UNI), symbols, f"{tmp_path}/out", f"{tmp_path}/c", once=True).awaitTermination()
    got = sinks.recorded(spark, f"{tmp_path}/out", "aligned", spark.createDataFrame([], UNI).schema).drop("run", "batch_id").collect()
    want = []
    for u in "uv":
        own = spark.createDataFrame([x[1:] for x in sum(rows, []) if x[0] == u and x[1] != "stranger"], UNI.split(", ", 1)[1])
        top = own.agg(F.max("bar_start")).first()[0]
        full = own.filter(F.col("bar_start") == top).select("symbol").distinct().count() == len({s for w, s in names if w == u})
        want += [(u, *(x[c] for c in ("symbol", "bar_start", "open", "high", "low", "close", "volume"))) for x in asof.align(own, symbols.filter(F.col("universe") == u).select("symbol").distinct()).collect() if x.bar_start < top or full]
    assert sorted(map(tuple, got)) == sorted(want)


def test_orders_go_on_from_a_replayed_log(spark, tmp_path):
    schema = "order_id long, event_seq long, state string, delta_qty int, total_qty long"
    known = spark.createDataFrame([(1, "SUBMITTED", 0, 10), (2, "PARTIALLY_FILLED", 4, 5), (3, "FILLED", 7, 7)], "order_id long, state string, cum_qty long, total_qty long")
    add_file(spark, f"{tmp_path}/in", [(1, 3, "PARTIALLY_FILLED", 4, None), (2, 3, "PARTIALLY_FILLED", 2, None), (3, 9, "PENDING_CANCEL", 0, None), (4, 1, "PENDING", 0, 3)], schema)
    add_file(spark, f"{tmp_path}/in", [(1, 4, "FILLED", 6, None), (2, 4, "PARTIALLY_FILLED", 1, None)], schema)

    def run():
        sent = sinks.drain(st.stream_orders(source(spark, f"{tmp_path}/in", schema), known), f"{tmp_path}/out", f"{tmp_path}/c", "update")
        return {(r.order_id, r.event_seq): (r.result, r.state, r.cum_qty) for r in sent.collect()}

    want = {(1, 3): ("ACCEPTED", "PARTIALLY_FILLED", 4), (2, 3): ("OVERFILL", "PARTIALLY_FILLED", 4), (3, 9): ("ILLEGAL", "FILLED", 7), (4, 1): ("ACCEPTED", "PENDING", 0),
            (1, 4): ("ACCEPTED", "FILLED", 10), (2, 4): ("ACCEPTED", "FILLED", 5)}
    assert run() == want
    add_file(spark, f"{tmp_path}/in", [(1, 5, "PENDING_CANCEL", 0, None), (4, 2, "REJECTED", 0, None)], schema)
    assert run() == want | {(1, 5): ("ILLEGAL", "FILLED", 10), (4, 2): ("ACCEPTED", "REJECTED", 0)}


def test_ended_orders_are_forgotten(spark, tmp_path):
    """A change that comes after the time to keep ended orders opens a new one; an open order stays."""
    schema = "order_id long, event_seq long, state string, delta_qty int, total_qty long, ms long"
    for some in ([(1, 1, "PENDING", 0, 5, 5), (1, 2, "REJECTED", 0, 5, 10), (2, 1, "PENDING", 0, 5, 5)], [(3, 1, "PENDING", 0, 1, 500)], [(1, 3, "FILLED", 0, 5, 600), (3, 2, "SUBMITTED", 0, 1, 90_000)],
                 [(3, 3, "FILLED", 1, 1, 90_000)], [(1, 4, "SUBMITTED", 0, 8, 95_000), (2, 2, "SUBMITTED", 0, 8, 95_000)]):
        add_file(spark, f"{tmp_path}/in", some, schema)
    events = source(spark, f"{tmp_path}/in", schema).withColumn("ts", F.timestamp_millis("ms"))
    sent = sinks.drain(st.stream_orders(events, forget_ms=1000, delay="0 seconds"), f"{tmp_path}/out", f"{tmp_path}/c", "update")
    got = {(r.order_id, r.event_seq): (r.result, r.state, r.total_qty) for r in sent.collect()}
    assert got[1, 3] == ("ILLEGAL", "REJECTED", 5)  # not forgotten yet
    assert got[1, 4] == ("ACCEPTED", "SUBMITTED", 8) and got[2, 2] == ("ACCEPTED", "SUBMITTED", 5) and got[3, 3] == ("ACCEPTED", "FILLED", 1)


def test_orders_of_a_bucket_are_decided_as_one_by_one(spark, tmp_path):
    """Orders that share a bucket, over batches of several files: the same as a plain loop, with few keys of state."""
    rng, schema = random.Random(3), "order_id long, event_seq long, state string, delta_qty int, total_qty long"
    some = [(k, n, rng.choice([*("PENDING SUBMITTED PARTIALLY_FILLED PARTIALLY_FILLED FILLED PENDING_CANCEL CANCELED".split()), None, "else"]), rng.choice([None, 1, 2, 5]), rng.choice([None, 4, 6]))
            for k in [*range(60), None, (1 << 60) + 1] for n in range(1, 9)]
    first = [(k, "SUBMITTED", 0, 4) for k in range(0, 60, 2)]
    for part in (range(1, 4), range(4, 9)):
        add_file(spark, f"{tmp_path}/in", [r for r in some if r[1] in part], schema)
    known = spark.createDataFrame(first, "order_id long, state string, cum_qty long, total_qty long")
    sent = sinks.drain(st.stream_orders(source(spark, f"{tmp_path}/in", schema), known, buckets=3), f"{tmp_path}/out", f"{tmp_path}/c", "update", 2)
    want, state = [], {k: (s, c, t) for k, s, c, t in first}
    for k, n, asked, delta, total in some:
        if k not in state:
            state[k], result = (asked, 0, total), "ACCEPTED"
        else:
            was, cum, most = state[k]
            result = "ACCEPTED" if (was, asked) in st.LEGAL else "ILLEGAL"
            if result == "ACCEPTED" and asked in ("PARTIALLY_FILLED", "FILLED") and most is not None:
                new = cum + (delta or 0)
                result = "OVERFILL" if new > most else "UNDERFILLED" if asked == "FILLED" and new < most else "ACCEPTED"
                asked, cum = ("FILLED" if new == most else asked), (cum if new > most else new)
            if result in ("ACCEPTED", "UNDERFILLED"):
                state[k] = asked, cum, most
        want.append((k, n, result, *state[k]))
    got = [(r.order_id, r.event_seq, r.result, r.state, r.cum_qty, r.total_qty) for r in sent.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(x for x in os.listdir(f"{tmp_path}/c/state/0") if x.isdigit()) == ["0", "1"]  # not the session's partitions


def test_order_events_partitions_follow_the_files(spark, monkeypatch):
    """Lines are dealt once, to fixed partitions of bounded size, in which the replay goes on."""
    sf, each = "/root/testdata/sf0.001", 10_000
    monkeypatch.setattr(views, "LINE_BYTES", each)
    states = orders.replay(views.order_events(spark, sf))
    assert states.rdd.getNumPartitions() == -(-os.path.getsize(f"{sf}/lineitem.parquet") // each) > 4
    assert states._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_cancels_of_larger_tables_take_no_larger_tasks(spark, monkeypatch):
    """Requests join in the partitions of the lines: ten times the tables give ten times the tasks."""
    monkeypatch.setattr(views, "LINE_BYTES", 20_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as it is for large tables
    try:
        most = [max(plans.queries()["resolve_cancels"](spark, f"/root/testdata/sf{sf}").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) for sf in ("0.001", "0.01")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert most[1] < 1.5 * most[0]


def test_order_log_is_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(views, "scratch", lambda spark: f"{tmp_path}/log")
    rows = feeds.scan_order_events(spark, "/root/testdata/sf0.001").count()
    assert sum(os.path.getsize(f"{tmp_path}/log/{f}") for f in os.listdir(f"{tmp_path}/log")) < 40 * rows
