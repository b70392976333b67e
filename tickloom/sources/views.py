"""Ticks, orders, fills and logs as views of the driver's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; one of this machine only if all run on it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-tickloom-", dir="/tmp")
    return f"{root.rstrip('/')}/tickloom-{uuid.uuid4().hex}"


PART_BYTES, MOST_PARTS = 128 << 20, 20_000


def pieces(df: DataFrame, each: int) -> int:
    """One for each so many bytes of the files that df reads."""
    leaves, total = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        size = int(leaves.apply(i).stats().sizeInBytes())
        total += size if size < 1 << 60 else 0  # rows that are in no file have no known size
    return max(1, min(MOST_PARTS, -(-total // each)))


def partitions(df: DataFrame, each: int = PART_BYTES) -> int:
    """The session's shuffle partitions, or one for each so many bytes of the files that df reads, if that is more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), pieces(df, each))


def millis(c):
    return F.unix_millis(F.col(c).cast("timestamp"))


def ticks(spark, sf):
    return ticks_of(table(spark, sf, "events"))


def ticks_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("symbol"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"), millis("ts").alias("ts_ms"), F.col("event_id").alias("seq"))


def ticks_late(spark, sf):
    """Every tenth tick arrives 40 minutes late; seq is the order of arrival of a symbol."""
    t = ticks(spark, sf)
    arrival = F.col("ts_ms") + F.when(F.col("seq") % 10 == 0, 2_400_000).otherwise(0)
    w = Window.partitionBy("symbol").orderBy("arrival", "seq")
    return t.withColumn("arrival", arrival).withColumn("seq", F.row_number().over(w).cast("long")).drop("arrival")


def orders(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return (o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("account_id"), F.row_number().over(w).cast("long").alias("seq"),
        F.col("o_orderpriority").alias("symbol"), F.col("o_totalprice").alias("value"),
        (100 * F.greatest(F.col("c_acctbal"), F.lit(0.0))).alias("margin"), millis("o_orderdate").alias("ts_ms")))


def fills(spark, sf):
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")  # noqa: E741
    return l.join(p, l.l_partkey == p.p_partkey).select(
        F.col("l_suppkey").alias("run_id"), F.col("p_brand").alias("symbol"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.col("l_quantity").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), millis("l_shipdate").alias("ts_ms"))


#: What comes behind an order's fills, by its id modulo 7; the others end with a partial fill.
TAILS = {1: ["PENDING_CANCEL"], 2: ["PENDING_CANCEL", "CANCELED"], 3: ["FILLED"], 4: ["CANCELED"], 5: ["REJECTED"], 6: ["PENDING"]}


#: Bytes of the files of lines for each partition of the order events: a line becomes about two wide rows, and files of repeated values are small.
LINE_BYTES = 4 << 20


def order_events(spark, sf):
    """PENDING, SUBMITTED, a partial fill for each line, then a tail. Odd orders are one short, so they over-fill; of every eleventh five are missing.

    Lines are dealt by order once and sorted once; an order's first line gives what comes before it, too, and its last one the tail. Partitions follow the files
    and are not put together again, as compressed shuffles say little of what rows take in memory; what replays the events goes on in them."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    l = l.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity").repartition(partitions(l, LINE_BYTES), "l_orderkey")  # noqa: E741
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = (F.sum("l_quantity").over(whole).cast("int") - F.when(F.col("l_orderkey") % 2 == 1, 1).otherwise(0)
             + F.when(F.col("l_orderkey") % 11 == 0, 5).otherwise(0))
    lines = l.select(F.col("l_orderkey").alias("order_id"), (F.row_number().over(w) + 2).cast("long").alias("seq"), (F.count(F.lit(1)).over(whole) + 2).alias("n"),
                     F.col("l_quantity").cast("int").alias("qty"), total.alias("total_qty"))
    tail = F.array().cast("array<string>")
    for k, states in TAILS.items():
        tail = F.when(F.col("order_id") % 7 == k, F.array(*map(F.lit, states))).otherwise(tail)
    event = lambda seq, state, qty: F.struct(seq.cast("long").alias("event_seq"), state.alias("state"), qty.cast("int").alias("delta_qty"))
    none = F.array(event(F.lit(0), F.lit(""), F.lit(0)))
    own = F.array(event(F.col("seq"), F.lit("PARTIALLY_FILLED"), F.col("qty")))
    before = F.when(F.col("seq") == 3, F.array(event(F.lit(1), F.lit("PENDING"), F.lit(0)), event(F.lit(2), F.lit("SUBMITTED"), F.lit(0)))).otherwise(F.slice(none, 1, 0))
    behind = F.when(F.col("seq") == F.col("n"), F.transform(tail, lambda s, i: event(F.col("n") + i + 1, s, F.lit(0)))).otherwise(F.slice(none, 1, 0))
    events = lines.select("order_id", F.explode(F.concat(before, own, behind)).alias("e"), "total_qty").select("order_id", "e.*", "total_qty")
    return events.withColumns({"symbol": F.concat(F.lit("S"), (F.col("order_id") + F.col("event_seq")) % 5), "price": F.col("event_seq") * 1.5,
                               "correlation_id": F.concat_ws("-", "order_id", "event_seq")})


def spread(spark, sf):
    """Ticks spread over eight years and all minutes of the day."""
    t = ticks(spark, sf)
    return t.withColumn("ts_ms", F.col("ts_ms") + F.col("seq") % 2900 * 86_400_000 + F.col("seq") * 7919 % 1440 * 60_000)


def trades(spark, sf):
    """Purchases and clicks buy, all others sell."""
    e = table(spark, sf, "events")
    return e.select((F.col("user_id") % 10).cast("string").alias("symbol"), F.when(F.col("event_type").isin("purchase", "click"), "BUY").otherwise("SELL").alias("action"),
                    F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("qty"), millis("ts").alias("ts_ms"), F.col("event_id").alias("seq"))


def service_log(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("service"), F.when(F.col("value") < 35, "SERVING").otherwise("NOT_SERVING").alias("status"),
                                             millis("ts").alias("ts_ms"), F.col("event_id").alias("seq"))
