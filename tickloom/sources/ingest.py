"""JSON payloads, bar files and event logs to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TICK = "array<struct<sym:string,p:double,s:double,t:bigint>>"
TYPED_TICK = "array<map<string,string>>"  # T and t, S and s are different keys
BARS = "bars map<string,array<struct<t:string,o:double,h:double,l:double,c:double>>>"
RESULTS = "results array<struct<t:bigint,o:double,h:double,l:double,c:double>>"
EVENT = ("order_id string, event_seq bigint, state int, delta_qty int, timestamp bigint, correlation_id string, "
         "symbol string, price double, total_qty int")


def valid_ticks(df: DataFrame) -> DataFrame:
    """Ticks with a symbol and a time."""
    return df.filter((F.coalesce(F.col("symbol"), F.lit("")) != "") & (F.coalesce(F.col("ts_ms"), F.lit(0)) != 0))


def parse_ticks(df: DataFrame, col: str) -> DataFrame:
    """One payload is an object or an array; one that is empty or broken gives no rows."""
    c = F.trim(F.col(col))
    items = F.from_json(F.when(F.substring(c, 1, 1) == "[", c).otherwise(F.concat(F.lit("["), c, F.lit("]"))), TICK)
    rows = df.select(F.explode(items).alias("x")).select(F.col("x.sym").alias("symbol"), F.coalesce("x.p", F.lit(0.0)).alias("price"),
                                                         F.coalesce("x.s", F.lit(0.0)).alias("size"), F.col("x.t").alias("ts_ms"))
    return valid_ticks(rows)


def parse_ticks_typed(df: DataFrame, col: str) -> DataFrame:
    """Ticks of the vendor that marks them T = t and gives RFC 3339 times; a bad time is now."""
    rows = df.select(F.explode(F.from_json(F.col(col), TYPED_TICK)).alias("x")).filter(F.col("x")["T"] == "t")
    at = F.coalesce(F.unix_millis(F.try_to_timestamp(F.col("x")["t"])), F.unix_millis(F.current_timestamp()))
    number = lambda k: F.coalesce(F.expr(f"try_cast(x['{k}'] AS double)"), F.lit(0.0))
    return valid_ticks(rows.select(F.col("x")["S"].alias("symbol"), number("p").alias("price"), number("s").alias("size"), at.alias("ts_ms")))


def parse_bars_map(df: DataFrame, col: str, symbol: str | None = None) -> DataFrame:
    """Bars of a payload that maps symbols to lists, newest first; of one symbol if it is given. Within a payload they come oldest first."""
    lists = F.from_json(F.col(col), BARS)["bars"]
    rows = df.select(F.explode(lists).alias("symbol", "list")) if symbol is None else df.select(
        F.lit(symbol).alias("symbol"), F.try_element_at(lists, F.lit(symbol)).alias("list"))
    rows = rows.select("symbol", F.explode(F.reverse("list")).alias("x"))
    return rows.select("symbol", F.unix_seconds(F.try_to_timestamp("x.t")).alias("time"), F.col("x.o").alias("open"), F.col("x.h").alias("high"),
                       F.col("x.l").alias("low"), F.col("x.c").alias("close"))


def parse_bars_array(df: DataFrame, col: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(F.from_json(F.col(col), RESULTS)["results"]).alias("x")).select(*keep,
        F.expr("x.t div 1000").alias("time"), F.col("x.o").alias("open"), F.col("x.h").alias("high"), F.col("x.l").alias("low"), F.col("x.c").alias("close"))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("timestamp bigint, open double, high double, low double, close double, volume double, date string, symbol string").parquet(path)


def read_order_events(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines are passed over; any other line that is no event fails the read."""
    return spark.read.schema(EVENT).option("mode", "FAILFAST").json(path)


def read_trades(df: DataFrame) -> DataFrame:
    return df.withColumn("ts_ms", F.coalesce(F.nullif(F.col("ts_ms"), F.lit(0)), F.unix_millis(F.current_timestamp())))


def route(df: DataFrame, prefix: str) -> DataFrame:
    """Rows of a mixed feed (topic, payload) whose topic begins so; the rest of the topic is the symbol."""
    return df.filter(F.col("topic").startswith(prefix)).withColumn("symbol", F.substring(F.col("topic"), len(prefix) + 1, 1 << 20))


def with_correlation_id(df: DataFrame) -> DataFrame:
    return df.withColumn("correlation_id", F.sha2(F.concat_ws(",", "symbol", F.col("ts_ms").cast("string"), F.col("seq").cast("string")), 256))
