"""As-of, range and grid joins. As-of joins work in slices of time, so that one busy symbol is many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE_MS = 86_400_000  # of an as-of join; each slice hands one row on to the others
UNIVERSE = 100_000     # symbols that are broadcast


def nearest(rows: DataFrame, marks: DataFrame, after: bool = False, slice_ms: int = SLICE_MS) -> DataFrame:
    """rows (symbol, at, ...) with mark, the struct (at, ...) of the last of marks up to their time; after: of the first
    strictly later one. Null where there is none; of several marks at a time the greatest (after: the least) struct.

    Both sides are sorted together once by (symbol, slice), and a running maximum finds the mark of the same slice. Of
    each slice one mark is then handed on over the slices, of which there are few. Rows without a symbol have no mark.
    """
    kept = [c for c in rows.columns if c not in ("symbol", "at")]
    slice_ = F.floor(F.col("at") / slice_ms).alias("slice")
    own = rows.select("symbol", "at", slice_, F.struct(*kept).alias("row"))
    mark = marks.filter("symbol IS NOT NULL").select("symbol", "at", slice_, F.struct("at", *(c for c in marks.columns if c not in ("symbol", "at"))).alias("mark"))
    both = mark.withColumn("row", F.lit(None).cast(own.schema["row"].dataType)).withColumn("side", F.lit(0)).unionByName(
        own.withColumn("mark", F.lit(None).cast(mark.schema["mark"].dataType)).withColumn("side", F.lit(1)))
    best, order = (F.min, F.desc) if after else (F.max, F.asc)
    run = lambda *by: Window.partitionBy("symbol", *by).rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("mark", best("mark").over(run("slice").orderBy(order("at"), order("side")))).filter("side = 1")
    few = mark.groupBy("symbol", "slice").agg(best("mark").alias("mark")).unionByName(
        own.select("symbol", "slice").distinct().withColumn("mark", F.lit(None).cast(mark.schema["mark"].dataType)))
    handed = few.groupBy("symbol", "slice").agg(best("mark").alias("mark")).select(
        "symbol", "slice", best("mark").over(run().orderBy(order("slice")).rowsBetween(Window.unboundedPreceding, -1)).alias("from_others"))
    return (here.join(handed, ["symbol", "slice"], "left")
            .select("symbol", "at", "row.*", F.coalesce("mark", "from_others").alias("mark")))


def asof_backward(trades: DataFrame, candles: DataFrame, slice_ms: int = SLICE_MS) -> DataFrame:
    """trades (symbol, time, ...) with candle: the last one up to their time, else the first, else the time itself."""
    at = lambda df: df.withColumnRenamed("time", "at")
    first = candles.groupBy("symbol").agg(F.min("time").alias("first"))
    return nearest(at(trades), at(candles.select("symbol", "time")), slice_ms=slice_ms).join(first, "symbol", "left").select(
        *(F.col("at").alias(c) if c == "time" else c for c in trades.columns), F.coalesce("mark.at", "first", "at").alias("candle"))


def next_bar(orders: DataFrame, bars: DataFrame, carry: tuple[str, ...] = (), slice_ms: int = SLICE_MS) -> DataFrame:
    """orders (symbol, ts_ms, ...) with fill_start, the first bar strictly later, and its columns carry; null while there is none."""
    found = nearest(orders.withColumnRenamed("ts_ms", "at"), bars.select("symbol", F.col("bar_start").alias("at"), *carry), True, slice_ms)
    return found.select(*(F.col("at").alias(c) if c == "ts_ms" else c for c in orders.columns), F.col("mark.at").alias("fill_start"), *(F.col(f"mark.{c}") for c in carry))


def align(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Every symbol of the universe at every time; missing bars are flat at the last close, or 1 before the first.

    The grid has times x symbols rows, as the result has. The universe is counted first, and broadcast if it is a list
    of at most UNIVERSE symbols; a larger one meets the times partition by partition.
    """
    symbols = universe.select("symbol").distinct()
    if symbols.limit(UNIVERSE + 1).count() <= UNIVERSE:
        symbols = F.broadcast(symbols)
    grid = bars.select("bar_start").distinct().crossJoin(symbols)
    w = Window.partitionBy("symbol").orderBy("bar_start").rowsBetween(Window.unboundedPreceding, 0)
    own = grid.join(bars.select("symbol", "bar_start", "open", "high", "low", "close", "volume"), ["symbol", "bar_start"], "left")
    known = F.coalesce(F.last("close", ignorenulls=True).over(w), F.lit(1.0))
    return own.withColumn("known", known).select("symbol", "bar_start", *(F.coalesce(c, "known").alias(c) for c in ("open", "high", "low", "close")),
                                                 F.coalesce("volume", F.lit(0.0)).alias("volume"))


def bars_around(trades: DataFrame, bars: DataFrame, around_ms: int) -> DataFrame:
    """Bars within around_ms of a trade: an equi-join on buckets of that size, then the exact test."""
    bucket = F.expr(f"ts_ms div {around_ms}")
    t = trades.withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    b = bars.withColumn("bucket", F.expr(f"bar_start div {around_ms}"))
    return t.join(b, ["symbol", "bucket"]).filter(F.abs(F.col("bar_start") - F.col("ts_ms")) <= around_ms).select("symbol", "seq", "ts_ms", "bar_start", "close")
