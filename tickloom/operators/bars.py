"""OHLCV bars from ticks, and what is done to bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LATE_MS = 100
SLICE_ROWS = 1 << 20  # of a symbol's ticks that are sorted together


def ohlcv(ticks: DataFrame, window_ms: int = 60_000, close_by_arrival: bool = False) -> DataFrame:
    """Open is the first to arrive; close has the latest time (or, if asked for, is the last to arrive)."""
    last = F.col("seq") if close_by_arrival else F.struct("ts_ms", "seq")
    return ticks.groupBy("symbol", F.expr(f"ts_ms - ts_ms % {window_ms}").alias("bar_start")).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", last).alias("close"), F.sum("size").alias("volume"))


def resample(bars: DataFrame, window_ms: int) -> DataFrame:
    return bars.groupBy("symbol", F.expr(f"bar_start - bar_start % {window_ms}").alias("start")).agg(
        F.min_by("open", "bar_start").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "bar_start").alias("close"), F.sum("volume").alias("volume")).withColumnRenamed("start", "bar_start")


def with_windows(ticks: DataFrame, window_ms: int, slice_rows: int) -> DataFrame:
    """ticks with win, the start of their window; cur, the latest win that came before; and slice, top and before.

    A symbol's ticks are sorted in slices of slice_rows by their number of arrival. Each slice hands on the latest of its
    windows and the one before that, and these few rows are put in order, so that one busy symbol is many tasks: top is
    the latest window of earlier slices, before the one that was the latest until top came.
    """
    own = (ticks.withColumn("win", F.expr(f"ts_ms - ts_ms % {window_ms}")).withColumn("slice", F.floor(F.col("seq") / slice_rows))
           .withColumn("own", F.max("win").over(in_slice(-1))))
    few = own.groupBy("symbol", "slice").agg(F.max("win").alias("last"), F.max(F.when(F.col("own").isNull() | (F.col("win") > F.col("own")), F.col("own"))).alias("second"))
    earlier = Window.partitionBy("symbol").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    handed = (few.withColumn("top", F.max("last").over(earlier))
              .withColumn("left", F.when(F.col("top").isNull(), F.col("second")).when(F.col("last") > F.col("top"), F.greatest("second", "top")))
              .select("symbol", "slice", "top", F.max("left").over(earlier).alias("before")))
    return own.join(handed, ["symbol", "slice"]).withColumn("cur", F.greatest("own", "top")).drop("own")


def in_slice(last: int):
    """A slice's rows up to the one before (-1) or the own one (0)."""
    return Window.partitionBy("symbol", "slice").orderBy("seq").rowsBetween(Window.unboundedPreceding, last)


def audit(ticks: DataFrame, window_ms: int = 60_000, late_ms: int = LATE_MS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """kind of each tick in order of arrival: ROLL opens a bar, ON_TIME joins it, LATE_ACCEPTED corrects the one before it."""
    prev = F.greatest(F.max(F.when(F.col("roll"), F.col("cur"))).over(in_slice(0)), F.col("before"))
    kind = (F.when(F.col("roll"), "ROLL").when(F.col("win") == F.col("cur"), "ON_TIME")
            .when((F.col("ts_ms") >= F.col("cur") - late_ms) & F.col("win").eqNullSafe(F.col("prev")), "LATE_ACCEPTED").otherwise("LATE_DROPPED"))
    return (with_windows(ticks, window_ms, slice_rows).withColumn("roll", F.col("cur").isNull() | (F.col("win") > F.col("cur"))).withColumn("prev", prev)
            .select(*ticks.columns, kind.alias("kind")))


def live_bars(ticks: DataFrame, window_ms: int = 60_000, late_ms: int = LATE_MS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    return ohlcv(audit(ticks, window_ms, late_ms, slice_rows).filter("kind != 'LATE_DROPPED'"), window_ms)


def live_candles(ticks: DataFrame, window_ms: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Ticks older than the last candle are dropped; close is the last to arrive."""
    kept = with_windows(ticks, window_ms, slice_rows).filter("cur IS NULL OR win >= cur").select(*ticks.columns)
    return ohlcv(kept, window_ms, close_by_arrival=True)


def latest_bars(bars: DataFrame) -> DataFrame:
    """Of re-published bars, the newest version."""
    rest = [c for c in bars.columns if c not in ("symbol", "bar_start")]
    return bars.groupBy("symbol", "bar_start").agg(F.max_by(F.struct(*rest), "version").alias("x")).select("symbol", "bar_start", "x.*")


def gap_fill(bars: DataFrame, interval: int, max_gap: int = 43_200_000, most: int = 50) -> DataFrame:
    """Flat bars between bars that are further apart than the interval but at most max_gap."""
    w = Window.partitionBy("symbol").orderBy("bar_start")
    gap = F.lead("bar_start").over(w) - F.col("bar_start")
    fill = bars.withColumn("gap", gap).filter((F.col("gap") > interval) & (F.col("gap") <= max_gap))
    steps = F.sequence(F.lit(1).cast("long"), F.least(F.lit(most).cast("long"), F.expr(f"(gap - 1) div {interval}")))
    fill = fill.withColumn("i", F.explode(steps)).select("symbol", (F.col("bar_start") + F.col("i") * interval).alias("bar_start"), *(F.col("close").alias(c) for c in ("open", "high", "low", "close")),
                       F.lit(0.0).alias("volume"))
    return bars.select("symbol", "bar_start", "open", "high", "low", "close", "volume").withColumn("filled", F.lit(False)).unionByName(fill.withColumn("filled", F.lit(True)))


def fill_to_now(bars: DataFrame, interval: int, now_ms: int, max_gap: int = 64_800_000, most: int = 120) -> DataFrame:
    """Flat bars behind each symbol's last bar, up to the interval that now is in (which gets none), if that is at most max_gap later."""
    now = now_ms - now_ms % interval
    last = bars.groupBy("symbol").agg(F.max("bar_start").alias("last"), F.max_by("close", "bar_start").alias("close")).withColumn("gap", F.lit(now) - F.col("last"))
    steps = F.sequence(F.lit(1).cast("long"), F.least(F.lit(most).cast("long"), F.expr(f"(gap - 1) div {interval}")))
    fill = last.filter((F.col("gap") > interval) & (F.col("gap") <= max_gap)).withColumn("i", F.explode(steps))
    fill = fill.select("symbol", (F.col("last") + F.col("i") * interval).alias("bar_start"), *(F.col("close").alias(c) for c in ("open", "high", "low", "close")), F.lit(0.0).alias("volume"))
    return bars.select(*fill.columns).withColumn("filled", F.lit(False)).unionByName(fill.withColumn("filled", F.lit(True)))


def last_n(bars: DataFrame, n: int = 500, time: str = "bar_start") -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc(time))
    return bars.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")


def first_source(*sources: DataFrame) -> DataFrame:
    """For each symbol the rows of the first source that has any."""
    all_rows = None
    for i, df in enumerate(sources):
        own = df.withColumn("priority", F.lit(i))
        all_rows = own if all_rows is None else all_rows.unionByName(own)
    best = all_rows.groupBy("symbol").agg(F.min("priority").alias("priority"))
    return all_rows.join(best, ["symbol", "priority"])


def newest_asc(bars: DataFrame, n: int = 1000, time: str = "bar_start") -> DataFrame:
    """The newest n bars of each symbol, oldest first."""
    return last_n(bars, n, time).orderBy("symbol", time)


def one_table(**kinds: DataFrame) -> DataFrame:
    """Bars, fillers and corrections in one table with a column kind; columns that one lacks are null."""
    out = None
    for kind, df in kinds.items():
        own = df.withColumn("kind", F.lit(kind))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
