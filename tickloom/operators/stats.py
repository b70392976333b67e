"""Statistics of bars, trades and services for display; zero counts as missing in prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import minute_of_day, new_york

DAYS = {"1w": 7, "1M": 30, "3M": 90, "1y": 365, "5y": 1825}
# Names of intervals and their seconds; months are calendar months.
SECONDS = {"10s": 10, "15s": 15, "30s": 30, "1m": 60, "2m": 120, "3m": 180, "5m": 300, "10m": 600, "15m": 900, "30m": 1800, "45m": 2700,
           "1h": 3600, "2h": 7200, "3h": 10800, "4h": 14400, "1d": 86400, "1w": 604800}
MONTHS = {"1M": 1, "6M": 6, "12M": 12}
BACK = {"1d": "5 days", "1w": "7 days", "1M": "1 month", "3M": "3 months", "1y": "1 year", "5y": "5 years", "all": "25 years"}


def interval_seconds(name: str, lenient: bool = False) -> int:
    if name in SECONDS:
        return SECONDS[name]
    if lenient:
        return 1800
    raise ValueError(f"no interval of fixed length is named {name}")


def intervals(spark: SparkSession) -> DataFrame:
    """name, seconds (null for calendar months) and months (null for fixed lengths) of every interval."""
    rows = [(k, v, None) for k, v in SECONDS.items()] + [(k, None, v) for k, v in MONTHS.items()]
    return spark.createDataFrame(rows, "name string, seconds long, months int")


def interval_start(ts_ms: Column, name: str, lenient: bool = False) -> Column:
    """Milliseconds of the interval's beginning: multiples of fixed lengths since the epoch; of calendar months since its year began."""
    if name in MONTHS:
        at, n = F.timestamp_millis(ts_ms), MONTHS[name]
        return F.unix_millis(F.make_timestamp(F.year(at), (F.month(at) - 1) - (F.month(at) - 1) % n + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0.0)))
    ms = interval_seconds(name, lenient) * 1000
    return F.floor(ts_ms / ms) * ms


def history_range(bars: DataFrame, granularity: str, now_ms: int) -> DataFrame:
    """Bars that a history request at the given time is for; names without a range of their own get three months."""
    now = F.timestamp_millis(F.lit(now_ms))
    since = F.date_trunc("year", now) if granularity == "ytd" else now - F.expr(f"interval {BACK.get(granularity, '3 months')}")
    return bars.filter((F.col("bar_start") >= F.unix_millis(since)) & (F.col("bar_start") <= now_ms))


def is_daily(granularity: Column, interval: Column) -> Column:
    """Whether a chart shows days or longer; one of minutes by the name 1m counts as that too."""
    return granularity.isin("1M", "3M", "ytd", "1y", "5y", "all") | interval.isin("1d", "1w", "1m")


def some(a, b):
    return F.coalesce(F.nullif(F.col(a), F.lit(0.0)), F.nullif(F.col(b), F.lit(0.0)))


def valid_bars(bars: DataFrame) -> DataFrame:
    return bars.filter(F.col("bar_start").isNotNull() & (some("close", "high") > 0))


def to_line(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", F.col("bar_start").alias("time"), F.col("close").alias("value"))


def timeframe_filter(bars: DataFrame, granularity: str) -> DataFrame:
    """Bars of the last day, so many days, this year, or all, counted from each symbol's latest bar."""
    last = bars.groupBy("symbol").agg(F.max("bar_start").alias("last"))
    both = bars.join(last, "symbol")
    if granularity == "1d":
        keep = F.to_date(new_york(F.col("bar_start"))) == F.to_date(new_york(F.col("last")))
    elif granularity == "ytd":
        keep = F.year(F.timestamp_millis("bar_start")) == F.year(F.timestamp_millis("last"))
    elif granularity in DAYS:
        keep = F.col("bar_start") >= F.col("last") - DAYS[granularity] * 86_400_000
    elif granularity == "all":
        return bars
    else:
        raise ValueError(f"no time frame is named {granularity}")
    return both.filter(keep).drop("last")


def today_stats(bars: DataFrame) -> DataFrame:
    ny = new_york(F.col("bar_start"))
    own = valid_bars(bars).withColumn("date", F.to_date(ny)).withColumn("reg", minute_of_day(ny).between(570, 960))
    last = own.groupBy("symbol").agg(F.max("date").alias("date"))
    own = own.join(last, ["symbol", "date"])
    any_reg = own.groupBy("symbol").agg(F.bool_or("reg").alias("any_reg"))
    low = some("low", "close")
    return own.join(any_reg, "symbol").filter("reg OR NOT any_reg").groupBy("symbol").agg(
        F.min_by(some("open", "close"), "bar_start").alias("open"), F.max(some("high", "close")).alias("high"), F.min(F.when(low > 0, low)).alias("low"))


def session_prices(bars: DataFrame) -> DataFrame:
    reg = minute_of_day(new_york(F.col("bar_start"))).between(570, 960)
    at = F.when(reg, F.col("bar_start"))
    return bars.groupBy("symbol").agg(F.coalesce(F.min_by("open", at), F.min_by("open", "bar_start")).alias("regular_open"),
                                      F.coalesce(F.max_by("close", at), F.max_by("close", "bar_start")).alias("regular_close"),
                                      F.max_by("close", "bar_start").alias("latest"))


def percent(change, base):
    return F.when(base > 0, change / base * 100).otherwise(0.0)


def period_change(bars: DataFrame, granularity: str) -> DataFrame:
    first = timeframe_filter(bars, granularity).groupBy("symbol").agg(F.min_by("open", "bar_start").alias("first"))
    s = session_prices(bars).join(first, "symbol")
    period, close, off = F.col("latest") - F.col("first"), F.col("regular_close") - F.col("regular_open"), F.col("latest") - F.col("regular_close")
    return s.select("symbol", period.alias("change"), percent(period, F.col("first")).alias("change_pct"), close.alias("close_change"),
                    percent(close, F.col("regular_open")).alias("close_pct"), off.alias("off_change"), percent(off, F.col("regular_close")).alias("off_pct"))


def range_52w(bars: DataFrame, bounds: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Highest and lowest price of a symbol's last year, widened by bounds (symbol, bound_high, bound_low) and by the bars on display, if given."""
    low = some("low", "close")
    ends = lambda df, h, l: df.groupBy("symbol").agg(F.max(some("high", "close")).alias(h), F.min(F.when(low > 0, low)).alias(l))  # noqa: E731, E741
    out = ends(timeframe_filter(bars, "1y"), "h", "l").join(bounds, "symbol", "left")
    shown = out.join(ends(valid_bars(current), "ch", "cl"), "symbol", "left") if current is not None else out.withColumns({"ch": F.lit(None).cast("double"), "cl": F.lit(None).cast("double")})
    return shown.select("symbol", F.round(F.greatest("h", "bound_high", "ch"), 2).alias("high_52w"), F.round(F.least("l", "bound_low", "cl"), 2).alias("low_52w"))


def watchlist(bars: DataFrame) -> DataFrame:
    g = bars.groupBy("symbol").agg(F.max_by("close", "bar_start").alias("latest"), F.min_by("open", "bar_start").alias("first"))
    return g.select("symbol", "latest", "first", (F.col("latest") - F.col("first")).alias("change"), percent(F.col("latest") - F.col("first"), F.col("first")).alias("change_pct"))


def off_hours(bars: DataFrame) -> DataFrame:
    """Each NY day's regular close and the day's last price after it."""
    ny = new_york(F.col("bar_start"))
    m = minute_of_day(ny)
    g = bars.groupBy("symbol", F.to_date(ny).alias("date")).agg(F.max_by("close", F.when(m.between(570, 960), F.col("bar_start"))).alias("regular_close"),
                                                                F.max_by("close", "bar_start").alias("latest"))
    return g.filter("regular_close IS NOT NULL").withColumn("off_change", F.col("latest") - F.col("regular_close"))


def trade_markers(trades: DataFrame) -> DataFrame:
    """Trades (symbol, candle, action, price, qty) of a candle and action as one marker."""
    q = F.when(F.col("qty") > 0, F.col("qty")).otherwise(100.0)
    g = trades.withColumn("q", q).groupBy("symbol", "candle", "action").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("qty"), (F.sum(F.col("price") * F.col("q")) / F.sum("q")).alias("vwap"))
    side = F.substring("action", 1, 1)
    text = F.when(F.col("n") > 1, F.format_string("%s %dx (%d@%.2f)", side, F.col("n"), F.col("qty").cast("long"), F.col("vwap"))).otherwise(
        F.format_string("%s %d@%.2f", side, F.col("qty").cast("long"), F.col("vwap")))
    return g.withColumn("text", text).withColumn("size", F.when(F.col("n") > 1, 1.2).otherwise(1.0))


def latest_trades(trades: DataFrame, n: int = 1000) -> DataFrame:
    return trades.orderBy(F.desc("seq")).limit(n)


def latest_trade(trades: DataFrame, oldest: bool = False) -> DataFrame:
    pick = F.min_by if oldest else F.max_by
    rest = [c for c in trades.columns if c != "symbol"]
    return trades.groupBy("symbol").agg(pick(F.struct(*rest), "seq").alias("x")).select("symbol", "x.*")


def status_changes(log: DataFrame) -> DataFrame:
    w = Window.partitionBy("service").orderBy("ts_ms", "seq")
    return log.withColumn("before", F.lag("status").over(w)).filter(~F.col("before").eqNullSafe(F.col("status"))).drop("before")


def system_health(log: DataFrame, needed: list[str]) -> DataFrame:
    last = log.groupBy("service").agg(F.max_by("status", F.struct("ts_ms", "seq")).alias("status"))
    return last.agg(F.when(F.count_if(F.col("service").isin(needed) & (F.col("status") == "SERVING")) == len(needed), "HEALTHY").otherwise("DEGRADED").alias("health"))


def control_state(events: DataFrame, fields: list[str]) -> DataFrame:
    """Last value of each field of a control log (seq, field, value); an empty url keeps the one before."""
    own = lambda f: F.when((F.col("field") == f) & ((F.col("value") != "") | F.lit(f != "url")), F.col("seq"))
    return events.agg(*[F.max_by("value", own(f)).alias(f) for f in fields])


def normalise_symbol(df: DataFrame) -> DataFrame:
    """Symbols trimmed and in capitals; empty ones go."""
    return df.withColumn("symbol", F.upper(F.trim("symbol"))).filter("symbol != ''")


def with_order_value(df: DataFrame) -> DataFrame:
    return df.withColumn("order_value", F.col("price") * F.col("quantity"))


def tickers_add(tickers: DataFrame, more: DataFrame) -> DataFrame:
    return tickers.unionByName(more).dropDuplicates()


def tickers_remove(tickers: DataFrame, less: DataFrame) -> DataFrame:
    return tickers.join(less, "symbol", "left_anti")
