"""Rolling features, signals and order sizes; all windows of a call share one exchange and one sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-8


def features(bars: DataFrame, window: int, eps: float = EPS) -> DataFrame:
    """log_return, its rolling mean and deviation, and the z-score of close; 0 or eps before the window is full."""
    w = Window.partitionBy("symbol").orderBy("bar_start")
    r = w.rowsBetween(-(window - 1), 0)
    full = F.count(F.lit(1)).over(r) == window
    ret = F.coalesce(F.ln("close") - F.ln(F.lag("close").over(w)), F.lit(0.0))
    return (bars.withColumn("log_return", ret)
            .withColumn("ret_mean", F.when(full, F.avg("log_return").over(r)).otherwise(0.0))
            .withColumn("ret_std", F.when(full, F.stddev_pop("log_return").over(r)).otherwise(0.0) + eps)
            .withColumn("zscore", F.when(full, (F.col("close") - F.avg("close").over(r)) / (F.stddev_pop("close").over(r) + eps)).otherwise(0.0)))


def features_warm(bars: DataFrame, window: int, eps: float = EPS) -> DataFrame:
    """The same from the second row on, over what there is; the first return does not count."""
    w = Window.partitionBy("symbol").orderBy("bar_start")
    r = w.rowsBetween(-(window - 1), 0)
    some = F.row_number().over(w) > 1
    ret = F.ln("close") - F.ln(F.lag("close").over(w))
    return (bars.withColumn("ret", ret).withColumn("log_return", F.coalesce("ret", F.lit(0.0)))
            .withColumn("ret_mean", F.when(some, F.avg("ret").over(r)).otherwise(0.0))
            .withColumn("ret_std", F.when(some, F.stddev_pop("ret").over(r)).otherwise(0.0) + eps)
            .withColumn("zscore", F.when(some, (F.col("close") - F.avg("close").over(r)) / (F.stddev_pop("close").over(r) + eps)).otherwise(0.0)).drop("ret"))


def sma_signal(bars: DataFrame, fast: int = 5, slow: int = 20) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("bar_start")
    f, s = F.avg("close").over(w.rowsBetween(-(fast - 1), 0)), F.avg("close").over(w.rowsBetween(-(slow - 1), 0))
    return bars.withColumn("signal", F.when(F.row_number().over(w) >= slow, F.when(f > s, 1).otherwise(-1)))


def zscore_signal(feats: DataFrame, window: int) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("bar_start")
    z = F.col("zscore")
    return feats.withColumn("weight", F.when(F.row_number().over(w) > window, F.when(z > 1, 0.5).when(z < -1, -0.5).otherwise(0.0)))


def vol_multiplier(nav: DataFrame, window: int, target: float | None, eps: float = EPS) -> DataFrame:
    w = Window.partitionBy("run_id").orderBy("step")
    ret = nav.withColumn("ret", F.ln("nav") - F.ln(F.lag("nav").over(w)))
    std = F.stddev_pop("ret").over(w.rowsBetween(-(window - 1), 0))
    ok = (F.row_number().over(w) >= 3) & (std > eps) & F.lit(target is not None)
    return ret.withColumn("multiplier", F.when(ok, F.least(F.lit(1.0), F.lit(target or 0.0) / std)).otherwise(1.0)).drop("ret")


def rsi(prices: DataFrame, n: int = 14) -> DataFrame:
    """RSI of each symbol's whole series in closed form: each difference has the weight that Wilder's smoothing leaves it."""
    w = Window.partitionBy("symbol").orderBy("bar_start")
    last = F.count(F.lit(1)).over(Window.partitionBy("symbol")) - 1
    d = prices.select("symbol", (F.row_number().over(w) - 1).alias("i"), (F.col("close") - F.lag("close").over(w)).alias("d"), last.alias("last"))
    age = F.when(F.col("i") < n, F.col("last") - (n - 1)).otherwise(F.col("last") - F.col("i"))
    weight = F.pow(F.lit((n - 1) / n), age) / n
    got = d.groupBy("symbol").agg(F.max("last").alias("last"), F.coalesce(F.sum(weight * F.greatest("d", F.lit(0.0))), F.lit(0.0)).alias("gain"),
                                  F.coalesce(F.sum(weight * F.greatest(-F.col("d"), F.lit(0.0))), F.lit(0.0)).alias("loss"))
    value = F.when(F.col("last") < n - 1, 50.0).when(F.col("loss") == 0, 100.0).otherwise(F.round(100 - 100 / (1 + F.col("gain") / F.col("loss")), 2))
    return got.select("symbol", value.alias("rsi"))


def rsi_band(c):
    return F.when(c > 70, "overbought").when(c < 30, "oversold").otherwise("neutral")


def order_sizing(df: DataFrame, min_qty: int = 5, min_value: float = 100.0) -> DataFrame:
    """Whole shares towards weight * multiplier * nav, from the quantity held; small orders are none."""
    q = F.bround(F.col("weight") * F.col("multiplier") * F.col("nav") / F.col("price")) - F.col("quantity")
    none = (F.abs(q) < min_qty) | (F.abs(q) * F.col("price") < min_value)
    return df.withColumn("order_qty", F.when(F.col("price") <= 0, 0).when(none, 0).otherwise(q).cast("long"))


def target_orders(df: DataFrame, max_position: float | None = None) -> DataFrame:
    goal = F.bround(F.col("weight") * F.col("nav") / F.col("price"))
    if max_position is not None:
        goal = F.greatest(F.lit(-max_position), F.least(F.lit(max_position), goal))
    delta = goal - F.col("quantity")
    return df.withColumn("delta", delta).filter("delta != 0").withColumn("side", F.when(F.col("delta") > 0, "BUY").otherwise("SELL")).withColumn("qty", F.abs("delta").cast("long")).drop("delta")
