"""Fills, ledgers, NAV and performance, and sweeps of strategies whose orders do not depend on NAV."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import nearest, next_bar
from .prefix import running_sums

YEAR = 252 * 390
SLICE_MS = 86_400_000  # of a run, whose rows are summed together


def fill_costs(orders: DataFrame, bars: DataFrame, gamma: float = 0.1, rate: float = 0.0001, flat: float = 1.0) -> DataFrame:
    """Orders (symbol, ts_ms, side, qty, ...) at their symbol's next bar: slippage grows with the share of its volume.

    Each order is a row of its own, whatever its id; one without a later bar is not filled.
    """
    slip = F.when(F.col("volume") > 0, gamma * F.col("qty") / F.col("volume")).otherwise(0.0)
    price = F.col("close") * F.when(F.col("side") == "BUY", 1 + slip).otherwise(1 - slip)
    return (next_bar(orders, bars, ("close", "volume")).filter("fill_start IS NOT NULL").withColumn("exec_price", price)
            .withColumn("commission", F.col("qty") * F.col("exec_price") * rate + flat))


def positions(fills: DataFrame) -> DataFrame:
    return fills.groupBy("run_id", "symbol").agg(F.sum(F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))).alias("net")).filter("net != 0")


def live_fill_costs(orders: DataFrame, bars: DataFrame, gamma: float = 0.1, rate: float = 0.0001, volume: float = 100_000.0) -> DataFrame:
    """Orders (symbol, ts_ms, side, qty, price, status, ...) at the last close of their symbol up to their time, or at their own price before its first bar.

    Slippage is by a fixed volume, and there is no flat fee. Canceled orders, and those whose price is missing or not above 0, are not filled; a side in any case
    that is not BUY sells.
    """
    marks = bars.select("symbol", F.col("bar_start").alias("at"), "close")
    found = nearest(orders.filter("status IS NULL OR status <> 'CANCELLED'").withColumnRenamed("ts_ms", "at"), marks).withColumnRenamed("at", "ts_ms")
    base, slip = F.coalesce("mark.close", "price"), gamma * F.col("qty") / volume
    price = base * F.when(F.upper("side") == "BUY", 1 + slip).otherwise(1 - slip)
    return (found.withColumn("base", base).filter("base > 0").withColumn("exec_price", price).withColumn("commission", F.col("qty") * F.col("exec_price") * rate)
            .select(*orders.columns, "exec_price", "commission"))


def cash_ledger(fills: DataFrame, initial: float, order: list[str], slice_ms: int = SLICE_MS) -> DataFrame:
    """order begins with ts_ms; a run's fills are summed in slices of time."""
    cost = F.col("qty") * F.col("exec_price")
    flow = F.when(F.col("side") == "BUY", -(cost + F.col("commission"))).otherwise(cost - F.col("commission"))
    return running_sums(fills, ["run_id"], "ts_ms", order, {"cash": flow}, slice_ms).withColumn("cash", F.col("cash") + initial)


def nav_series(bars: DataFrame, fills: DataFrame, initial: float, slice_ms: int = SLICE_MS) -> DataFrame:
    """Cash and positions at every time of a bar or fill of the run's symbols; a fill's price is the mark after its bar's
    close, until the next bar. Bars meet the (run, symbol) pairs that have fills, as other symbols do not change a NAV."""
    cost = F.col("qty") * F.col("exec_price")
    flow = F.when(F.col("side") == "BUY", -(cost + F.col("commission"))).otherwise(cost - F.col("commission"))
    signed = F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty")).cast("double")
    marks = bars.join(fills.select("run_id", "symbol").distinct(), "symbol").select("run_id", "symbol", F.col("bar_start").alias("ts_ms"), F.lit(0).cast("long").alias("rank"), F.col("close").alias("mark"),
                                   F.lit(0.0).alias("q"), F.lit(0.0).alias("flow"))
    events = marks.unionByName(fills.select("run_id", "symbol", F.col("fill_start").alias("ts_ms"), (F.col("order_id") + 1).cast("long").alias("rank"),
                                            F.col("exec_price").alias("mark"), signed.alias("q"), flow.alias("flow")))
    step = events.groupBy("run_id", "symbol", "ts_ms").agg(F.max_by("mark", "rank").alias("mark"), F.sum("q").alias("q"), F.sum("flow").alias("flow"))
    w = Window.partitionBy("run_id", "symbol").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
    value = F.sum("q").over(w) * F.col("mark") + F.sum("flow").over(w)
    change = step.withColumn("value", value).withColumn("gain", F.col("value") - F.coalesce(F.lag("value").over(Window.partitionBy("run_id", "symbol").orderBy("ts_ms")), F.lit(0.0)))
    times = change.groupBy("run_id", "ts_ms").agg(F.sum("gain").alias("gain"))
    return running_sums(times, ["run_id"], "ts_ms", ["ts_ms"], {"nav": F.col("gain")}, slice_ms).withColumn("nav", F.col("nav") + initial).drop("gain")


def nav_returns(nav: DataFrame) -> DataFrame:
    before = F.lag("nav").over(Window.partitionBy("run_id").orderBy("step"))
    return nav.withColumn("before", before).withColumn("ret", F.when(F.col("before") > 0, (F.col("nav") - F.col("before")) / F.col("before"))
                                                       .when(F.col("before").isNotNull(), 0.0)).drop("before")


def drawdown(nav: DataFrame) -> DataFrame:
    peak = F.max("nav").over(Window.partitionBy("run_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return nav.withColumn("peak", peak).withColumn("drawdown", F.when(F.col("peak") > 0, (F.col("peak") - F.col("nav")) / F.col("peak")).otherwise(0.0))


def performance_metrics(nav: DataFrame) -> DataFrame:
    """Per run, from NAVs that begin with the initial capital."""
    r = drawdown(nav_returns(nav)).groupBy("run_id").agg(
        (F.max_by("nav", "step") - F.min_by("nav", "step")).alias("final_pnl"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"),
        F.sqrt(F.try_divide(F.sum(F.pow(F.least("ret", F.lit(0.0)), F.lit(2.0))), F.count("ret") - 1)).alias("dd"), F.count("ret").alias("n"), F.max("drawdown").alias("max_drawdown"))
    ratio = lambda by: F.when((F.col("n") > 1) & (F.col(by) > 0), F.col("m") / F.col(by) * F.sqrt(F.lit(float(YEAR)))).otherwise(0.0)
    return r.select("run_id", "final_pnl", ratio("sd").alias("sharpe"), ratio("dd").alias("sortino"), "max_drawdown")


def transaction_costs(fills: DataFrame) -> DataFrame:
    """fills with close of the bar they were made at."""
    return fills.groupBy("run_id", "symbol").agg(F.sum("commission").alias("commission"), F.sum(F.abs(F.col("exec_price") - F.col("close")) * F.col("qty")).alias("slippage"),
                                                 F.sum(F.col("qty") * F.col("exec_price")).alias("turnover"))


def step_reward(nav: DataFrame, lam: float) -> DataFrame:
    """nav (run_id, step, nav, turnover, commission)."""
    before = F.lag("nav").over(Window.partitionBy("run_id").orderBy("step"))
    gain = F.when((F.col("nav") > 0) & (F.col("before") > 0), F.ln(F.col("nav") / F.col("before"))).otherwise(0.0)
    return nav.withColumn("before", before).filter("before IS NOT NULL").withColumn(
        "reward", gain - lam * F.col("turnover") / F.col("nav") - F.col("commission") / F.col("nav")).drop("before")


def signal_orders(signals: DataFrame, qty: float) -> DataFrame:
    """Orders (run_id, symbol, order_id, ts_ms, side, qty) of a strategy that holds qty or -qty as its signal (1, -1 or
    null) says: one where the signal changes, of qty from nothing and of twice as much to the other side."""
    w = Window.partitionBy("run_id", "symbol").orderBy("bar_start")
    before = F.coalesce(F.lag("signal").over(w), F.lit(0))
    step = (F.col("signal") - F.col("before")) * F.lit(qty)
    return (signals.filter("signal IS NOT NULL").withColumn("before", before).filter("signal != before")
            .select("run_id", "symbol", F.col("bar_start").alias("order_id"), F.col("bar_start").alias("ts_ms"),
                    F.when(step > 0, "BUY").otherwise("SELL").alias("side"), F.abs(step).alias("qty")))


def sma_sweep(bars: DataFrame, params: list[tuple[int, int]], qty: float, initial: float) -> DataFrame:
    """Performance of a moving-average crossover of fixed size for each (fast, slow) and symbol, a run each; all runs side by side in one plan.

    Orders fill at the next bar with its costs, and NAV begins with the initial capital. A run that never trades has no row.
    """
    w = Window.partitionBy("symbol").orderBy("bar_start")
    mean = lambda n: F.avg("close").over(w.rowsBetween(-(n - 1), 0))
    signals = [F.struct(F.concat_ws(":", "symbol", F.lit(f"{a}-{b}")).alias("run_id"),
                        F.when(F.row_number().over(w) >= b, F.when(mean(a) > mean(b), 1).otherwise(-1)).alias("signal")) for a, b in params]
    runs = bars.select("symbol", "bar_start", F.array(*signals).alias("all")).select("symbol", "bar_start", F.inline("all"))
    fills = fill_costs(signal_orders(runs, qty), bars)
    nav = nav_series(bars, fills, initial)
    steps = nav.withColumn("step", F.row_number().over(Window.partitionBy("run_id").orderBy("ts_ms"))).select("run_id", "step", "nav")
    start = steps.select("run_id").distinct().select("run_id", F.lit(0).alias("step"), F.lit(initial).alias("nav"))
    return performance_metrics(start.unionByName(steps))
