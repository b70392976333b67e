"""Universes of many symbols aligned by time, batch after batch, with all work spread by symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import Files, named_once

BAR = ["open", "high", "low", "close", "volume"]
WAITING = "universe string, symbol string, bar_start long, open double, high double, low double, close double, volume double, number long"


def released(waiting: DataFrame, sizes: DataFrame) -> DataFrame:
    """universe, bar_start of the times that all symbols have reached, or that a later one has followed; times by universe are counted, no symbol's rows meet."""
    times = waiting.groupBy("universe", "bar_start").agg(F.count_distinct("symbol").alias("n")).join(sizes, "universe")
    later = F.max("bar_start").over(Window.partitionBy("universe"))
    return times.withColumn("later", later).filter("n >= size OR bar_start < later").select("universe", "bar_start")


def aligned(bars: DataFrame, closes: DataFrame, times: DataFrame, symbols: DataFrame) -> DataFrame:
    """A row for each released time and symbol of its universe: its bar, or a flat one at its last close before, or at 1 if there is none.

    The grid of times and symbols is the result itself; it is made per symbol, so a universe's symbols are spread over the tasks.
    """
    listed = times.groupBy("universe").agg(F.array_sort(F.collect_set("bar_start")).alias("times"))  # of this batch
    grid = symbols.join(listed, "universe").select("universe", "symbol", F.explode("times").alias("bar_start"))
    own = grid.join(bars, ["universe", "symbol", "bar_start"], "left").join(closes.select("universe", "symbol", F.col("close").alias("before")), ["universe", "symbol"], "left")
    known = F.coalesce(F.last("close", ignorenulls=True).over(Window.partitionBy("universe", "symbol").orderBy("bar_start")), "before", F.lit(1.0))
    return own.withColumn("known", known).select("universe", "symbol", "bar_start", *(F.coalesce(c, "known").alias(c) for c in BAR[:4]), F.coalesce("volume", F.lit(0.0)).alias("volume"))


def start_barrier(bars: DataFrame, symbols: DataFrame, path: str, checkpoint: str, once: bool = False, every: str = "10 seconds"):
    """All of a universe's symbols at a time, once every one has come or a later time has begun, to path/aligned.

    bars has universe, symbol, bar_start, prices and volume; symbols (universe, symbol) is read again for each batch, repeated rows count once.
    Bars of symbols that are not in it are passed over, so are those of a time that has gone out; of repeated bars of a symbol and time the first batch's counts, and in it the highest close.
    What waits, each symbol's last close and the last time that went out are tables of the batch before, so a batch that is tried again gives the same.
    A last time that lacks symbols waits until a later one comes.
    """
    spark = bars.sparkSession
    run, commits, states = named_once(spark, checkpoint), Files(spark, f"{path}/commits"), f"{checkpoint}/tables"
    read = lambda name, number, schema: spark.read.schema(schema).parquet(f"{states}/{name}/{number}") if number >= 0 else spark.createDataFrame([], schema)

    def write(batch: DataFrame, number: int) -> None:
        universe = symbols.select("universe", "symbol").distinct()
        sizes = universe.groupBy("universe").agg(F.count("*").alias("size"))
        passed = read("passed", number - 1, "universe string, gone long")
        new = (batch.select("universe", "symbol", "bar_start", *BAR).join(universe, ["universe", "symbol"], "left_semi").join(passed, "universe", "left")
               .filter("gone IS NULL OR bar_start > gone").drop("gone").withColumn("number", F.lit(number).cast("long")))
        every_one = read("waiting", number - 1, WAITING).unionByName(new)
        first = Window.partitionBy("universe", "symbol", "bar_start").orderBy("number", F.desc("close"), *BAR)
        every_one = every_one.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
        every_one.write.mode("overwrite").parquet(f"{states}/all/{number}")
        every_one = read("all", number, WAITING)
        released(every_one, sizes).write.mode("overwrite").parquet(f"{states}/times/{number}")
        times = read("times", number, "universe string, bar_start long")
        out, closes = every_one.join(times, ["universe", "bar_start"], "left_semi"), read("closes", number - 1, "universe string, symbol string, close double")
        aligned(out.drop("number"), closes, times, universe).write.mode("overwrite").parquet(f"{path}/aligned/run={run}/batch_id={number}")
        last = out.groupBy("universe", "symbol").agg(F.max_by("close", "bar_start").alias("now"))
        closes.join(last, ["universe", "symbol"], "full").select("universe", "symbol", F.coalesce("now", "close").alias("close")).write.mode("overwrite").parquet(f"{states}/closes/{number}")
        every_one.join(times, ["universe", "bar_start"], "left_anti").write.mode("overwrite").parquet(f"{states}/waiting/{number}")
        passed.unionByName(times.select("universe", F.col("bar_start").alias("gone"))).groupBy("universe").agg(F.max("gone").alias("gone")).write.mode("overwrite").parquet(f"{states}/passed/{number}")
        commits.write(f"{run}-{number:012d}.json", {"run": run, "batch_id": number})
        old = Files(spark, states)
        for name in ("all", "times", "closes", "waiting", "passed"):  # the batch before is still needed if this one is tried again
            old.fs.delete(old.path(f"{name}/{number - 2}"), True)

    w = bars.writeStream.option("checkpointLocation", f"{checkpoint}/stream").foreachBatch(write)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()
