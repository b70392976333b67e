"""Tables, archives and micro-batch recording."""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.bars import latest_bars


def create_tables(spark: SparkSession, db: str, location: str | None = None) -> None:
    """Tables for ticks and bars, a folder for each date, if they are not there; below location, or where the catalog puts them."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}" + (f" LOCATION '{location}'" if location else ""))
    spark.sql(f"CREATE TABLE IF NOT EXISTS {db}.ticks (symbol STRING, price DOUBLE, size DOUBLE, ts_ms BIGINT, seq BIGINT, date STRING) "
              "USING parquet PARTITIONED BY (date)")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {db}.bars (symbol STRING, bar_start BIGINT, window_s BIGINT, open DOUBLE, high DOUBLE, low DOUBLE, "
              "close DOUBLE, volume DOUBLE, version INT, date STRING) USING parquet PARTITIONED BY (date)")


def archive_day(bars: DataFrame, date: str, path: str) -> None:
    """Bars of the UTC day YYYYMMDD to date=.../symbol=..., in place of what that day had there."""
    start = int(datetime.datetime.strptime(date, "%Y%m%d").replace(tzinfo=datetime.UTC).timestamp() * 1000)
    day = bars.filter((F.col("timestamp") >= start) & (F.col("timestamp") < start + 86_400_000))
    (day.select("timestamp", "open", "high", "low", "close", "volume", F.lit(date).alias("date"), "symbol").repartition("symbol")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "symbol").parquet(path))


class Files:
    """Small files in any store that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder.rstrip("/")
        self.fs = self.path().getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path())

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def read(self, name: str) -> dict | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def write(self, name: str, content: dict) -> None:
        """The file is there whole or not at all: it is written under a hidden name and then renamed."""
        hidden = self.path(f".{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(hidden, True)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        self.fs.delete(self.path(name), False)
        self.fs.rename(hidden, self.path(name))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path()) if not s.getPath().getName().startswith("."))


def named_once(spark: SparkSession, checkpoint: str) -> str:
    """A name that belongs to a checkpoint: a stream that goes on from it has the same one, one with a new checkpoint another."""
    files = Files(spark, f"{checkpoint.rstrip('/')}/name")
    if (known := files.read("name.json")) is None:
        files.write("name.json", known := {"name": uuid.uuid4().hex})
    return known["name"]


def start_recorder(ticks: DataFrame, bars: DataFrame | None, path: str, checkpoint: str, once: bool = False, every: str = "10 seconds"):
    """A stream of ticks, or of ticks and bars together, to path/ticks and path/bars: a batch each ten seconds.

    All rows of a batch are recorded, or none: both outputs are written to folders of the batch, and then one small file in path/commits makes
    both visible to ``recorded``. A batch that is tried again overwrites its own folders, so it neither loses nor doubles rows. Folders bear the name of the
    checkpoint, so that a stream with a new checkpoint leaves what older ones recorded. How many rows a batch has at most is set
    where the streams are read (maxFilesPerTrigger and the like); with once, all that is there is drained.
    """
    spark = ticks.sparkSession
    run, commits = named_once(spark, checkpoint), Files(spark, f"{path}/commits")
    both = ticks.select(F.lit("ticks").alias("kind"), F.struct(*ticks.columns).alias("ticks"))
    if bars is not None:
        both = both.unionByName(bars.select(F.lit("bars").alias("kind"), F.struct(*bars.columns).alias("bars")), allowMissingColumns=True)

    def write(batch: DataFrame, number: int) -> None:
        for kind in batch.columns[1:]:
            batch.filter(F.col("kind") == kind).select(f"{kind}.*").write.mode("overwrite").parquet(f"{path}/{kind}/run={run}/batch_id={number}")
        commits.write(f"{run}-{number:012d}.json", {"run": run, "batch_id": number})

    w = both.writeStream.option("checkpointLocation", f"{checkpoint}/stream").foreachBatch(write)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def recorded(spark: SparkSession, path: str, kind: str, schema: StructType) -> DataFrame:
    """The rows of all batches that are recorded whole, with run and batch_id; other folders are not read."""
    Files(spark, f"{path}/{kind}")
    done = spark.read.schema("run string, batch_id long").json(f"{path}/commits")
    rows = spark.read.schema(StructType([*schema.fields, *StructType.fromDDL("run string, batch_id long").fields])).parquet(f"{path}/{kind}")
    return rows.join(done, ["run", "batch_id"], "left_semi")


def upsert_bars(corrections: DataFrame, path: str, number: int) -> bool:
    """Corrected and new bars (bars' columns with version) into an archive by date and symbol, the newest version of each staying.

    Only the (date, symbol) folders of the corrections are read and written again. number is that of the batch: once it has gone in, it does
    nothing when it comes again, and one that broke off half way gives the same when it is tried again. Says whether it did something.
    """
    spark = corrections.sparkSession
    done = Files(spark, f"{path}/commits")
    if done.read(f"{number:012d}.json") is not None:
        return False
    kept = ["symbol", "bar_start", "open", "high", "low", "close", "volume", "version"]
    new = corrections.select(*kept).withColumn("date", F.date_format(F.timestamp_millis("bar_start"), "yyyyMMdd"))
    Files(spark, f"{path}/bars")
    old = archived(spark, path).join(new.select("date", "symbol").distinct(), ["date", "symbol"], "left_semi")
    both = latest_bars(old.unionByName(new))
    (both.repartition("date", "symbol").sortWithinPartitions("date", "symbol", "bar_start").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("date", "symbol").parquet(f"{path}/bars"))
    done.write(f"{number:012d}.json", {"batch": number})
    return True


def archived(spark: SparkSession, path: str) -> DataFrame:
    """The archive that ``upsert_bars`` keeps."""
    return spark.read.schema("bar_start long, open double, high double, low double, close double, volume double, version int, date string, symbol string").parquet(f"{path}/bars")


def publish_list(rows: DataFrame, path: str) -> int:
    """A list (of tickers, of blocked symbols) as the newest version below path; older versions stay. Gives its number."""
    files = Files(rows.sparkSession, f"{path}/versions")
    number = len(files.names())
    rows.write.mode("overwrite").parquet(f"{path}/lists/{number:012d}")
    files.write(f"{number:012d}.json", {"version": number})
    return number


def start_listed(ticks: DataFrame, lists: str, path: str, checkpoint: str, once: bool = False, every: str = "10 seconds"):
    """Ticks whose symbol is on the list (symbol) that was the newest when their batch began, to path, with the version.

    Which version a batch sees is written down before its rows are: a batch that is tried again sees the same list, whatever has been published since.
    """
    spark = ticks.sparkSession
    run, versions = named_once(spark, checkpoint), Files(spark, f"{lists}/versions")
    seen, commits = Files(spark, f"{checkpoint}/lists"), Files(spark, f"{path}/commits")

    def write(batch: DataFrame, number: int) -> None:
        if (known := seen.read(f"{number:012d}.json")) is None:
            seen.write(f"{number:012d}.json", known := {"version": len(versions.names()) - 1})
        listed = spark.read.schema("symbol string").parquet(f"{lists}/lists/{known['version']:012d}").distinct()
        (batch.join(listed, "symbol", "left_semi").withColumn("version", F.lit(known["version"])).select(*ticks.columns, "version")
         .write.mode("overwrite").parquet(f"{path}/listed/run={run}/batch_id={number}"))
        commits.write(f"{run}-{number:012d}.json", {"run": run, "batch_id": number})

    w = ticks.writeStream.option("checkpointLocation", f"{checkpoint}/stream").foreachBatch(write)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", partitions: int | None = None) -> DataFrame:
    """All that a stream sends until its source is drained, from Parquet, with batch_id. A new checkpoint's state has so many partitions, or the session's."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    spark, own = stream.sparkSession, {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if partitions:
        own["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, value in own.items():
            spark.conf.set(k, value)
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        for k, value in before.items():
            spark.conf.set(k, value) if value else spark.conf.unset(k)
    return spark.read.schema(stream.schema.add("batch_id", "long")).parquet(path)
