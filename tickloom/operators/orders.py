"""Orders: validation, event-log replay, cancels, legality and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.views import partitions
from .folds import fitting

# The status codes and the legal changes of state.
STATUS = ["UNSPECIFIED", "PENDING", "SUBMITTED", "PARTIALLY_FILLED", "FILLED", "CANCELED", "REJECTED", "PENDING_CANCEL"]
LEGAL = [("PENDING", "SUBMITTED"), ("PENDING", "REJECTED"), ("SUBMITTED", "PARTIALLY_FILLED"), ("SUBMITTED", "FILLED"),
         ("SUBMITTED", "PENDING_CANCEL"), ("SUBMITTED", "REJECTED"), ("PARTIALLY_FILLED", "PARTIALLY_FILLED"), ("PARTIALLY_FILLED", "FILLED"),
         ("PARTIALLY_FILLED", "PENDING_CANCEL"), ("PENDING_CANCEL", "CANCELED"), ("PENDING_CANCEL", "FILLED")]
TERMINAL = ["FILLED", "CANCELED", "REJECTED"]


def validate_orders(df: DataFrame) -> DataFrame:
    bad = F.array_compact(F.array(F.when(~F.coalesce(F.col("symbol").rlike("^[A-Z]{1,5}$"), F.lit(False)), "symbol"),
                                  F.when(~F.coalesce(F.col("price") > 0, F.lit(False)), "price"), F.when(~F.coalesce(F.col("quantity") > 0, F.lit(False)), "quantity")))
    return df.withColumn("violations", bad)


def dedup_submits(df: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """The first submit of an order is SUBMITTED; a later one is a retry, answered with the order's state if states
    (order_id, state) are given."""
    first = F.row_number().over(Window.partitionBy("order_id").orderBy("seq")) == 1
    out = df.withColumn("answer", F.when(first, "SUBMITTED").otherwise("IDEMPOTENT_RETRY"))
    if states is None:
        return out
    known = states.select("order_id", F.col("state").alias("current"))
    return out.join(known, "order_id", "left").withColumn("status", F.when(F.col("answer") == "SUBMITTED", "SUBMITTED").otherwise(F.coalesce("current", F.lit("SUBMITTED")))).drop("current")


def replay(events: DataFrame) -> DataFrame:
    """Orders from their events: the first one sets symbol, price and total, and adds no quantity; the last one sets state and correlation."""
    w = Window.partitionBy("order_id").orderBy("event_seq")
    add = F.when((F.col("n") > 1) & F.col("state").isin("PARTIALLY_FILLED", "FILLED"), F.col("delta_qty")).otherwise(0)
    return events.withColumn("n", F.row_number().over(w)).groupBy("order_id").agg(
        *(F.min_by(c, "event_seq").alias(c) for c in ("symbol", "price", "total_qty") if c in events.columns), F.max_by("state", "event_seq").alias("state"),
        *(F.max_by(c, "event_seq").alias(c) for c in ("correlation_id",) if c in events.columns), F.sum(add).alias("cum_qty"))


def cumulative_fills(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("order_id").orderBy("event_seq").rowsBetween(Window.unboundedPreceding, 0)
    cum = F.sum(F.when(F.col("state").isin("PARTIALLY_FILLED", "FILLED"), F.col("delta_qty")).otherwise(0)).over(w)
    return events.withColumn("cum_qty", cum).withColumn("result", F.when(F.col("cum_qty") > F.col("total_qty"), "OVERFILL")
        .when((F.col("state") == "FILLED") & (F.col("cum_qty") < F.col("total_qty")), "UNDERFILLED")
        .when((F.col("cum_qty") == F.col("total_qty")) & (F.col("state") == "PARTIALLY_FILLED"), "FILLED").otherwise(F.col("state")))


def illegal_transitions(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("order_id").orderBy("event_seq")
    legal = events.sparkSession.createDataFrame(LEGAL, "prev string, state string")
    return events.withColumn("prev", F.lag("state").over(w)).filter("prev IS NOT NULL").join(F.broadcast(legal), ["prev", "state"], "left_anti")


def resolve_cancels(requests: DataFrame, states: DataFrame) -> DataFrame:
    s = F.col("state")
    return requests.join(states.select("order_id", "state"), "order_id", "left").select(
        "order_id", F.when(s.isNull(), "REJECTED").when(s.isin(TERMINAL), s).when(s.isin("SUBMITTED", "PARTIALLY_FILLED"), "CANCELED").otherwise("REJECTED").alias("status"),
        F.when(s.isNull(), "ORDER_NOT_FOUND").when(s.isin(TERMINAL), "REJECTED_ALREADY_TERMINAL").when(s.isin("SUBMITTED", "PARTIALLY_FILLED"), "OK").otherwise("ILLEGAL_STATE").alias("reason"))


def decode_status(c):
    """Name of a status code; null for others."""
    return F.get(F.array(*map(F.lit, STATUS)), c.cast("int"))


def encode_status(c):
    """Code of a status name; null for others."""
    return F.nullif(F.array_position(F.array(*map(F.lit, STATUS)), c), F.lit(0)) - 1


def risk_decisions(orders: DataFrame, cap: float, blocked: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """account_id, order_id, the columns keep and the decision on each order (order_id, account_id, seq, symbol, value,
    margin): in order of arrival, only approved ones use the account's margin, which is that of its first order. What
    margin does not decide is decided first and moves nowhere; the rest is sorted by account, whose rows depend on one another: they are
    decided in runs (``folds.fits``), one account in one task. A null symbol is on no list, a null margin is 0, a null account an account."""
    early = (F.when(F.coalesce(F.col("symbol").isin(blocked or []), F.lit(False)), "BLACKLISTED").when(F.col("value").isNull(), "INVALID_ARGUMENTS")
             .when(F.col("value") > cap, "EXCEEDS_MAX_CAP"))
    rows, out = orders.withColumn("early", early), ("account_id", "order_id", *keep)
    carried = [c for c in dict.fromkeys((*out, "seq")) if c not in ("value", "margin")]
    needed = rows.filter("early IS NULL").select(*carried, *(F.col(c).cast("double").alias(c) for c in ("value", "margin")))
    schema = ", ".join(f"{c} {kind}" for c, kind in needed.dtypes) + ", fits boolean"
    checked = (needed.repartition(partitions(orders), "account_id").sortWithinPartitions("account_id", "seq", "order_id")
               .mapInArrow(lambda batches: fitting(batches, "account_id", "value", "margin"), schema)
               .select(*out, F.when(F.col("fits"), "APPROVED").otherwise("INSUFFICIENT_MARGIN").alias("decision")))
    return rows.filter("early IS NOT NULL").select(*out, F.col("early").alias("decision")).unionByName(checked)


def blacklist(feed: DataFrame) -> DataFrame:
    """Symbols whose last ADD:symbol or REMOVE:symbol is an ADD."""
    p = F.split("payload", ":", 2)
    return (feed.select(p[0].alias("op"), F.try_element_at(p, F.lit(2)).alias("symbol"), "seq").filter(F.col("op").isin("ADD", "REMOVE") & F.col("symbol").isNotNull())
            .groupBy("symbol").agg(F.max_by("op", "seq").alias("op")).filter("op = 'ADD'").select("symbol"))
