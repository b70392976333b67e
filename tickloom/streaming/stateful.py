"""Streams with state of a symbol, an order or a universe: candles, lines, features, order states, barriers and risk."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import fmean, pstdev

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

from ..operators import chains
from ..operators.features import EPS
from ..operators.folds import fits_one
from ..operators.orders import LEGAL, STATUS, TERMINAL
from .ordered import LEAST, Ordered, by_window, fold_ordered

PRICES = ["open", "high", "low", "close", "volume"]
RESULTS = ["ACCEPTED", "UNDERFILLED", "OVERFILL", "ILLEGAL"]
PARTIAL, FULL = STATUS.index("PARTIALLY_FILLED"), STATUS.index("FILLED")
MAY = np.array([[(was, now) in LEGAL for now in STATUS] for was in STATUS])


class Fold(StatefulProcessor):
    """A key's state is a short list of rows. A batch's rows are folded in their order; of
    the rows that a step sends under the same name, the last of the batch goes out."""

    state = ""
    order: tuple[str, ...] = ("seq",)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", self.state)

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        state, out = [tuple(r) for r in self.kept.get()], {}
        for r in sorted(rows, key=lambda r: tuple(r[c] for c in self.order)):
            state = self.step(key, state, r, out)
        if state:
            self.kept.put(state)
        yield from out.values()

    def step(self, key, state: list[tuple], r: Row, out: dict) -> list[tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Candles(Ordered):
    """The state is the last candle, and the starts of the candles that are kept, oldest first."""

    def __init__(self, interval: int, max_gap: int, most: int, keep: int):
        self.interval, self.max_gap, self.most, self.keep = interval, max_gap, most, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getValueState("kept", "starts array<long>, step long, start long, open double, high double, low double, close double, volume double")

    def load(self, key) -> None:
        state = self.kept.get() if self.kept.exists() else ([], 0, LEAST, 0.0, 0.0, 0.0, 0.0, 0.0)
        self.starts, self.step, self.last = np.array(state[0], np.int64), state[1], dict(zip(("bar_start", *PRICES), state[2:], strict=True))

    def store(self, key) -> None:
        self.kept.update((self.starts.tolist(), self.step, int(self.last["bar_start"]), *(float(self.last[c]) for c in PRICES)))

    def fold(self, key, rows: np.ndarray) -> pd.DataFrame:
        win = rows["ts_ms"] - np.fmod(rows["ts_ms"], self.interval)
        now, was = self.last["bar_start"], self.last
        good = win >= np.maximum.accumulate(np.append(now, win))[:-1]  # what is older than the last candle is dropped
        made = pd.DataFrame(by_window(win[good], rows[good], True))[["bar_start", *PRICES]]
        if now != LEAST:
            if len(made) and made["bar_start"].iloc[0] == now:
                first = made.iloc[0]
                made.loc[0, PRICES] = [was["open"], max(was["high"], first["high"]), min(was["low"], first["low"]), first["close"], was["volume"] + first["volume"]]
            else:
                made = pd.concat([pd.DataFrame([was]), made], ignore_index=True)
        made["filled"] = False
        gap = np.diff(made["bar_start"])
        n = np.where(gap <= self.max_gap, np.minimum(self.most, (gap - 1) // self.interval), 0)
        at = np.repeat(np.arange(len(n)), n)
        flat = made["close"].to_numpy()[at]
        place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + 1
        fill = pd.DataFrame({"bar_start": made["bar_start"].to_numpy()[at] + place * self.interval, **dict.fromkeys(PRICES[:4], flat), "volume": 0.0, "filled": True})
        self.last = made.iloc[-1][["bar_start", *PRICES]].to_dict()
        out = pd.concat([made, fill], ignore_index=True).sort_values("bar_start")
        every = np.union1d(self.starts, out["bar_start"])
        gone, old, self.starts = every[:-self.keep], self.starts, every[-self.keep:]
        out = out[out["bar_start"] >= self.starts[0]]
        gone = pd.DataFrame({"bar_start": np.intersect1d(gone, old), **dict.fromkeys(PRICES, np.nan), "filled": False})
        self.step += 1
        out = pd.concat([out.assign(evicted=False), gone.assign(evicted=True)]).assign(symbol=key[0], step=self.step)
        return out.astype({"bar_start": "int64"})[["symbol", "bar_start", *PRICES, "filled", "evicted", "step"]]


class Line(Ordered):
    """The state is the time of the last point's first tick."""

    columns = {"seq": "i8", "ts_ms": "i8", "price": "f8"}

    def __init__(self, interval: int):
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getValueState("kept", "anchor long, step long")

    def load(self, key) -> None:
        self.anchor, self.step = self.kept.get() if self.kept.exists() else (None, 0)

    def store(self, key) -> None:
        self.kept.update((self.anchor, self.step))

    def fold(self, key, rows: np.ndarray) -> pd.DataFrame:
        times, last = chains.Line(rows["ts_ms"], self.interval).points(self.anchor)
        self.anchor, self.step = int(times.max()), self.step + 1
        return pd.DataFrame({"symbol": key[0], "time": times, "value": rows["price"][last], "step": self.step})


class Features(Fold):
    state = "close double"
    order = ("bar_start",)

    def __init__(self, window: int, eps: float):
        self.window, self.eps = window, eps

    def step(self, key, state, r, out):
        closes = [*(c for (c,) in state), r.close][-(self.window + 1):]
        returns = [math.log(b) - math.log(a) for a, b in zip(closes, closes[1:], strict=False)]
        recent, some = closes[-self.window:], bool(returns)
        out[r.bar_start] = Row(symbol=key[0], bar_start=r.bar_start, close=r.close, log_return=returns[-1] if some else 0.0, ret_mean=fmean(returns) if some else 0.0,
                               ret_std=(pstdev(returns) if some else 0.0) + self.eps, zscore=(r.close - fmean(recent)) / (pstdev(recent) + self.eps) if some else 0.0)
        return [(c,) for c in closes]


def packed(rows: pd.DataFrame) -> bytes:
    batch, sink = pa.RecordBatch.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


class OrderStates(StatefulProcessor):
    """The key is a bucket of orders: their states are kept as one Arrow table, and a batch's events are decided as arrays, the first ones
    of all orders, then the second ones, and so on. A bucket has one timer, at which the first of its ended orders is forgotten."""

    never = np.iinfo(np.int64).max
    kinds = {"order_id": "int64", "state": object, "cum_qty": "int64", "total_qty": "int64", "no_total": bool, "until": "int64"}

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("kept", "orders binary, timer long")

    def load(self) -> tuple[pd.DataFrame, int]:
        if not self.kept.exists():
            return pd.DataFrame({c: np.empty(0, kind) for c, kind in self.kinds.items()}), self.never
        orders, timer = self.kept.get()
        return pa.ipc.open_stream(bytes(orders)).read_pandas(), timer

    def keep(self, known: pd.DataFrame, timer: int, gone: bool = False) -> None:
        """Orders of a bucket by their ids, and its timer; one that is gone needs no deletion."""
        soonest = int(known["until"].min()) if len(known) else self.never
        if soonest != timer:
            if timer != self.never and not gone:
                self.handle.deleteTimer(timer)
            if soonest != self.never:
                self.handle.registerTimer(soonest)
        if len(known):
            self.kept.update((packed(known), soonest))
        else:
            self.kept.clear()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.kept.update((bytes(initialState["orders"].iloc[0]), self.never))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, timer = self.load()
        new = pd.concat(rows, ignore_index=True)
        new = new.iloc[np.lexsort((new["event_seq"], new["order_id"]))]
        ids, first, count = np.unique(new["order_id"].to_numpy(), return_index=True, return_counts=True)
        touched = known["order_id"].isin(ids).to_numpy()
        at, begin = np.searchsorted(ids, known["order_id"].to_numpy()[touched]), {c: np.zeros(len(ids), kind) for c, kind in self.kinds.items()}
        for c in self.kinds:
            begin[c][at] = known[c].to_numpy()[touched]
        codes, names = pd.factorize(np.concatenate([np.array(STATUS, object), np.where(begin["state"] == 0, None, begin["state"]), new["state"].to_numpy(object)]))  # null is -1
        now = {"state": codes[len(STATUS):len(STATUS) + len(ids)], "opened": np.isin(ids, known["order_id"]), **{c: begin[c] for c in ("cum_qty", "total_qty", "no_total")}}
        own = {c: new[c].to_numpy() for c in ("delta_qty", "total_qty", "no_total")} | {"state": codes[len(STATUS) + len(ids):]}
        sent = self.decide(now, own, first, count)
        until = np.full(len(ids), self.never)
        if self.forget_ms is not None:
            ended = np.isin(now["state"], [STATUS.index(s) for s in TERMINAL])
            until = np.where(ended, np.maximum(np.maximum.reduceat(new["at_ms"].to_numpy(), first), 0) + self.forget_ms, until)
        text = np.append(np.asarray(names, object), None)
        changed = pd.DataFrame({"order_id": ids, "state": text[now["state"]], "cum_qty": now["cum_qty"], "total_qty": now["total_qty"], "no_total": now["no_total"], "until": until})
        self.keep(pd.concat([known[~touched], changed]).sort_values("order_id", ignore_index=True) if len(known) else changed, timer)
        seq, gone = new["event_seq"].to_numpy(), new["no_seq"].to_numpy()
        last = np.append((np.diff(new["order_id"]) != 0) | (np.diff(seq) != 0), True)  # of a number that comes twice in a batch the last one
        out = pd.DataFrame({"order_id": pd.array(new["order_id"].to_numpy(), "Int64"), "event_seq": pd.array(np.where(gone, 0, seq), "Int64"), "result": np.array(RESULTS, object)[sent["result"]],
                            "state": text[sent["state"]], "cum_qty": sent["cum_qty"], "total_qty": pd.array(sent["total_qty"], "Int64")})
        out.loc[gone, "event_seq"] = pd.NA
        out.loc[sent["no_total"], "total_qty"] = pd.NA
        if key[0] < 0:
            out["order_id"] = pd.array([pd.NA] * len(out), "Int64")
        yield out[last]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, timer = self.load()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self.keep(known[known["until"] > now].reset_index(drop=True), timer, gone=True)
        yield from ()

    @staticmethod
    def decide(now: dict, rows: dict, first: np.ndarray, count: np.ndarray) -> dict:
        """Changes now, the states of orders; gives what goes out for each row. Of order i, count[i] rows begin at first[i]."""
        sent = {"result": np.zeros(len(rows["state"]), np.int8), **{c: np.empty(len(rows["state"]), now[c].dtype) for c in ("state", "cum_qty", "total_qty", "no_total")}}
        some, step = np.arange(len(first)), 0
        while len(some):
            at = first[some] + step
            was, asked, opened, no_total = now["state"][some], rows["state"][at], now["opened"][some], now["no_total"][some]
            named = (np.minimum(was, asked) >= 0) & (np.maximum(was, asked) < len(STATUS))
            legal = opened & named & MAY[np.where(named, was, 0), np.where(named, asked, 0)]
            fill = legal & ((asked == PARTIAL) | (asked == FULL))
            cum, total = now["cum_qty"][some] + np.where(fill, rows["delta_qty"][at], 0), now["total_qty"][some]
            counts = fill & ~no_total  # without a total nothing is counted, as in SQL
            over = counts & (cum > total)
            moves = ~opened | (legal & ~over)
            now["state"][some] = np.where(moves, np.where(counts & (cum == total), FULL, asked), was)
            now["cum_qty"][some] = np.where(opened, np.where(counts & ~over, cum, now["cum_qty"][some]), 0)
            now["total_qty"][some] = np.where(opened, total, rows["total_qty"][at])
            now["no_total"][some] = np.where(opened, no_total, rows["no_total"][at])
            now["opened"][some] = True
            sent["result"][at] = np.select([moves & ~(counts & (asked == FULL) & (cum < total)), moves, over], [0, 1, 2], 3)
            for c in ("state", "cum_qty", "total_qty", "no_total"):
                sent[c][at] = now[c][some]
            step += 1
            some = some[count[some] > step]
        return sent


def begin_orders(bucket: tuple, known: pd.DataFrame) -> pd.DataFrame:
    """The orders of a bucket that a stream begins with, as its state has them."""
    own = known[[c for c in OrderStates.kinds if c != "until"]].assign(until=OrderStates.never).sort_values("order_id", ignore_index=True)
    if not own["order_id"].is_unique:
        raise ValueError("an order that the stream begins with is there twice")
    return pd.DataFrame({"bucket": [bucket[0]], "orders": [packed(own)]})


class Barrier(Fold):
    """Rows of the state: each symbol's last bar, and whether it waits for the others; the time is on all of them."""

    state = "symbol string, open double, high double, low double, close double, volume double, waits boolean, at long, sent boolean"

    def __init__(self, symbols: list[str]):
        self.symbols = symbols

    def step(self, key, state, r, out):
        if r.symbol not in self.symbols:
            return state
        known = {s[0]: s[1:7] for s in state}
        at, sent = (state[0][7], state[0][8]) if state else (None, False)
        if at is None or r.bar_start > at:
            if at is not None and not sent:
                self.send(key, at, known, out)
            known, at, sent = {s: (*b[:5], False) for s, b in known.items()}, r.bar_start, False
        elif r.bar_start < at or sent:
            return state
        known[r.symbol] = r.open, r.high, r.low, r.close, r.volume, True
        if all(s in known and known[s][5] for s in self.symbols):
            self.send(key, at, known, out)
            sent = True
        return [(s, *b, at, sent) for s, b in known.items()]

    def send(self, key, at, known, out):
        for s in self.symbols:
            first, high, low, last, volume, waits = known.get(s, (1.0, 1.0, 1.0, 1.0, 0.0, False))
            if not waits:
                first, high, low, volume = last, last, last, 0.0
            out[at, s] = Row(universe=key[0], symbol=s, bar_start=at, open=first, high=high, low=low, close=last, volume=volume)


class Risk(Ordered):
    """The state is what is left of an account's margin."""

    columns = {"seq": "i8", "order_id": "i8", "value": "f8", "margin": "f8"}

    def __init__(self, cap: float):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getValueState("kept", "rest double")

    def load(self, key) -> None:
        self.rest = self.kept.get()[0] if self.kept.exists() else None

    def store(self, key) -> None:
        self.kept.update((self.rest,))

    def fold(self, key, rows: np.ndarray) -> pd.DataFrame:
        if self.rest is None:
            self.rest = float(np.nan_to_num(rows["margin"][0]))
        value = rows["value"]
        decision = np.where(np.isnan(value), "INVALID_ARGUMENTS", np.where(value > self.cap, "EXCEEDS_MAX_CAP", "INSUFFICIENT_MARGIN")).astype(object)
        asked = np.flatnonzero(value <= self.cap)
        good, self.rest = fits_one(value[asked], self.rest)
        decision[asked[good]] = "APPROVED"
        return pd.DataFrame({"account_id": key[0], "order_id": rows["order_id"], "decision": decision})


def fold(rows: DataFrame, key: str, processor: Fold, schema: str) -> DataFrame:
    return rows.groupBy(key).transformWithState(processor, schema, "Update", "None")


def stream_candles(ticks: DataFrame, interval: int, max_gap: int = 43_200_000, most: int = 50, keep: int = 500) -> DataFrame:
    """Each candle again whenever a chunk of ticks changes it, and flat ones for gaps up to max_gap; ticks older than the last candle are dropped.

    Of a symbol's candles the last ``keep`` stay: one that leaves goes out once more as evicted, without prices. A higher step is later."""
    return fold_ordered(ticks, "symbol", Candles(interval, max_gap, most, keep),
                        "symbol string, bar_start long, open double, high double, low double, close double, volume double, filled boolean, evicted boolean, step long")


def stream_line(ticks: DataFrame, interval: int) -> DataFrame:
    """The points of ``chains.anchored_line``, each again, with a higher step, whenever a chunk of ticks changes it."""
    return fold_ordered(ticks, "symbol", Line(interval), "symbol string, time long, value double, step long")


def stream_features(bars: DataFrame, window: int, eps: float = EPS) -> DataFrame:
    """``features.features_warm`` of each bar as it comes; a symbol's bars come in the order of their times."""
    return fold(bars, "symbol", Features(window, eps), "symbol string, bar_start long, close double, log_return double, ret_mean double, ret_std double, zscore double")


def stream_orders(events: DataFrame, known: DataFrame | None = None, forget_ms: int | None = None, time: str = "ts", delay: str = "1 hour", buckets: int = 256) -> DataFrame:
    """What each requested change (order_id, event_seq, state, delta_qty, total_qty) leads to. The first one of an order
    opens it and adds no quantity; ILLEGAL and OVERFILL change nothing; a fill up to the total makes FILLED.

    known (order_id, state, cum_qty, total_qty) are orders that a stream begins with, as ``orders.replay`` gives them from a log. With forget_ms, an order
    that has ended is forgotten once the watermark (of the column time, by delay) is so far behind its last change; so the state is that of the open orders
    and of those that ended not long ago, and a change that comes later opens a new order. Changes behind the watermark are then dropped.

    Orders are dealt to buckets by their ids; a batch reads and writes the states of the buckets that it touches, each
    whole and at a fixed cost of some 0.1 s. A checkpoint keeps its number of buckets.
    """
    bucket = F.when(F.col("order_id").isNull(), -1).otherwise(F.pmod(F.xxhash64(F.col("order_id").cast("long")), F.lit(buckets))).cast("int").alias("bucket")
    number = lambda c, kind="long": F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)).alias(c)
    own = [bucket, number("order_id"), F.coalesce(F.col("event_seq").cast("long"), F.lit(LEAST)).alias("event_seq"), F.col("event_seq").isNull().alias("no_seq"), "state", number("delta_qty"),
           number("total_qty"), F.col("total_qty").isNull().alias("no_total")]
    rows = events.select(*own) if forget_ms is None else events.withWatermark(time, delay).select(*own, F.coalesce(F.unix_millis(time), F.lit(0).cast("long")).alias("at_ms"), time)
    begin = None
    if known is not None:
        orders = known.select(bucket, number("order_id"), "state", number("cum_qty"), number("total_qty"), F.col("total_qty").isNull().alias("no_total"))
        begin = orders.groupBy("bucket").applyInPandas(begin_orders, "bucket int, orders binary").groupBy("bucket")
    return rows.groupBy("bucket").transformWithStateInPandas(OrderStates(forget_ms), "order_id long, event_seq long, result string, state string, cum_qty long, total_qty long", "Update",
                                                             "None" if forget_ms is None else "EventTime", begin)


def stream_barrier(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """For universes that one task can hold (``barrier.start_barrier`` spreads them): all of a universe's symbols at a time, once every one has come or a later time begins; those that did not come are
    flat at their last close, or 1 before the first. Older bars are passed over; a last incomplete time is not sent."""
    return fold(bars, "universe", Barrier(symbols), "universe string, symbol string, bar_start long, open double, high double, low double, close double, volume double")


def stream_risk(orders: DataFrame, cap: float, blocked: DataFrame) -> DataFrame:
    """``orders.risk_decisions`` of a stream; blocked (symbol) is a small static table, as a deny list is, read again in each batch."""
    listed = blocked.select("symbol").distinct().withColumn("listed", F.lit(True))
    rows = orders.join(listed, "symbol", "left")
    refused = rows.filter("listed").select("account_id", "order_id", F.lit("BLACKLISTED").alias("decision"))
    return fold_ordered(rows.filter("listed IS NULL"), "account_id", Risk(cap), "account_id long, order_id long, decision string").unionByName(refused)


def stream_dedup_submits(orders: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first submit of each order id; ids are forgotten once the watermark has passed them by delay."""
    return orders.withWatermark(time, delay).dropDuplicatesWithinWatermark(["order_id"])


def stream_static_filter(ticks: DataFrame, tickers: DataFrame) -> DataFrame:
    """Ticks of the listed symbols; tickers is read again in each batch."""
    return ticks.join(tickers.select("symbol").distinct(), "symbol", "left_semi")
