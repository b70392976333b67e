"""Bars from a stream of ticks: with the per-symbol late rule, or with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from .ordered import LEAST, Ordered, by_window, fold_ordered

STATE = "open double, high double, low double, close double, volume double, last long, version int"
BARS = "symbol string, bar_start long, open double, high double, low double, close double, volume double, version int"
VALUES = ["open", "high", "low", "close", "volume", "last", "version"]


class Bars(Ordered):
    """The state is a map from the start of a window to its bar, of the current bar and the one that it replaced."""

    def __init__(self, window_ms: int, late_ms: int, timers: bool):
        self.window, self.late, self.timers = window_ms, late_ms, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.bars = handle.getMapState("bars", "bar_start long", STATE)

    def load(self, key) -> None:
        self.own = {k[0]: dict(zip(VALUES, v, strict=True)) for k, v in self.bars.iterator()}
        self.stored = set(self.own)

    def store(self, key) -> None:
        for start in self.stored - set(self.own):
            self.bars.removeKey((start,))
        for start, bar in self.own.items():
            self.bars.updateValue((start,), tuple(bar[c] for c in VALUES))
        if self.timers:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if self.own:
                self.handle.registerTimer(max(self.own) + self.window + self.late)

    def fold(self, key, rows: np.ndarray) -> pd.DataFrame:
        ts, old = rows["ts_ms"], sorted(self.own)
        current, replaced = old[-1] if old else LEAST, old[0] if len(old) > 1 else LEAST
        win = ts - np.fmod(ts, self.window)
        before = np.maximum.accumulate(np.append(current, win))[:-1]  # the current window when each tick came
        roll = win > before
        previous = np.maximum.accumulate(np.append(replaced, np.where(roll, before, LEAST)))[1:]
        late = ~roll & (win < before) & (win == previous) & (ts - before >= -self.late)
        kept = roll | (win == before) | late
        bars = pd.DataFrame(by_window(win[kept], rows[kept], False)).assign(version=0).set_index("bar_start")
        top, sent = int(max(before[-1], win[-1])), []
        for start in set(old) | set(win[late].tolist()):  # bars from before, and those that late ticks correct, tick after tick
            at = np.flatnonzero(kept & (win == start))
            steps = self.steps(self.own.get(start), rows[at], late[at])
            # closed in this chunk: as it was when the next one began; and again after each late tick
            out = np.append(start < top and start >= current, late[at]) & np.append(len(at) == 0 or late[at][0], np.ones(len(at), bool))
            if start < top and start >= current and len(at) and not late[at][0]:
                out[np.flatnonzero(~late[at])[-1] + 1] = True
            sent.append(steps[out].assign(bar_start=start))
            bars.loc[start, VALUES] = steps.iloc[-1][VALUES].to_list()
        done = bars[(bars.index < top) & ~bars.index.isin([*old, *win[late]])]
        sent.append(done.reset_index())
        self.own = {s: bars.loc[s].to_dict() for s in (top, int(previous[-1])) if s != LEAST}
        for bar in self.own.values():
            bar |= {"last": int(bar["last"]), "version": int(bar["version"])}
        return self.rows(key, pd.concat(sent).set_index("bar_start"))

    @staticmethod
    def steps(bar: dict | None, rows: np.ndarray, late: np.ndarray) -> pd.DataFrame:
        """A bar as it was (nothing, if it begins here), and after each of its ticks in their order."""
        was = bar or {"open": rows["price"][0], "high": -np.inf, "low": np.inf, "close": np.nan, "volume": 0.0, "last": LEAST, "version": 0}
        price, ts = np.append(was["close"], rows["price"]), np.append(was["last"], rows["ts_ms"])
        last = np.maximum.accumulate(ts)
        closing = np.maximum.accumulate(np.where(ts >= last, np.arange(len(ts)), 0))
        return pd.DataFrame({"open": was["open"], "high": np.maximum.accumulate(np.append(was["high"], rows["price"])), "low": np.minimum.accumulate(np.append(was["low"], rows["price"])),
                             "close": price[closing], "volume": np.add.accumulate(np.append(was["volume"], rows["size"])), "last": last, "version": was["version"] + np.append(0, np.cumsum(late))})

    @staticmethod
    def rows(key, bars: pd.DataFrame) -> pd.DataFrame:
        out = bars[VALUES].rename_axis("bar_start").reset_index().drop(columns="last")
        out.insert(0, "symbol", key[0])
        return out.astype({"bar_start": "int64", "version": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No tick of the open bar can come any more: it goes out, and the symbol's state goes."""
        self.load(key)
        if self.own:
            yield self.rows(key, pd.DataFrame([self.own[max(self.own)]], index=[max(self.own)]))
        for start in self.stored:
            self.bars.removeKey((start,))


def stream_bars(ticks: DataFrame, window_ms: int = 60_000, late_ms: int = 100, closing: str | None = None) -> DataFrame:
    """Each bar when a later one begins, and again with a higher version for each late tick that corrects it, version being the number of
    late ticks so far. The open bar is not sent, unless closing is given.

    closing is a delay of the watermark, such as "10 seconds": once it has passed the end of a symbol's open bar by late_ms, the bar goes out and the
    symbol's state is dropped; ticks behind the watermark are dropped before.
    """
    if closing is None:
        return fold_ordered(ticks, "symbol", Bars(window_ms, late_ms, False), BARS)
    timed = ticks.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", closing)
    return fold_ordered(timed, "symbol", Bars(window_ms, late_ms, True), BARS, "EventTime")


def stream_bars_watermark(ticks: DataFrame, window: str = "1 minute", delay: str = "100 milliseconds") -> DataFrame:
    """Each bar once, when the watermark has passed it."""
    timed = ticks.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", window), "symbol").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", F.struct("ts_ms", "seq")).alias("close"),
        F.sum("size").alias("volume")).select("symbol", F.unix_millis("window.start").alias("bar_start"), "open", "high", "low", "close", "volume")
