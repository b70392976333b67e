"""State of a key over its rows in the order of their numbers, from chunks that come in any order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LEAST = np.iinfo(np.int64).min


class Ordered(StatefulProcessor):
    """A batch's rows of a key are folded as arrays, sorted by seq, in parts of at most about chunk rows.

    Rows that come in more than one chunk are laid by in the state store, by ranges of seq, and taken from there one range after another:
    so a task holds one chunk or one range, however many rows a key has in a batch (numbers of a key's rows are
    dense; if some number comes very often, its rows are one range). fold(key, arrays) gives what goes out.
    """

    columns = {"seq": "i8", "ts_ms": "i8", "price": "f8", "size": "f8"}
    chunk = 1 << 16

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "range long, part int", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.load(key)
        for part in self.in_order(rows):
            yield self.fold(key, part)
        self.store(key)

    def in_order(self, rows: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        held, size, parts = [], 0, 0
        for frame in rows:
            part = np.empty(len(frame), list(self.columns.items()))
            for c in self.columns:
                part[c] = frame[c].to_numpy()
            held.append(part)
            size += len(part)
            if size > self.chunk:
                self.lay_by(np.concatenate(held), parts)
                held, size, parts = [], 0, parts + 1
        if not parts:
            if size:
                yield sort(held)
            return
        if size:
            self.lay_by(np.concatenate(held), parts)
        laid = sorted(tuple(k) for k, _ in self.waiting.iterator())
        for r in dict.fromkeys(k[0] for k in laid):
            own = [k for k in laid if k[0] == r]
            yield sort([np.frombuffer(self.waiting.getValue(k)[0], list(self.columns.items())) for k in own])
            for k in own:
                self.waiting.removeKey(k)

    def lay_by(self, rows: np.ndarray, part: int) -> None:
        ranges = rows["seq"] // self.chunk
        for r in np.unique(ranges):
            self.waiting.updateValue((int(r), part), (rows[ranges == r].tobytes(),))

    def load(self, key) -> None:
        raise NotImplementedError

    def fold(self, key, rows: np.ndarray) -> pd.DataFrame:
        raise NotImplementedError

    def store(self, key) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


def sort(parts: list[np.ndarray]) -> np.ndarray:
    rows = np.concatenate(parts)
    return rows[np.argsort(rows["seq"], kind="stable")]


def by_window(win: np.ndarray, rows: np.ndarray, close_by_arrival: bool) -> dict[str, np.ndarray]:
    """Bars of rows in order of arrival; last is the time of the row that closes."""
    order = np.argsort(win, kind="stable")
    starts, first = np.unique(win[order], return_index=True)
    price = rows["price"][order]
    last = np.append(first[1:], len(win)) - 1
    closing = order if close_by_arrival else np.lexsort((np.arange(len(win)), rows["ts_ms"], win))
    return {"bar_start": starts, "open": price[first], "high": np.maximum.reduceat(price, first), "low": np.minimum.reduceat(price, first), "close": rows["price"][closing[last]],
            "volume": np.add.reduceat(rows["size"][order], first), "last": rows["ts_ms"][closing[last]]}


def fold_ordered(rows: DataFrame, key: str, processor: Ordered, schema: str, time_mode: str = "None") -> DataFrame:
    """Rows without a number or a time have no place in the order and are left out."""
    own = rows.filter(" AND ".join(f"{c} IS NOT NULL" for c, kind in processor.columns.items() if kind == "i8"))
    return own.groupBy(key).transformWithStateInPandas(processor, schema, "Update", time_mode)
