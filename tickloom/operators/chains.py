"""Chains of rows in which each one decides which later row is the next: found in slices of a key, by pointers instead of row by row.

A key's rows are in order of seq and dealt into slices of seq // slice_rows, so that one busy key is many tasks. For each slice, one pass says how
any state at its begin would leave it (a small table); these tables are put together along a key's slices; and a second pass over
the slices gives the rows' results, now that each slice's first state is known.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.views import partitions

SLICE_ROWS = 1 << 18


def first_above(values: np.ndarray, start: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each start the first place from there on whose value is above limit; len(values) if there is none.

    Maxima of all spans of 1, 2, 4, ... values; then each search skips the longest spans that are not above its limit.
    """
    n, spans = len(values), [values]
    while len(spans[-1]) > (step := 1 << len(spans) - 1):
        spans.append(np.maximum(spans[-1][:-step], spans[-1][step:]))
    at = np.minimum(np.asarray(start, np.int64), n)
    for k in range(len(spans) - 1, -1, -1):
        fits = at + (1 << k) <= n
        skip = fits.copy()
        skip[fits] = spans[k][at[fits]] <= np.broadcast_to(limit, at.shape)[fits]
        at = np.where(skip, at + (1 << k), at)
    return at


def records(values: np.ndarray) -> np.ndarray:
    """Places of the values above all before them."""
    most = np.maximum.accumulate(values)
    return np.flatnonzero(np.append(True, most[1:] > most[:-1])[:len(values)])


def ends(pointer: np.ndarray) -> np.ndarray:
    """Where each chain ends; the last node of a chain points to itself. Each round doubles the steps."""
    while not (further := pointer[pointer] == pointer).all():
        pointer = pointer[pointer]
    return pointer if further.all() else pointer[pointer]


def reached(pointer: np.ndarray, start: int) -> np.ndarray:
    """All nodes of the chain from start, in order; pointers go forward, or to the node itself at its end."""
    jumps = [pointer]
    while (jumps[-1][start] != (twice := jumps[-1][jumps[-1]])[start]):
        jumps.append(twice)
    found = np.array([start])
    for jump in jumps[::-1]:
        found = np.union1d(found, jump[found])
    return found


class Breaker:
    """A slice of attempts. Node i: the breaker opened at attempt i; node n + i: it closed there, with no failures since.

    States are (open, number): the time of opening, or failures since the last success.
    """

    def __init__(self, rows: pa.Table, failures: int, cooldown: int):
        self.ts, self.ok = rows["ts_ms"].to_numpy(), rows["ok"].to_numpy()
        self.failures, self.cooldown = failures, cooldown
        n = self.n = len(self.ts)
        place = np.arange(n)
        self.last_ok = np.maximum.accumulate(np.where(self.ok, place, -1))
        self.full = np.flatnonzero(place - self.last_ok >= failures)  # where enough failures in a row end
        probe = first_above(self.ts, place + 1, self.ts + cooldown)
        opened = np.where(probe < n, self.decided(np.minimum(probe, n - 1)), place)
        trip = self.trip(place + 1)
        self.pointer = np.concatenate([opened, np.where(trip < n, trip, n + place)])

    def decided(self, place):
        """The node that an attempt which was let through makes when the breaker was open."""
        return np.where(self.ok[place], self.n + place, place)

    def trip(self, start: np.ndarray) -> np.ndarray:
        """Where a breaker opens that has counted no failures before start: the failures must all lie from there on."""
        # a streak that is long enough at the first place that can count, or later, is so from start on
        return np.append(self.full, self.n)[np.searchsorted(self.full, start + self.failures - 1)]

    def state(self, node: int) -> tuple[bool, int]:
        """In which state a chain that ends with node leaves the slice."""
        if node < self.n:
            return True, int(self.ts[node])
        place = node - self.n
        return False, int(self.n - 1 - max(self.last_ok[-1], place))

    def begin(self, state: tuple[bool, int]) -> int | None:
        """The first node of a slice that begins in a state; None if nothing changes in it but the number of failures."""
        is_open, number = state
        if is_open:
            at = int(first_above(self.ts, np.array([0]), np.array([number + self.cooldown]))[0])
            return int(self.decided(np.array([at]))[0]) if at < self.n else None
        more = self.failures - number
        oks = np.flatnonzero(self.ok[:more])
        return int(self.n + oks[0]) if len(oks) else more - 1 if self.n >= more else None

    def left(self, state: tuple[bool, int], end: np.ndarray) -> tuple[bool, int]:
        node = self.begin(state)
        if node is not None:
            return self.state(int(end[node]))
        return state if state[0] else (False, state[1] + self.n)

    def table(self, top: int | None) -> tuple[list, list]:
        """What each number of failures leads to; and from which time of opening on another state is left behind.

        The time of opening is at most that of an earlier slice's attempt, top, so it can only let through the first attempts
        that are later than all before them, up to the first one behind top + cooldown.
        """
        end = ends(self.pointer)
        closed = [self.left((False, f), end) for f in range(self.failures)]
        if top is None:
            return closed, []
        first = records(self.ts)
        first = first[:int(np.searchsorted(self.ts[first], top + self.cooldown, "right")) + 1]
        limits = np.append(self.ts[first], np.iinfo(np.int64).max)  # an opening before limits[k] - cooldown lets attempt first[k] through
        leads = [self.state(int(e)) for e in end[self.decided(first)]]
        kept = [i for i in range(len(leads)) if i + 1 == len(leads) or leads[i] != leads[i + 1]]
        return closed, [{"before": int(limits[i]), "to": dict(zip(("open", "number"), leads[i], strict=True))} for i in kept]

    def results(self, state: tuple[bool, int]) -> tuple[np.ndarray, np.ndarray]:
        """attempt and state of each row."""
        n, first = self.n, self.begin(state)
        nodes = reached(self.pointer, first) if first is not None else np.zeros(0, np.int64)
        event, opens = np.zeros(n, bool), np.zeros(n, bool)
        event[nodes % n] = True
        opens[nodes[nodes < n]] = True
        last = np.maximum.accumulate(np.where(event, np.arange(n), -1))
        after = np.where(last >= 0, opens[last], state[0])
        before = np.concatenate([[state[0]], after[:-1]])
        attempt = np.where(~before, "CLOSED", np.where(event, "HALF_OPEN", "REFUSED"))
        return attempt, np.where(after, "OPEN", "CLOSED")


def sliced(rows: DataFrame, key: str, slice_rows: int) -> DataFrame:
    """rows with their slice, and top, the latest time of the key's earlier slices."""
    own = rows.withColumn("slice", F.floor(F.col("seq") / slice_rows))
    few = own.groupBy(key, "slice").agg(F.max("ts_ms").alias("latest"))
    earlier = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    tops = few.select(F.col(key).alias("_key"), F.col("slice").alias("_slice"), F.max("latest").over(earlier).alias("top"))
    return own.join(tops, F.col(key).eqNullSafe(F.col("_key")) & (F.col("slice") == F.col("_slice"))).drop("_key", "_slice")


def along(tables: DataFrame, key: str, start: Callable, step: Callable, schema: str) -> DataFrame:
    """For each slice what its key's earlier slices have led to: step(state, row of the slice's table) gives the state behind it.

    One row a slice passes here, so this is short even for a key whose rows are many.
    """
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        now, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (own := (row[key],)) != now:
                    now, state = own, start()
                out.append((row[key], row["slice"], *state))
                state = step(state, row)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)], names=types.names) if out else pa.RecordBatch.from_pylist([], types)

    return tables.repartition(partitions(tables), key).sortWithinPartitions(key, "slice").mapInArrow(run, schema)


def in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("seq")


def breaker(log: DataFrame, failures: int = 3, cooldown_ms: int = 5000, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """State after each attempt (node, seq, ts_ms, ok), and in which state it was made: so many failures since the last
    success open it; when open for longer than the cooldown, the next attempt decides; sooner ones are refused.

    A null ok is a failure; attempts without a time are left out. Rows of a node need different seq; a null node is one too.
    """
    rows = sliced(log.filter("ts_ms IS NOT NULL AND seq IS NOT NULL").select("node", "seq", "ts_ms", F.coalesce("ok", F.lit(False)).alias("ok")), "node", slice_rows)
    kind, state = log.schema["node"].dataType.simpleString(), "struct<open: boolean, number: long>"
    table_schema = f"node {kind}, slice long, closed array<{state}>, opened array<struct<before: long, to: {state}>>"
    types = to_arrow_schema(StructType.fromDDL(table_schema))

    def tables(table: pa.Table) -> pa.Table:
        own = in_order(table)
        top = own["top"][0].as_py()
        closed, opened = Breaker(own, failures, cooldown_ms).table(top)
        exits = [dict(zip(("open", "number"), s, strict=True)) for s in closed]
        return pa.Table.from_pylist([{"node": own["node"][0].as_py(), "slice": own["slice"][0].as_py(), "closed": exits, "opened": opened}], schema=types)

    def step(now: tuple, row: dict) -> tuple:
        is_open, number = now
        if not is_open:
            to = row["closed"][number]
        else:
            to = next((x["to"] for x in row["opened"] if number + cooldown_ms < x["before"]), {"open": True, "number": number})
        return to["open"], to["number"]

    found = rows.groupBy("node", "slice").applyInArrow(tables, table_schema)
    entries = along(found, "node", lambda: (False, 0), step, f"node {kind}, slice long, open boolean, number long")
    entered = rows.join(entries.withColumnsRenamed({"node": "_node", "slice": "_slice"}), F.col("node").eqNullSafe(F.col("_node")) & (F.col("slice") == F.col("_slice"))).drop("_node", "_slice")

    def results(table: pa.Table) -> pa.Table:
        own = in_order(table)
        attempt, after = Breaker(own, failures, cooldown_ms).results((own["open"][0].as_py(), own["number"][0].as_py()))
        return pa.table({"node": own["node"], "seq": own["seq"], "attempt": attempt.astype(object), "state": after.astype(object)})

    return entered.groupBy("node", "slice").applyInArrow(results, f"node {kind}, seq long, attempt string, state string")


class Line:
    """A slice of ticks; each tick's pointer is the first later one that is at least the interval behind it."""

    def __init__(self, ts: np.ndarray, interval: int):
        self.ts, self.interval = ts, interval
        place = np.arange(len(ts))
        to = first_above(ts, place + 1, ts + interval - 1)
        self.pointer = np.where(to < len(ts), to, place)

    def begin(self, anchor: int | None) -> int:
        """The first tick that opens a point, when the last one before the slice was opened at anchor."""
        if anchor is None:
            return 0
        return int(first_above(self.ts, np.array([0]), np.array([anchor + self.interval - 1]))[0])

    def points(self, anchor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Times of the points, and which tick is the last of each; the one from before the slice too, if it goes on."""
        start = self.begin(anchor)
        opened = reached(self.pointer, start) if start < len(self.ts) else np.zeros(0, np.int64)
        last, times = np.append(opened, len(self.ts))[1:] - 1, self.ts[opened]
        return (np.append(times, anchor), np.append(last, start - 1)) if anchor is not None and start > 0 else (times, last)

    def table(self, top: int | None) -> list[dict]:
        """The last anchor, by where the one before the slice was."""
        first = records(self.ts)
        if top is None:
            first = first[:1]
        else:
            first = first[:int(np.searchsorted(self.ts[first], top + self.interval)) + 1]
        last = self.ts[ends(self.pointer)[first]]
        kept = np.append(last[1:] != last[:-1], True)
        return [{"upto": int(self.ts[f]) - self.interval, "anchor": int(a)} for f, a in zip(first[kept], last[kept], strict=True)]


def anchored_line(ticks: DataFrame, interval_ms: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Points that a tick joins while it is nearer than the interval to the point's first tick; value is the last tick's.

    Ticks without a time or a number of arrival are left out; a null symbol is one too. A symbol's ticks need different seq.
    """
    rows = sliced(ticks.filter("ts_ms IS NOT NULL AND seq IS NOT NULL").select("symbol", "seq", "ts_ms", "price"), "symbol", slice_rows)
    kind = ticks.schema["symbol"].dataType.simpleString()
    table_schema = f"symbol {kind}, slice long, anchors array<struct<upto: long, anchor: long>>"
    types = to_arrow_schema(StructType.fromDDL(table_schema))

    def tables(table: pa.Table) -> pa.Table:
        own = in_order(table)
        found = Line(own["ts_ms"].to_numpy(), interval_ms).table(own["top"][0].as_py())
        return pa.Table.from_pylist([{"symbol": own["symbol"][0].as_py(), "slice": own["slice"][0].as_py(), "anchors": found}], schema=types)

    def step(now: tuple, row: dict) -> tuple:
        (anchor,) = now
        return (row["anchors"][0]["anchor"] if anchor is None else next((x["anchor"] for x in row["anchors"] if anchor <= x["upto"]), anchor),)

    found = rows.groupBy("symbol", "slice").applyInArrow(tables, table_schema)
    entries = along(found, "symbol", lambda: (None,), step, f"symbol {kind}, slice long, anchor long")
    entered = rows.join(entries.withColumnsRenamed({"symbol": "_symbol", "slice": "_slice"}), F.col("symbol").eqNullSafe(F.col("_symbol")) & (F.col("slice") == F.col("_slice"))).drop("_symbol", "_slice")

    def points(table: pa.Table) -> pa.Table:
        own = in_order(table)
        times, last = Line(own["ts_ms"].to_numpy(), interval_ms).points(own["anchor"][0].as_py())
        return pa.table({"symbol": own["symbol"].take(pa.array(last)), "time": times, "value": own["price"].take(pa.array(last)), "seq": own["seq"].take(pa.array(last))})

    some = entered.groupBy("symbol", "slice").applyInArrow(points, f"symbol {kind}, time long, value double, seq long")
    return some.groupBy("symbol", "time").agg(F.max_by("value", "seq").alias("value"))
