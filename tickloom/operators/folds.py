"""What fits into a rest that each row which fits makes smaller, in the order of the rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Up to so many rows, keys are followed side by side; longer ones are taken by themselves, CHUNK rows at once.
SHORT, CHUNK = 64, 4096


def fits_one(value: np.ndarray, left: float) -> tuple[np.ndarray, float]:
    """Which values fit, and what is left: runs of values that all fit are found by subtracting them one after another at once.

    Between values below zero the rest never grows, so a value above it is passed over for good, and so is all that lies above the rest later.
    """
    out = np.zeros(len(value), bool)
    gains = np.flatnonzero(value < 0)
    cuts = np.unique(np.concatenate([np.arange(0, len(value) + 1, CHUNK), gains, gains + 1, [len(value)]]))
    for start, end in zip(cuts, cuts[1:], strict=False):
        at = start + np.flatnonzero(value[start:end] <= left)
        while len(at):
            rest = np.subtract.accumulate(np.append(left, value[at]))
            good = value[at] <= rest[:-1]
            n = len(at) if good.all() else int(np.argmin(good))
            out[at[:n]] = True
            left = rest[n]
            at = at[n:][value[at[n:]] <= left]
    return out, float(left)


def fits(value: np.ndarray, first: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for keys whose rows begin at first, each with its rest."""
    out, left, size = np.zeros(len(value), bool), left.copy(), np.diff(np.append(first, len(value)))
    for i in np.flatnonzero(size > SHORT):
        span = slice(first[i], first[i] + size[i])
        out[span], left[i] = fits_one(value[span], left[i])
    short = np.flatnonzero(size <= SHORT)
    for k in range(int(size[short].max(initial=0))):  # the k-th row of every short key
        short = short[size[short] > k]
        at = first[short] + k
        good = value[at] <= left[short]
        out[at] = good
        left[short] -= np.where(good, value[at], 0.0)
    return out, left


def key_starts(column: pa.Array) -> np.ndarray:
    """Where the runs of equal keys of a sorted column begin; nulls are one key."""
    codes = pc.fill_null(column.dictionary_encode().indices, -1).to_numpy()
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[:len(codes)])


def fitting(batches: Iterable[pa.RecordBatch], key: str, value: str, rest: str) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key and order, with the column fits; a key begins with the rest of its first row (null is 0).

    From batch to batch only the last key's rest is kept, so memory does not grow with a busy key.
    """
    last, left = None, 0.0
    for batch in batches:
        if not batch.num_rows:
            continue
        first = key_starts(batch.column(key))
        begin = pc.fill_null(batch.column(rest).take(pa.array(first)), 0.0).to_numpy()
        if last == (now := (batch.column(key)[0].as_py(),)):
            begin = np.append(left, begin[1:])
        good, rests = fits(pc.fill_null(batch.column(value), float("nan")).to_numpy(), first, begin)
        last, left = now if len(first) == 1 else (batch.column(key)[batch.num_rows - 1].as_py(),), rests[-1]
        yield batch.append_column("fits", pa.array(good))
