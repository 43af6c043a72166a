"""Aggregates of many windows over the rows of one block, in numpy: O(n log n) whatever the windows' lengths.

No sum is taken back by subtraction: a window is put together from values that are in it, so a NaN, an infinity or a
very large value tells on the windows that hold it and on no other.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from ..functions.aggregates import Aggregate


class Windows:
    """Windows of rows ``first`` to ``last``, both included, over rows 0 to n - 1; none is empty."""

    def __init__(self, n: int, first: np.ndarray, last: np.ndarray):
        self.n, self.first, self.last = n, first, last
        self.padded = 1 << max(0, int(n - 1).bit_length())
        # The highest bit in which the ends differ: halves of blocks of this size meet between the two, or they are one row.
        self.level = np.frexp((first ^ last).astype(float))[1] - 1

    def _levels(self):
        """(level, windows of it) for windows of two rows or more."""
        order = np.argsort(self.level, kind="stable")
        levels = self.level[order]
        for h in np.unique(levels[levels >= 0]):
            yield int(h), order[np.searchsorted(levels, h, "left") : np.searchsorted(levels, h, "right")]

    def _halves(self, values: np.ndarray, h: int, fill) -> tuple[np.ndarray, np.ndarray]:
        """Left halves, from their ends on, and right halves of the blocks of 2^(h + 1) rows."""
        if len(values) < self.padded:
            values = np.concatenate([values, np.full(self.padded - len(values), fill, values.dtype)])
        blocks = values.reshape(-1, 2, 1 << h)
        return blocks[:, 0, ::-1], blocks[:, 1, :]

    def _cells(self, h: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of windows of level h: their block, and the places of their ends in ``_halves``."""
        return self.last[at] >> (h + 1), (1 << h) - 1 - (self.first[at] & ((1 << h) - 1)), self.last[at] & ((1 << h) - 1)

    def fold(self, f: np.ufunc, values: np.ndarray, fill) -> np.ndarray:
        """f over each window; ``fill`` is f's neutral value."""
        out = values[self.first]
        for h, at in self._levels():
            left, right = (f.accumulate(x, axis=1) for x in self._halves(values, h, fill))
            block, a, b = self._cells(h, at)
            out[at] = f(left[block, a], right[block, b])
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        return self.fold(np.add, values.astype(np.longdouble), 0)

    def counts(self, valid: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(valid)])
        return total[self.last + 1] - total[self.first]

    def deviations(self, values: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Population's deviation: each half about its valid value that is nearest to the other half, then put together."""
        x, squares = np.where(valid, values, 0).astype(np.longdouble), np.zeros(len(self.first), np.longdouble)
        for h, at in self._levels():
            block, *ends = self._cells(h, at)
            sides = []
            for y, known, place in zip(self._halves(x, h, 0), self._halves(valid, h, False), ends, strict=True):
                middle = np.take_along_axis(y, np.argmax(known, axis=1)[:, None], 1)
                y = np.where(known, y - middle, 0)
                s1, s2 = (np.add.accumulate(z, axis=1)[block, place] for z in (y, y * y))
                n = np.add.accumulate(known, axis=1, dtype=np.int64)[block, place]
                mean = np.where(n > 0, s1 / np.maximum(n, 1), 0)
                sides.append((n, middle[block, 0] + mean, s2 - mean * s1))
            (na, ma, qa), (nb, mb, qb) = sides
            apart = np.where((na > 0) & (nb > 0), mb - ma, 0)
            squares[at] = np.where(na > 0, qa, 0) + np.where(nb > 0, qb, 0) + apart * apart * na * nb / np.maximum(na + nb, 1)
        return np.sqrt(np.maximum(squares, 0) / np.maximum(self.counts(valid), 1))

    def medians(self, values: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """By a wavelet matrix of the valid values' ranks: a bit of the wanted rank a pass, for all windows at once."""
        before = np.concatenate([[0], np.cumsum(valid)])
        known = values[valid]
        order = np.argsort(known, kind="stable")
        ranks = np.empty(len(known), np.int64)
        ranks[order] = np.arange(len(known))
        begin, end = before[self.first], before[self.last + 1]
        some = np.flatnonzero(end > begin)
        low, high = (self._ranked(ranks, begin[some], end[some], k) for k in ((end - begin - 1)[some] // 2, (end - begin)[some] // 2))
        a, b = known[order[low]], known[order[high]]
        out = np.full(len(begin), np.nan)
        out[some] = np.where(a == b, a, 0.5 * a + 0.5 * b)
        return out

    @staticmethod
    def _ranked(ranks: np.ndarray, begin: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of ranks[begin:end]."""
        out = np.zeros(len(k), np.int64)
        for b in range(max(0, int(len(ranks) - 1).bit_length()) - 1, -1, -1):
            ones = (ranks >> b & 1).astype(bool)
            zeros = np.concatenate([[0], np.cumsum(~ones)])
            z0, z1 = zeros[begin], zeros[end]
            up = k >= z1 - z0
            k = np.where(up, k - (z1 - z0), k)
            out |= up.astype(np.int64) << b
            begin, end = np.where(up, zeros[-1] + begin - z0, z0), np.where(up, zeros[-1] + end - z1, z1)
            ranks = np.concatenate([ranks[~ones], ranks[ones]])
        return out


def evaluate(function: Aggregate, windows: Windows, column: pa.Array | None) -> pa.Array:
    """The function of each window as a double. Nulls are skipped but by LENGTH, which needs no column; without valid
    values the result is null, but 0 for SUM."""
    if function is Aggregate.LENGTH:
        return pa.array((windows.last - windows.first + 1).astype(float))
    valid = np.asarray(column.is_valid())
    exact = np.asarray(column.fill_null(0))
    values = exact.astype(float)
    counts = windows.counts(valid)
    if function in (Aggregate.MINIMUM, Aggregate.MAXIMUM):
        f, fill = (np.minimum, np.inf) if function is Aggregate.MINIMUM else (np.maximum, -np.inf)
        valid = valid & ~np.isnan(values)  # NaN counts as missing
        counts = windows.counts(valid)
        out = windows.fold(f, np.where(valid, values, fill), fill)
    elif function in (Aggregate.SUM, Aggregate.MEAN):
        out = windows.sums(np.where(valid, exact, 0))
        if function is Aggregate.SUM and exact.dtype.kind == "i" and (np.abs(out) >= 2.0**63).any():
            raise OverflowError("a window's sum of integers is beyond 64 bits")
        out = out if function is Aggregate.SUM else out / np.maximum(counts, 1)
    elif function is Aggregate.MEDIAN:
        out = windows.medians(values, valid)
    elif function is Aggregate.STD:
        out, counts = windows.deviations(exact, valid), counts - 1  # needs two values
    elif function is Aggregate.RSI:
        up, down = (windows.sums(np.where(valid, g, 0)) / np.maximum(counts, 1) for g in (np.maximum(values, 0), np.fmin(values, 0)))
        out = 100 * up / (up - down)
    else:
        places, n = np.arange(windows.n), windows.n
        if function is Aggregate.FIRST:
            at = np.minimum.accumulate(np.where(valid, places, n)[::-1])[::-1][windows.first]
        else:
            at = np.maximum.accumulate(np.where(valid, places, -1))[windows.last]
        out = values[np.clip(at, 0, n - 1)]
    return pa.array(out.astype(float), mask=counts <= 0 if function is not Aggregate.SUM else None)


def block(key: str, interval, functions: dict[str, tuple[str, Aggregate]], peers: bool) -> Callable[[pa.Table], pa.Table]:
    """For ``applyInArrow``: rows of a block, its own ones and those before that their windows reach, to own rows' results."""

    def run(rows: pa.Table) -> pa.Table:
        k, rid = (np.asarray(rows[c].combine_chunks()) for c in ("__k", "__rid"))
        order = np.lexsort((rid, k))
        k, own = k[order], np.asarray(rows["__is_own"].combine_chunks())[order]
        if k.dtype.kind == "i":
            least, span = np.iinfo(np.int64).min, min(interval, np.iinfo(np.int64).max)
            whole = k < least + span  # t - interval is below all integers
            first = np.where(whole, 0, np.searchsorted(k, np.where(whole, 0, k) - span, "right"))
        else:
            first = np.searchsorted(k, k - interval, "right")
        last = np.searchsorted(k, k, "right") - 1 if peers else np.arange(len(k))
        # An interval that is lost in rounding beside the key still holds the row itself.
        windows = Windows(len(k), np.minimum(first, last)[own], last[own])
        back = pa.array(order[own])
        out = {key: rows[key].combine_chunks().take(back), "__rid": pa.array(rid[order][own])}
        with np.errstate(all="ignore"):
            for name, (c, f) in functions.items():
                column = None if f is Aggregate.LENGTH else rows[c].combine_chunks().take(pa.array(order))
                out[name] = evaluate(f, windows, column)
        return pa.table(list(out.values()), names=list(out))

    return run
