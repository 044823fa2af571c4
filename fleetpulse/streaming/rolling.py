"""Trend windows of a stream that add and evict rows.

A machine's committed rows lie in numbered chunks of equal size. Each window length
remembers the position of its oldest row and running sums over the rows from there
on. A batch adds its rows to the sums, reads the chunks between the old and the new
oldest row, and takes those rows off; rows in between are neither read nor parsed.
Chunks that every window has left are dropped.

Sums are kept in extended precision, as a double and its remainder, with time
measured from near the window's start; they begin anew whenever a row has the window
to itself. So rounding does not build up over the life of a stream.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from fleetpulse.params import MINUTE_US, SENSOR_KEYS, WINDOWS_MIN

CHUNK_ROWS = 256
CHUNK_SCHEMA = "us array<bigint>, cells array<double>"
BOOK_SCHEMA = ("end bigint, last_us bigint, last_break bigint, first_chunk bigint, anchor array<double>, "
               "heads array<bigint>, origins array<bigint>, sums array<double>")
WIDE = np.longdouble


class MemoryRows:
    """Chunks in a dictionary, for one machine on its own."""

    def __init__(self):
        self.chunks: dict[int, tuple] = {}

    def get(self, k: int) -> tuple:
        return self.chunks[k]

    def put(self, k: int, us: list, cells: list) -> None:
        self.chunks[k] = (us, cells)

    def drop(self, k: int) -> None:
        self.chunks.pop(k)


class StateRows:
    """Chunks in the map state of a stateful processor."""

    def __init__(self, state):
        self.state = state

    def get(self, k: int) -> tuple:
        return self.state.getValue((k,))

    def put(self, k: int, us: list, cells: list) -> None:
        self.state.updateValue((k,), (us, cells))

    def drop(self, k: int) -> None:
        self.state.removeKey((k,))


@dataclass
class Book:
    """What is kept of the windows beside the rows."""
    end: int = 0
    last_us: int = 0
    last_break: int = -1
    first_chunk: int = 0
    anchor: list = field(default_factory=list)
    heads: list = field(default_factory=list)
    origins: list = field(default_factory=list)
    sums: list = field(default_factory=list)

    def row(self) -> tuple:
        return (self.end, self.last_us, self.last_break, self.first_chunk, self.anchor, self.heads, self.origins, self.sums)


def _split(sums: np.ndarray) -> list[float]:
    high = sums.astype(float)
    return [*high.tolist(), *(sums - high).astype(float).tolist()]


def _joined(flat: Sequence[float]) -> np.ndarray:
    half = len(flat) // 2
    return np.array(flat[:half], dtype=WIDE) + np.array(flat[half:], dtype=WIDE)


def _moved(sums: np.ndarray, count: int, d) -> np.ndarray:
    """Sums of the same rows with time measured from ``d`` later."""
    n = (len(sums) - 2) // 2
    out = sums.copy()
    out[0] = sums[0] - count * d
    out[1] = sums[1] - 2 * d * sums[0] + count * d * d
    out[2 + n:] = sums[2 + n:] - d * sums[2:2 + n]
    return out


class RollingWindows:
    """Row-anchored windows of one machine over its committed rows, closed on both sides."""

    def __init__(self, expected_s: float, max_gap_s: float, rows=None, book: Sequence | None = None,
                 sensors: Sequence[str] = SENSOR_KEYS, windows_min: Sequence[int] = WINDOWS_MIN):
        self.expected_s, self.max_gap_s = expected_s, max_gap_s
        self.sensors, self.windows_min = tuple(sensors), tuple(windows_min)
        self.rows = MemoryRows() if rows is None else rows
        self.book = Book(*[list(v) if isinstance(v, (list, tuple, np.ndarray)) else v for v in book]) if book else Book()

    def clear(self) -> None:
        """Forget all rows."""
        if self.book.end:
            for k in range(self.book.first_chunk, (self.book.end - 1) // CHUNK_ROWS + 1):
                self.rows.drop(k)
        self.book = Book()

    def add(self, us: np.ndarray, values: np.ndarray) -> dict[str, np.ndarray]:
        """Statistics of new rows, which follow all earlier ones in time, one array per column."""
        if not len(us):
            return {}
        b = self.book
        if not b.end:
            b.anchor = values[0].tolist()
            b.heads = [0] * len(self.windows_min)
            b.origins = [int(us[0])] * len(self.windows_min)
            b.sums = [0.0] * (len(self.windows_min) * 4 * (1 + len(self.sensors)))
            b.last_us = int(us[0])
        gap_s = np.diff(us, prepend=b.last_us) / 1e6
        places = b.end + np.arange(len(us))
        breaks = np.maximum(np.maximum.accumulate(np.where(gap_s > self.max_gap_s, places, -1)), b.last_break)
        read: dict[int, tuple] = {}
        out: dict[str, np.ndarray] = {}
        size = len(b.sums) // len(self.windows_min)
        for j, m in enumerate(self.windows_min):
            sums = _joined(b.sums[j * size:(j + 1) * size])
            lo, start, slopes, sums = self._window(j, m * MINUTE_US, us, values, sums, read)
            b.sums[j * size:(j + 1) * size] = _split(sums)
            count = (places - lo + 1).astype(float)
            needed = max(1.0, m * 60.0 / self.expected_s)
            broken = breaks > lo
            shared = {"sample_count": count, "coverage_fraction": np.minimum(1.0, count / (needed + 1.0)),
                      "gap_or_discontinuity": broken.astype(float), "feature_available": (~broken).astype(float),
                      "available_history_duration_seconds": (us - start) / 1e6}
            for i, k in enumerate(self.sensors):
                cells = {"slope_per_hour": slopes[i], **shared}
                out.update({f"{k}__w{m}m__{n}": v for n, v in cells.items()})
        self._append(us, values)
        b.last_us, b.last_break = int(us[-1]), int(breaks[-1])
        keep = min(b.heads) // CHUNK_ROWS
        for k in range(b.first_chunk, keep):
            self.rows.drop(k)
        b.first_chunk = max(b.first_chunk, keep)
        return out

    def _leaving(self, head: int, edge: int, read: dict) -> tuple[np.ndarray, np.ndarray]:
        """Kept rows from ``head`` to the first one that is not before ``edge``."""
        n = len(self.sensors)
        times, cells = [np.empty(0, dtype=np.int64)], [np.empty((0, n))]
        while head < self.book.end:
            k, skip = divmod(head, CHUNK_ROWS)
            if k not in read:
                us, flat = self.rows.get(k)
                read[k] = (np.array(us, dtype=np.int64), np.array(flat, dtype=float).reshape(-1, n))
            us, block = read[k]
            stop = int(np.searchsorted(us, edge)) + 1
            times.append(us[skip:stop])
            cells.append(block[skip:stop])
            if stop <= len(us):
                break
            head = (k + 1) * CHUNK_ROWS
        return np.concatenate(times), np.concatenate(cells)

    def _window(self, j: int, width: int, us, values, sums, read):
        """Oldest place and time per new row, slopes per sensor, and the sums afterwards."""
        b = self.book
        old_us, old_values = self._leaving(b.heads[j], int(us[-1]) - width, read)
        full_us, full = np.concatenate([old_us, us]), np.concatenate([old_values, values])
        # Old rows end at the first one that stays, or reach up to the new rows.
        left = np.searchsorted(full_us, us - width)
        own = len(old_us) + np.arange(len(us))
        alone = left == own
        y = full.astype(WIDE) - np.array(b.anchor, dtype=WIDE)
        turn = np.diff(us // (8 * width), prepend=us[0] // (8 * width)) != 0
        starts = np.flatnonzero(turn | alone)
        starts = np.unique(np.concatenate([[0], starts]))
        n, hours = len(self.sensors), width / 3.6e9
        slopes = np.zeros((n, len(us)))
        place, head, origin = b.end - b.heads[j], 0, b.origins[j]
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(us)]):
            # ``place``: rows that the sums hold; ``head``: the oldest of them in ``full``.
            if alone[a]:
                sums, place, head = np.zeros_like(sums), 0, int(left[a])
            to = int(full_us[head])
            sums = _moved(sums, place, WIDE(to - origin) / width)
            origin, stop = to, int(left[z - 1])

            def cells(begin, end):
                x = (full_us[begin:end] - origin).astype(WIDE)[:, None] / width
                part = np.concatenate([x, x * x, y[begin:end], x * y[begin:end]], axis=1)
                return np.concatenate([np.zeros((1, part.shape[1]), dtype=WIDE), np.cumsum(part, axis=0)])

            came, gone = cells(int(own[a]), int(own[z - 1]) + 1), cells(head, stop)
            now = sums + came[1:] - gone[left[a:z] - head]
            count = (b.end + np.arange(a, z)) - (b.heads[j] + left[a:z]) + 1
            spread = count * now[:, 1] - now[:, 0] ** 2
            sloped = (count >= 3) & (np.abs(spread) * hours * hours > 1e-9)
            for i in range(n):
                cross = count * now[:, 2 + n + i] - now[:, 0] * now[:, 2 + i]
                slopes[i, a:z] = np.where(sloped, cross / np.where(sloped, spread, 1) / hours, 0.0).astype(float)
            place += (z - a) - (stop - head)
            sums, head = now[-1], stop
        lo = b.heads[j] + left
        b.heads[j], b.origins[j] = int(lo[-1]), origin
        return lo, full_us[left], slopes, sums

    def _append(self, us, values) -> None:
        b, at = self.book, 0
        while at < len(us):
            k, used = divmod(b.end, CHUNK_ROWS)
            take = min(CHUNK_ROWS - used, len(us) - at)
            old_us, old_cells = self.rows.get(k) if used else ([], [])
            self.rows.put(k, [*map(int, old_us), *us[at:at + take].tolist()],
                          [*map(float, old_cells), *values[at:at + take].ravel().tolist()])
            b.end += take
            at += take
