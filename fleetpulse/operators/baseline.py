"""The healthy baseline of one slice as a map that composes with those of other slices.

The baseline moves by a small step for every row that it accepts, so it forgets
only after many thousand rows, and handing states from slice to slice would
take one round per slice. But once it is known which rows are accepted, the mean after a
slice is an affine function of the mean before it, and the variance is the variance
before it times a number plus a square polynomial in the mean (from the last row
that hit the floor on, if one did). Such maps compose.

So each slice guesses its entry from its own rows and reports its map; composed in order, the maps
give every entry; each slice runs again from it and finds out whether it still accepts
the same rows. Where it does, its map was right. Where it doesn't, the new
map replaces the old one and only slices behind it run again.

How many rounds that takes depends on the rows of a slice, not on the number of slices: once
a slice holds several times the 1 / alpha rows that the baseline remembers, its exit hardly depends on
what was guessed. Slices much shorter than that still settle, in more rounds.

Within a slice the same idea replaces the loop over rows: given the accepted rows,
means and variances are prefix compositions, found in log2(rows) steps; they say which
rows are accepted, and that is repeated until it stays. Every repetition settles at
least the first row that differed, so what stays is what a sequential pass
accepts. Values equal those of a sequential pass up to the rounding of sums.
"""

from __future__ import annotations

import json
import zlib

import numpy as np

from fleetpulse.params import Prognostics, Sensor

GUESS_ROWS = 1_000
REPEATS = 64  # then the rest of the slice goes row by row


def affine_prefix(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compositions of the maps x -> a x + b, of the first, the first two, and so on."""
    a, b = a.copy(), b.copy()
    step = 1
    while step < len(a):
        b[step:] = a[step:] * b[:-step] + b[step:]
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return a, b


def floored_prefix(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for x -> max(low, a x + b) with a >= 0 and x >= 0."""
    low, a, b = low.copy(), a.copy(), b.copy()
    step = 1
    while step < len(a):
        low[step:] = np.maximum(low[step:], a[step:] * low[:-step] + b[step:])
        b[step:] = a[step:] * b[:-step] + b[step:]
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return low, a, b


class Track:
    """One sensor's baseline over the rows of a slice."""

    def __init__(self, values: np.ndarray, teach: np.ndarray, sensor: Sensor, p: Prognostics):
        span = max(sensor.warning - sensor.baseline, 1e-6)
        self.values, self.teach, self.p = values, teach & np.isfinite(values), p
        self.floor = max(span * p.min_std_fraction, 1e-6)
        self.start = [sensor.baseline, max(span * p.initial_std_fraction, 1e-6) ** 2, 0]

    def guess(self) -> list:
        """A baseline that these rows may have been met with."""
        own = self.values[self.teach][:GUESS_ROWS]
        if not len(own):
            return self.start
        middle = float(np.median(own))
        return [middle, max(self.floor ** 2, float(((own - middle) ** 2).mean())), self.p.baseline_min_samples]

    def follow(self, mean: float, variance: float, count: int) -> None:
        """Means and variances after each row, and which rows were accepted, from a baseline before the first."""
        taken = self.teach
        for _ in range(REPEATS):
            before = self._moments(taken, mean, variance)
            seen = count + np.cumsum(taken) - taken
            accepted = self.teach & self._within(self.values - before[0], before[1], seen)
            if np.array_equal(accepted, taken):
                break
            taken = accepted
        else:
            taken = self._row_by_row(taken, accepted, mean, variance, count)
            self._moments(taken, mean, variance)
        self.taken = taken

    def _moments(self, taken: np.ndarray, mean: float, variance: float) -> tuple[np.ndarray, np.ndarray]:
        step = self.p.baseline_alpha
        keep = np.where(taken, 1.0 - step, 1.0)
        self.scale, shift = affine_prefix(keep, np.where(taken, step * self.values, 0.0))
        self.mean = self.scale * mean + shift
        before = np.concatenate([[mean], self.mean[:-1]])
        self.added = np.where(taken, step * (self.values - before) ** 2, 0.0)
        low, scale, shift = floored_prefix(np.where(taken, self.floor ** 2, 0.0), keep, self.added)
        self.variance = np.maximum(low, scale * variance + shift)
        self.keep, self.mean_before = keep, before
        self.variance_before = np.concatenate([[variance], self.variance[:-1]])
        return self.mean_before, self.variance_before

    def _within(self, away: np.ndarray, variance: np.ndarray, seen: np.ndarray) -> np.ndarray:
        gate = np.where(seen < self.p.baseline_min_samples, self.p.warmup_max_z, self.p.update_max_z)
        return np.abs(away) / np.maximum(np.sqrt(variance), max(self.floor, 1e-9)) <= gate

    def _row_by_row(self, taken: np.ndarray, accepted: np.ndarray, mean: float, variance: float, count: int) -> np.ndarray:
        first = int(np.argmax(taken != accepted))
        out = accepted.copy()
        at, spread, seen = self.mean_before[first], self.variance_before[first], count + int(accepted[:first].sum())
        step = self.p.baseline_alpha
        for i in range(first, len(out)):
            away = self.values[i] - at
            out[i] = self.teach[i] and bool(self._within(away, spread, seen))
            if out[i]:
                at += step * away
                spread = max(self.floor ** 2, (1.0 - step) * spread + step * away * away)
                seen += 1
        return out

    def summary(self) -> dict:
        """The map from the baseline before the slice to the one after it, around the mean it was followed from."""
        step, mean = self.p.baseline_alpha, float(self.mean_before[0])
        raised = self.taken & (self.floor ** 2 > self.keep * self.variance_before + self.added)
        last = int(np.flatnonzero(raised)[-1]) if raised.any() else -1
        later = self.taken.copy()
        later[:last + 1] = False
        weight = np.concatenate([np.cumprod(self.keep[::-1])[::-1][1:], [1.0]])
        scale_before = np.concatenate([[1.0], self.scale[:-1]])
        away = (self.values - self.mean_before)[later]
        w, s = step * weight[later], scale_before[later]
        kept = float(np.prod(self.keep[last + 1:]))
        return {"from": mean, "mean": float(self.mean[-1]), "scale": float(self.scale[-1]), "taken": int(self.taken.sum()),
                "kept": kept if last < 0 else 0.0,
                "square": [float((w * away * away).sum()) + (kept * self.floor ** 2 if last >= 0 else 0.0),
                           float(-2.0 * (w * away * s).sum()), float((w * s * s).sum())],
                "rows": zlib.crc32(np.packbits(self.taken).tobytes()), "floor": last}


def after(summary: dict, mean: float, variance: float, count: int, most: int) -> list:
    """The baseline after a slice that has this map."""
    moved = mean - summary["from"]
    a, b, c = summary["square"]
    return [summary["mean"] + summary["scale"] * moved, summary["kept"] * variance + a + moved * (b + moved * c),
            min(count + summary["taken"], most)]


def composed(start: list[list], exits: list[str], most: int) -> list[str]:
    """Entries of a key's slices in order, from the maps they reported."""
    now, out = start, []
    for text in exits:
        maps = json.loads(text)["maps"]
        out.append(json.dumps({"at": now, "was": maps}))
        now = [after(m, *at, most) for m, at in zip(maps, now)]
    return out


def agree(maps: list[dict], was: list[dict] | None) -> bool:
    """Whether two runs of a slice accepted the same rows and last hit the floor at the same one."""
    return was is not None and all(a["rows"] == b["rows"] and a["floor"] == b["floor"] for a, b in zip(maps, was))
