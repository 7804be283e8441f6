"""Histograms of scores: one specification as array columns and in numpy.

Bins are closed above: a score belongs to the first bin whose upper border is at least the score, and one below the
range to the first bin. `gain` is the mean of the part of the distribution above a threshold, E[X; X > s]; the "excess"
mode takes E[(X - s)+] instead.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def borders(low: Column, high: Column, bins: int) -> Column:
    """The bins + 1 equally spaced borders."""
    return F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: low + (high - low) * (i / F.lit(float(bins))))


def bin_of(score: Column, edges: Column) -> Column:
    """The number of the first bin with score <= upper border, from 0; the last bin for larger scores."""
    below = F.size(F.filter(F.slice(edges, 2, F.size(edges) - 1), lambda b: b < score))
    return F.least(below, F.size(edges) - 2)


def gain(edges: Column, counts: Column, s: Column, mode: str = "tail_mean") -> Column:
    """Expected marginal gain over the threshold s; 0 for an empty histogram."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)

    def part(c: Column, i: Column) -> Column:
        lo, hi = F.get(edges, i), F.get(edges, i + 1)
        start = F.greatest(lo, s)
        mean = (start + hi) / 2 - (s if mode == "excess" else F.lit(0.0))
        return F.when(hi > s, c / total * ((hi - start) / (hi - lo)) * mean).otherwise(F.lit(0.0))

    return F.when(total > 0, F.aggregate(F.transform(counts, part), F.lit(0.0), lambda a, x: a + x)).otherwise(F.lit(0.0))


def rebin(edges: Column, counts: Column, new: Column, decay: float = 1.0) -> Column:
    """The counts over new borders: each old bin's count is dealt by the share of its width, times the decay."""

    def share(lo: Column, hi: Column) -> Column:
        part = F.transform(counts, lambda c, j: c * F.greatest(F.lit(0.0), F.least(hi, F.get(edges, j + 1)) - F.greatest(lo, F.get(edges, j))) / (F.get(edges, j + 1) - F.get(edges, j)))
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x) * F.lit(decay)

    return F.transform(F.sequence(F.lit(0), F.size(new) - 2), lambda i: share(F.get(new, i), F.get(new, i + 1)))


def subtract(counts: Column, other: Column) -> Column:
    """Bin-wise difference of histograms with equal borders, not below 0."""
    return F.zip_with(counts, other, lambda a, b: F.greatest(a - b, F.lit(0.0)))


class Histogram:
    """The same in numpy, for the bandit's state."""

    def __init__(self, low: float, high: float, bins: int, decay: float = 1.0, enlarge: float = 1.1, enlarge_lowest: bool = True):
        self.edges = np.linspace(low, high, bins + 1)
        self.counts, self.total = np.zeros(bins), 0.0
        self.decay, self.enlarge, self.enlarge_lowest = decay, enlarge, enlarge_lowest

    def gain(self, s: float, mode: str = "tail_mean") -> float:
        if self.total == 0:
            return 0.0
        lo, hi = self.edges[:-1], self.edges[1:]
        start = np.maximum(lo, s)
        with np.errstate(divide="ignore", invalid="ignore"):
            part = np.where(hi > s, self.counts / self.total * ((hi - start) / (hi - lo)) * ((start + hi) / 2 - (s if mode == "excess" else 0.0)), 0.0)
        return float(np.nansum(part))

    def rebin(self, new: np.ndarray) -> None:
        width = np.diff(self.edges)
        overlap = np.minimum(new[1:, None], self.edges[None, 1:]) - np.maximum(new[:-1, None], self.edges[None, :-1])
        share = np.divide(np.maximum(overlap, 0), width, out=np.zeros_like(overlap), where=width > 0)
        self.counts, self.edges = share @ self.counts * self.decay, new

    def _grow(self, score: float, s: float) -> None:
        """The range grows when the score or the threshold s is beyond it, and its lowest bin when s is beyond the second border."""
        top, bins = max(score, s), len(self.counts)
        if top > self.edges[-1]:
            self.rebin(np.concatenate([self.edges[:1], np.linspace(self.edges[1], top * self.enlarge, bins)]))
        if self.enlarge_lowest and bins >= 2 and s > self.edges[2]:
            last = s * self.enlarge if s >= self.edges[-1] else self.edges[-1]
            self.rebin(np.concatenate([self.edges[:1], np.linspace(s, last, bins)]))
            self.counts[self.counts <= 0] = 1e-5

    def add(self, score: float, s: float) -> None:
        """Count a score."""
        self.add_range(score, score, 1, s)

    def add_range(self, low: float, high: float, n: float, s: float) -> None:
        """Count n scores of which only the range is known: as if spread evenly over it, those below the lowest border in the first bin."""
        self._grow(high, s)
        if high > low:
            held = np.maximum(np.minimum(high, self.edges[1:]) - np.maximum(low, self.edges[:-1]), 0.0)
            held[0] += max(0.0, min(high, self.edges[0]) - low)
            self.counts += n * held / (high - low)
        else:
            self.counts[min(int(np.searchsorted(self.edges[1:], high)), len(self.counts) - 1)] += n
        self.total += n

    def subtract(self, other: Histogram) -> None:
        """Take another histogram's counts out, dealt over this one's bins, not below 0."""
        copy = Histogram(0, 1, 1)
        copy.edges, copy.counts = other.edges, other.counts
        copy.rebin(self.edges)
        self.counts = np.maximum(self.counts - copy.counts, 0)
        self.total = max(0.0, self.total - other.total)
