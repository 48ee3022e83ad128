"""Scalar arithmetic: keyed randomness, entropies, ratios."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_uniform(key: Column) -> Column:
    """Stable pseudo-random number in [0, 1) derived from a string key."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def log2_n_words(n: Column) -> Column:
    return F.log2(n + F.lit(1.0))


def xlnx(x: Column) -> Column:
    """x ln x, 0 at (or, through round-off, below) 0 and at 1."""
    return F.when((x <= 0) | (x == 1), F.lit(0.0)).otherwise(x * F.log(x))


def binary_entropy(p: Column) -> Column:
    """Entropy of a coin with bias p, in bits."""
    return (xlnx(p) + xlnx(F.lit(1.0) - p)) / F.lit(math.log(0.5))


def smoothed_ratio(own: Column, parent: Column, smoothing: float = 10.0) -> Column:
    return own / (parent + F.lit(smoothing))


def decimal_bucket(x: Column) -> Column:
    """Lower edge of the bucket of width 0.1 holding x."""
    return F.floor(x * 10) / F.lit(10.0)


# Gauss-Legendre nodes and weights of five points on [-1, 1].
NODES = [0.0, -0.5384693101056831, 0.5384693101056831, -0.9061798459386640, 0.9061798459386640]
NODE_WEIGHTS = [0.5688888888888889, 0.4786286704993665, 0.4786286704993665, 0.2369268850561891, 0.2369268850561891]
PANELS = 256
TAIL_DEVIATIONS = 40.0


def beta_tail(threshold: Column, true_pos: Column, false_neg: Column) -> Column:
    """P(recall < threshold) under a flat prior: I_t(1+TP, 1+FN).

    The density x^TP (1-x)^FN, scaled to 1 at its peak, is integrated below and above the threshold on a fixed number of
    panels over the peak's surroundings, so the work does not depend on the counts.
    """
    tp, fn = true_pos.cast("double"), false_neg.cast("double")
    n = tp + fn
    peak = F.when(n > 0, tp / n).otherwise(0.5)
    mean = (tp + 1) / (n + 2)
    sd = F.sqrt(mean * (1 - mean) / (n + 3))
    low = F.greatest(F.lit(0.0), F.least(peak, mean) - TAIL_DEVIATIONS * sd)
    high = F.least(F.lit(1.0), F.greatest(peak, mean) + TAIL_DEVIATIONS * sd)

    def powered(x: Column, of: Column, count: Column) -> Column:
        return F.when(count > 0, count * F.log(x / of)).otherwise(0.0)

    def density(x: Column) -> Column:
        return F.exp(powered(x, peak, tp) + powered(1 - x, 1 - peak, fn))

    def integral(start: Column, end: Column) -> Column:
        step = (end - start) / PANELS

        def add(acc, i):
            nodes = [w * density(start + step * (i + (1 + x) / 2)) for x, w in zip(NODES, NODE_WEIGHTS)]
            return acc + sum(nodes[1:], nodes[0])

        return F.aggregate(F.sequence(F.lit(0), F.lit(PANELS - 1)), F.lit(0.0), add) * step / 2

    below, above = integral(low, F.least(threshold, high)), integral(F.greatest(threshold, low), high)
    return F.when(threshold <= low, 0.0).when(threshold >= high, 1.0).otherwise(below / (below + above))
