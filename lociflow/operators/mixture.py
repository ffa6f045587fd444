"""Ancestry and contamination: the likelihood of a mixture of two samples, fitted by a simplex search.

The pileup is reduced once to counts by (marker, base class, quality).  An
evaluation is a sum over markers; up to ``ON_DRIVER`` count rows (checked) it runs
vectorised on the driver, beyond that as one Spark job over cached partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.operators.genotype import base_class

ON_DRIVER = 2_000_000
AF_LOW, AF_HIGH = 0.00005, 0.99995
MOST_STEPS = 50_000
SMALL = 1e-3
#: P(base class | genotype): rows ref, alt, other; columns 0, 1 and 2 alternative alleles.
RIGHT = np.array([[1, 1 / 2, 0], [0, 1 / 2, 1], [0, 0, 0]])
WRONG = np.array([[0, 1 / 6, 1 / 3], [1 / 3, 1 / 6, 0], [2 / 3, 2 / 3, 2 / 3]])


def sufficient(bases: DataFrame, panel: DataFrame) -> DataFrame:
    """``marker_idx, kind (0 ref, 1 alt, 2 other), qual, n`` of bases at panel markers."""
    own = panel.select("marker_idx", "chrom", "pos", "ref", "alt")
    at = bases.join(own, ["chrom", "pos"])
    kind = base_class(F.col("base"), F.col("ref"), F.col("alt"))
    code = F.when(kind == "ref", 0).when(kind == "alt", 1).otherwise(2)
    return at.groupBy("marker_idx", code.alias("kind"), "qual").agg(F.count(F.lit(1)).alias("n"))


def usual_depth(counts: DataFrame, deviations: float = 3.0) -> DataFrame:
    """Counts of the markers whose depth lies within some deviations of the mean over covered markers."""
    depth = counts.groupBy("marker_idx").agg(F.sum("n").alias("_depth"))
    stats = depth.agg(F.avg("_depth").alias("_mean"), F.stddev_pop("_depth").alias("_sd"))
    fine = F.abs(F.col("_depth") - F.col("_mean")) <= deviations * F.col("_sd")
    kept = depth.join(F.broadcast(stats)).filter(fine).select("marker_idx")  # stats is one row
    return counts.join(kept, "marker_idx", "left_semi")


def enough_markers(counts: DataFrame, panel: DataFrame, least: int = 1000, share: float = 0.1) -> bool:
    """Are more than ``least`` markers and more than a share of the panel covered?"""
    covered = counts.select("marker_idx").distinct().count()
    return covered > least and covered > share * panel.count()


def marker_llk(
    marker: np.ndarray, kind: np.ndarray, qual: np.ndarray, n: np.ndarray, af1: np.ndarray, af2: np.ndarray, alpha: float
) -> float:
    """The summed log-likelihood of markers 0 .. len(af1) - 1 with counts sorted by marker."""
    if not len(marker):
        return 0.0
    error = 10.0 ** (-qual / 10)
    starts = np.flatnonzero(np.r_[True, marker[1:] != marker[:-1]])
    which = marker[starts]
    total = np.full(len(starts), -np.inf)
    freq = lambda af: np.stack([(1 - af) ** 2, 2 * af * (1 - af), af**2])
    f1, f2 = (freq(np.clip(af[which], AF_LOW, AF_HIGH)) for af in (af1, af2))
    for g1 in range(3):
        for g2 in range(3):
            mixed = lambda table: alpha * table[kind, g1] + (1 - alpha) * table[kind, g2]  # noqa: B023, E731
            with np.errstate(divide="ignore"):
                log = np.log(mixed(WRONG) * error + mixed(RIGHT) * (1 - error)) * n
            total = np.logaddexp(total, np.add.reduceat(log, starts) + np.log(f1[g1] * f2[g2]))
    return float(total[np.isfinite(total)].sum())


class Likelihood:
    """Evaluates (pc1, pc2, alpha) over counts joined with their panel rows."""

    def __init__(self, counts: DataFrame, panel: DataFrame, known_af: DataFrame | None = None):
        own = panel.select("marker_idx", "mu", "ud")
        if known_af is not None:
            own = own.join(known_af.select("marker_idx", "af"), "marker_idx")
            own = own.select("marker_idx", (2 * F.col("af")).alias("mu"), F.transform("ud", lambda x: x * 0).alias("ud"))
        self.rows = counts.join(own, "marker_idx").select("marker_idx", "kind", "qual", "n", "mu", "ud")
        self.evaluations = 0
        self.local = None
        table = self.rows.limit(ON_DRIVER + 1).toArrow()
        if table.num_rows <= ON_DRIVER:
            self.local = self._arrays(table)
        else:
            self.rows = self.rows.repartition("marker_idx").sortWithinPartitions("marker_idx").persist()

    @staticmethod
    def _arrays(table: pa.Table) -> tuple:
        marker = table.column("marker_idx").to_numpy()
        order = np.argsort(marker, kind="stable")
        kind, qual, n, mu = (table.column(c).to_numpy()[order] for c in ("kind", "qual", "n", "mu"))
        ud = np.array(table.column("ud").to_pylist(), np.float64).reshape(len(order), -1)[order]
        marker = marker[order]
        first = np.flatnonzero(np.r_[True, marker[1:] != marker[:-1]]) if len(marker) else np.zeros(0, int)
        dense = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(marker)]))
        return dense, kind, qual.astype(float), n.astype(float), mu[first], ud[first]

    @staticmethod
    def _value(arrays: tuple, pc1: np.ndarray, pc2: np.ndarray, alpha: float) -> float:
        dense, kind, qual, n, mu, ud = arrays
        af = lambda pc: (ud[:, : len(pc)] @ pc + mu) / 2 if len(mu) else mu
        return marker_llk(dense, kind, qual, n, af(pc1), af(pc2), alpha)

    def __call__(self, pc1: np.ndarray, pc2: np.ndarray, alpha: float) -> float:
        self.evaluations += 1
        if self.local is not None:
            return self._value(self.local, pc1, pc2, alpha)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = list(batches)
            value = Likelihood._value(Likelihood._arrays(pa.Table.from_batches(own)), pc1, pc2, alpha) if own else 0.0
            yield pa.RecordBatch.from_arrays([pa.array([value])], names=["llk"])

        return self.rows.mapInArrow(run, "llk double").agg(F.sum("llk")).first()[0] or 0.0


def simplex(f: Callable[[np.ndarray], float], start: np.ndarray, tolerance: float = 1e-8, steps: int = MOST_STEPS) -> tuple[np.ndarray, float]:
    """Minimum by reflection, expansion, contraction and shrinking of a simplex with unit edges."""
    points = np.vstack([start, start + np.eye(len(start))])
    values = np.array([f(p) for p in points])
    used = len(values)
    while used < steps:
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        level = 2 * abs(values[-1] - values[0]) <= tolerance * (abs(values[-1]) + abs(values[0]) + 1e-12)
        if level and np.abs(points - points[0]).max() <= SMALL:  # equal values alone may lie on both sides of the minimum
            break
        centre = points[:-1].mean(axis=0)

        def at(t: float) -> tuple[np.ndarray, float]:
            p = centre + t * (points[-1] - centre)  # noqa: B023
            return p, f(p)

        p, v = at(-1.0)
        used += 1
        if v < values[0]:
            q, w = at(-2.0)
            used += 1
            p, v = (q, w) if w < v else (p, v)
        elif v >= values[-2]:
            q, w = at(-0.5 if v < values[-1] else 0.5)
            used += 1
            if w < min(v, values[-1]):
                p, v = q, w
            else:
                points[1:] = points[0] + (points[1:] - points[0]) / 2
                values[1:] = [f(x) for x in points[1:]]
                used += len(values) - 1
                continue
        points[-1], values[-1] = p, v
    best = int(values.argmin())
    return points[best], float(values[best])


@dataclass
class Fit:
    pc1: list[float]
    pc2: list[float]
    alpha: float
    llk1: float
    llk0: float
    evaluations: int


def fit(
    llk: Likelihood,
    dims: int,
    within: bool = False,
    fix_pc: list[float] | None = None,
    fix_alpha: float | None = None,
    tolerance: float = 1e-8,
) -> Fit:
    """One of six modes: same or different ancestry, everything free or fixed PCs or a fixed alpha.

    pc1 is of the contaminating, pc2 of the intended sample.  The modes with
    different ancestry start from the fit with the same one.  At an alpha of a
    half or more the samples change places.
    """
    expit = lambda x: 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))
    start_pc, start_alpha = [0.01] * dims, math.log(0.03 / 0.97)
    best = {"llk": -math.inf}

    def split(x: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, float]:
        x = list(x)
        if fix_pc is not None:
            pc2 = np.array(fix_pc)
            pc1 = pc2 if same else np.array([x.pop(0) for _ in range(dims)])
        else:
            pc2 = np.array([x.pop(0) for _ in range(dims)])
            pc1 = pc2 if same else np.array([x.pop(0) for _ in range(dims)])
        return pc1, pc2, fix_alpha if fix_alpha is not None else expit(x.pop(0))

    def run(same: bool, start: list[float]) -> np.ndarray:
        def objective(x: np.ndarray) -> float:
            pc1, pc2, alpha = split(x, same)
            value = llk(pc1, pc2, alpha)
            if value > best["llk"]:
                best.update(llk=value, pc1=pc1, pc2=pc2, alpha=alpha)
            return -value

        if not start:
            objective(np.zeros(0))
            return np.zeros(0)
        return simplex(objective, np.array(start), tolerance)[0]

    tail = [] if fix_alpha is not None else [start_alpha]
    x = run(True, ([] if fix_pc is not None else list(start_pc)) + tail)
    if not within:
        x = list(x)
        own = [] if fix_pc is not None else x[:dims]
        run(False, own + (x[:dims] if fix_pc is None else list(fix_pc)) + x[len(own) :])
    pc1, pc2, alpha = best["pc1"], best["pc2"], best["alpha"]
    if alpha >= 0.5:
        pc1, pc2, alpha = pc2, pc1, 1 - alpha
    null = llk(pc2, pc2, 0.0)
    return Fit([float(v) for v in pc1], [float(v) for v in pc2], float(alpha), best["llk"], null, llk.evaluations)
