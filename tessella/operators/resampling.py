"""Bootstraps. Units (families, rows) are drawn by Poisson(1) weights, the limit of drawing them with
replacement; the data are read once and reduced to counts per unit and cell, each task
multiplies its units by the weights of all replicates, and one number a replicate and cell leaves it."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels in their order, and what counts as urgent.
LABELS = ("anamnesis", "faq", "booking", "unsupported")
URGENT = ("urgent", "emergency", "high")
#: A multiplicative generator: draw r of a unit is its seed times A^r modulo P.
P, A = 2_147_483_647, 48_271
POISSON = [round(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)), 12) for k in range(8)]


def seed_of(key: Column, seed: int = 42) -> Column:
    """A unit's seed, 1 .. P-1, from md5 of its key: the same on any engine."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}"))), 1, 15), 16, 10).cast("bigint") % (P - 1) + 1


def sums(cells: DataFrame, n_cells: int, reps: int) -> np.ndarray:
    """``[n_cells, reps + 1]`` weighted sums of ``cells(unit, cell, n)``: column 0 unweighted, then one a
    replicate. ``unit`` is :func:`seed_of` a key."""
    draw = np.array([pow(A, r + 1, P) for r in range(reps)], np.int64)
    cuts = np.array(POISSON)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_cells, reps + 1))
        for b in batches:
            unit, cell, n = (b.column(c).to_numpy() for c in ("unit", "cell", "n"))
            for lo in range(0, len(unit), 512):
                u, c = unit[lo : lo + 512], cell[lo : lo + 512]
                w = np.searchsorted(cuts, (u[:, None] * draw[None] % P) / P, "right")
                share = np.zeros((n_cells, len(u)))
                share[c, np.arange(len(u))] = n[lo : lo + 512]
                total += share @ np.concatenate([np.ones((len(u), 1)), w], 1)
        k, r = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(r.astype(np.int32)), pa.array(total[k, r])], ["cell", "rep", "n"])

    part = cells.select("unit", F.col("cell").cast("int").alias("cell"), F.col("n").cast("double").alias("n")).mapInArrow(run, "cell int, rep int, n double")
    rows = part.groupBy("cell", "rep").agg(F.sum("n").alias("n")).toPandas()  # replicates x cells
    out = np.zeros((n_cells, reps + 1))
    out[rows["cell"], rows["rep"]] = rows["n"]
    return out


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a, dtype=float), where=b != 0)


def accuracy(c: np.ndarray) -> np.ndarray:
    return _ratio(np.trace(c.sum(-3), axis1=-2, axis2=-1), c.sum((-3, -2, -1)))


def macro_f1(c: np.ndarray) -> np.ndarray:
    """Over the labels seen on either side."""
    m = c.sum(-3)
    tp, t, p = np.diagonal(m, axis1=-2, axis2=-1), m.sum(-1), m.sum(-2)
    return _ratio(_ratio(2 * tp, t + p).sum(-1), (t + p > 0).sum(-1).astype(float))


def recall_anamnesis(c: np.ndarray) -> np.ndarray:
    m = c.sum(-3)
    return _ratio(m[..., 0, 0], m[..., 0, :].sum(-1))


def recall_urgent(c: np.ndarray) -> np.ndarray:
    """Urgent messages of whatever label that were routed to anamnesis."""
    return _ratio(c[..., 1, :, 0].sum(-1), c[..., 1, :, :].sum((-2, -1)))


#: Metrics of confusion counts ``[..., urgent, true, predicted]``.
METRICS: dict[str, Callable[[np.ndarray], np.ndarray]] = {f.__name__: f for f in (accuracy, macro_f1, recall_anamnesis, recall_urgent)}
CELLS = 2 * len(LABELS) ** 2


def confusion_cells(df: DataFrame, family: Column, true: str, pred: str, urgency: str, offset: int = 0) -> DataFrame:
    """``(unit, cell, n)``: counts per family and cell of urgency, true and predicted label. Rows with another label have no cell."""
    at = lambda c: F.array_position(F.array(*[F.lit(x) for x in LABELS]), c).cast("int") - 1
    k = len(LABELS)
    urgent = F.coalesce(F.col(urgency).isin(*URGENT), F.lit(False)).cast("int")
    cell = urgent * k * k + at(F.col(true)) * k + at(F.col(pred)) + offset
    rows = df.where(F.col(true).isin(*LABELS) & F.col(pred).isin(*LABELS)).select(seed_of(family).alias("unit"), cell.alias("cell"))
    return rows.groupBy("unit", "cell").agg(F.count(F.lit(1)).alias("n"))


def _shaped(s: np.ndarray) -> np.ndarray:
    k = len(LABELS)
    return np.moveaxis(s, 0, -1).reshape(s.shape[1], 2, k, k)


def jackknife(cells: DataFrame, point: np.ndarray) -> dict[str, float]:
    """Acceleration of every metric from its values with one family left out. Sums of powers about the full
    value leave each task."""
    k, total = len(LABELS), point

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(METRICS), 4))
        for b in batches:
            c, n = b.column("cell"), b.column("n")
            off = np.asarray(c.offsets)
            rec = np.repeat(np.arange(len(c)), np.diff(off))
            own = np.zeros((len(c), CELLS))
            np.add.at(own, (rec, c.flatten().to_numpy()), n.flatten().to_numpy())
            left = (total[None] - own).reshape(-1, 2, k, k)
            for m, f in enumerate(METRICS.values()):
                d = f(left) - f(total.reshape(1, 2, k, k))
                out[m] += [len(d), d.sum(), (d**2).sum(), (d**3).sum()]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["n", "s1", "s2", "s3"]).assign(m=range(len(METRICS))), preserve_index=False)

    each = cells.groupBy("unit").agg(F.collect_list(F.col("cell").cast("int")).alias("cell"), F.collect_list(F.col("n").cast("double")).alias("n"))  # a family's cells
    got = each.select("cell", "n").mapInArrow(run, "n double, s1 double, s2 double, s3 double, m bigint").groupBy("m").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2", "s3")]).toPandas()
    acc = dict.fromkeys(METRICS, 0.0)
    for r in got.itertuples():
        if r.n >= 2:
            mean = r.s1 / r.n
            d2 = r.s2 - r.n * mean**2
            d3 = -(r.s3 - 3 * mean * r.s2 + 2 * r.n * mean**3)  # of mean - value
            acc[list(METRICS)[int(r.m)]] = d3 / (6 * d2**1.5) if d2 > 1e-18 else 0.0
    return acc


def bca_quantiles(point: float, values: np.ndarray, acceleration: float, alpha: float = 0.05) -> tuple[float, float]:
    """Quantiles that a bias-corrected and accelerated interval takes instead of alpha/2 and 1 - alpha/2."""
    nd = NormalDist()
    z0 = nd.inv_cdf(min(max(float((values < point).mean()), 1e-6), 1 - 1e-6))
    out = []
    for q in (alpha / 2, 1 - alpha / 2):
        z = z0 + nd.inv_cdf(q)
        out.append(min(max(nd.cdf(z0 + z / (1 - acceleration * z)), 0.0), 1.0))
    return out[0], out[1]


def family_bootstrap(df: DataFrame, family: Column, true: str, pred: str, urgency: str, reps: int = 2000, alpha: float = 0.05, bca: bool = True) -> DataFrame:
    """``(metric, point, low, high, bca_low, bca_high)`` of every metric; the ``bca`` pair is NULL if not asked for. No rows: all 0."""
    cells = confusion_cells(df, family, true, pred, urgency)
    c = _shaped(sums(cells, CELLS, reps))
    acc = jackknife(cells, c[0].ravel()) if bca else {}
    rows = []
    for name, f in METRICS.items():
        v = f(c)
        point, draws = float(v[0]), v[1:]
        low, high = np.quantile(draws, [alpha / 2, 1 - alpha / 2])
        b = np.quantile(draws, bca_quantiles(point, draws, acc[name], alpha)) if bca else (None, None)
        rows.append((name, round(point, 6), round(float(low), 6), round(float(high), 6), *(None if x is None else round(float(x), 6) for x in b)))
    return df.sparkSession.createDataFrame(rows, "metric string, point double, low double, high double, bca_low double, bca_high double")


def paired_bootstrap(df: DataFrame, family: Column, true: str, a: str, b: str, urgency: str, reps: int = 2000) -> DataFrame:
    """``(metric, delta, delta_mean, low, high, p_value, significant)`` of metric(a) - metric(b), both on the same
    draws; ``p_value`` is the share of draws at or below 0, ``significant`` an interval beside 0."""
    cells = confusion_cells(df, family, true, a, urgency).union(confusion_cells(df, family, true, b, urgency, CELLS))
    s = sums(cells, 2 * CELLS, reps)
    x, y = _shaped(s[:CELLS]), _shaped(s[CELLS:])
    rows = []
    for name, f in METRICS.items():
        d = f(x) - f(y)
        low, high = (float(q) for q in np.quantile(d[1:], [0.025, 0.975]))
        rows.append((name, round(float(d[0]), 6), round(float(d[1:].mean()), 6), round(low, 6), round(high, 6), round(float((d[1:] <= 0).mean()), 6), bool(low > 0 or high < 0)))
    return df.sparkSession.createDataFrame(rows, "metric string, delta double, delta_mean double, low double, high double, p_value double, significant boolean")


def aligned(long: DataFrame, key: str, mode: str, modes: list[str]) -> DataFrame:
    """Rows of the keys that every one of ``modes`` has: the n-way paired alignment."""
    rows = long.where(F.col(mode).isin(*modes))
    whole = rows.groupBy(key).agg(F.countDistinct(mode).alias("_n")).where(F.col("_n") == len(set(modes))).select(key)
    return rows.join(whole, key)


def mean_bootstrap(long: DataFrame, key: str, mode: str, value: str, modes: list[str], reps: int = 2000) -> dict[str, np.ndarray]:
    """``{mode: means}`` of the rows and of each replicate, the same draws of ``key`` for all modes."""
    at = F.array_position(F.array(*[F.lit(m) for m in modes]), F.col(mode)).cast("int") - 1
    r = long.select(seed_of(F.col(key)).alias("unit"), at.alias("k"), F.col(value).cast("double").alias("v")).where("v is not null")
    cells = r.select("unit", F.explode(F.array(F.struct((2 * F.col("k")).alias("cell"), F.col("v").alias("n")), F.struct((2 * F.col("k") + 1).alias("cell"), F.lit(1.0).alias("n")))).alias("c")).select("unit", "c.cell", "c.n")
    s = sums(cells, 2 * len(modes), reps)
    return {m: _ratio(s[2 * i], s[2 * i + 1]) for i, m in enumerate(modes)}
