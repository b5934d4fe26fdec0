"""Resampling and tests. Sums and ranks are plans; only closed-form tails of single numbers are Python."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import written


def discordant(df: DataFrame, true: str, a: str, b: str) -> DataFrame:
    """``(b, c)``: rows only the first or only the second gets right."""
    x, y = F.col(a) == F.col(true), F.col(b) == F.col(true)
    return df.agg(F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"))


def mcnemar_p(b: int, c: int) -> float:
    """Exact two-sided McNemar: twice the smaller binomial tail, 1 without discordant rows."""
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    tail = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1))
    return min(1.0, 2 * tail)


def average_rank(order: Column, *partition: str) -> Column:
    """Rank with ties at their mean."""
    w = Window.partitionBy(*partition)
    return F.rank().over(w.orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, order)) - 1) / 2


def signed_ranks(df: DataFrame, diff: str, *keys: str) -> DataFrame:
    """``(*keys, n, w_plus, w_minus, ties)`` of the non-zero differences; ``ties`` is the sum of t^3 - t over
    groups of equal size. Ranks come from counts per distinct absolute value, and those from sorted ranges
    numbered from their offsets, so no task orders all values."""
    d = df.where(F.col(diff) != 0).groupBy(*keys, F.abs(diff).alias("v")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col(diff) > 0).alias("pos"))
    d = written(d.repartitionByRange(*[F.col(k) for k in keys], F.col("v")).withColumn("_p", F.spark_partition_id()), "ranges")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    part = d.groupBy(*keys, "_p").agg(F.sum("c").alias("_n"))
    part = part.withColumn("_off", F.coalesce(F.sum("_n").over(before(Window.partitionBy(*keys).orderBy("_p"))), F.lit(0))).drop("_n")  # one row a range
    inside = F.coalesce(F.sum("c").over(before(Window.partitionBy(*keys, "_p").orderBy("v"))), F.lit(0))
    d = d.withColumn("_in", inside).join(F.broadcast(part), [*keys, "_p"])
    d = d.withColumn("r", F.col("_off") + F.col("_in") + (F.col("c") + 1) / 2)
    some = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return d.groupBy(*keys).agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), some(F.col("r") * F.col("pos")).alias("w_plus"), some(F.col("r") * (F.col("c") - F.col("pos"))).alias("w_minus"),
        F.coalesce(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")), F.lit(0)).alias("ties"),
    )


def wilcoxon_z(n: Column, w_plus: Column, w_minus: Column, ties: Column) -> Column:
    """Normal deviate of a signed-rank sum, ties corrected; NULL without differences."""
    se = F.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    return F.when((n > 0) & (se > 0), (F.least(w_plus, w_minus) - n * (n + 1) / 4) / se)


def wilcoxon_p(n: int, w: float, ties: float = 0.0, exact: bool | None = None) -> float:
    """Two-sided p of a signed-rank sum: counted exactly up to 50 differences without ties
    (``exact`` says otherwise), else normal with ties corrected; 1 without differences."""
    if n == 0:
        return 1.0
    if exact if exact is not None else n <= 50 and not ties:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for k in range(1, n + 1):
            for s in range(len(ways) - 1, k - 1, -1):
                ways[s] += ways[s - k]
        low = int(min(w, n * (n + 1) / 2 - w))
        return min(1.0, 2 * sum(ways[: low + 1]) / 2**n)
    var = (n * (n + 1) * (2 * n + 1) - ties / 2) / 24
    if var <= 0:
        return 1.0
    z = (min(w, n * (n + 1) / 2 - w) - n * (n + 1) / 4) / math.sqrt(var)
    return min(1.0, 2 * NormalDist().cdf(z))


def chi2_tail(x: float, k: int) -> float:
    """P(chi-square with ``k`` degrees of freedom >= x), by the recurrence over k."""
    if x <= 0 or k < 1:
        return 1.0
    tail, term = (math.exp(-x / 2), math.exp(-x / 2)) if k % 2 == 0 else (math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2))
    if k % 2 == 0:
        for j in range(1, k // 2):
            term *= x / 2 / j
            tail += term
    else:
        for j in range(1, (k - 1) // 2 + 1):
            tail += term
            term *= x / (2 * j + 1)
    return min(1.0, tail)


def friedman(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """``(blocks, treatments, chi2, p_value)`` of ranks within blocks, ties at their mean and corrected;
    fewer than three blocks, or all tied, give 0 and 1."""
    r = df.withColumn("r", average_rank(F.col(value), block))
    tied = r.groupBy(block, value).agg(F.count(F.lit(1)).alias("t")).agg(F.coalesce(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")), F.lit(0)).alias("ties"))
    s = r.groupBy(treatment).agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("n"))
    k, n = F.col("treatments"), F.col("blocks")
    one = s.agg(F.coalesce(F.max("n"), F.lit(0)).alias("blocks"), F.count(F.lit(1)).alias("treatments"), F.sum(F.col("s") * F.col("s")).alias("s2")).join(tied)
    c = 1 - F.col("ties") / (k * (k * k - 1) * n)
    chi2 = F.when((n >= 3) & (k >= 2) & (c > 0), (12 / (n * k * (k + 1)) * F.col("s2") - 3 * n * (k + 1)) / c).otherwise(0.0)
    one = one.select("blocks", "treatments", F.round(chi2, 6).alias("chi2"))

    def tail(parts):
        for p in parts:
            yield p.assign(p_value=[round(chi2_tail(x, int(t) - 1), 9) for x, t in zip(p["chi2"], p["treatments"], strict=True)])

    return one.mapInPandas(tail, "blocks bigint, treatments bigint, chi2 double, p_value double")


def cohens_d(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """Pooled effect size of group ``a`` over ``b``; 0 for under two rows or no spread."""
    g = lambda x: F.when(F.col(group) == x, F.col(value).cast("double"))
    s = df.agg(F.count(g(a)).alias("na"), F.count(g(b)).alias("nb"), F.avg(g(a)).alias("ma"), F.avg(g(b)).alias("mb"), F.var_samp(g(a)).alias("va"), F.var_samp(g(b)).alias("vb"))
    sd = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    ok = (F.col("na") > 1) & (F.col("nb") > 1) & (sd > 0)
    return s.select(F.round(F.when(ok, (F.col("ma") - F.col("mb")) / sd).otherwise(0.0), 6).alias("d"))


def holm(df: DataFrame, p: str, *keys: str) -> DataFrame:
    """Holm-adjusted p values: p times what is left, at most 1, never falling."""
    w = Window.orderBy(p, *keys)  # a table of tests
    n = F.count(F.lit(1)).over(Window.partitionBy())
    x = F.least(F.lit(1.0), F.col(p) * (n - F.row_number().over(w) + 1))
    return df.withColumn("_x", x).withColumn("p_holm", F.round(F.max("_x").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), 9)).drop("_x")


def paired_analysis(long: DataFrame, key: str, name: str, value: str, pairs: list[tuple[str, str]], alpha: float = 0.05) -> DataFrame:
    """Wilcoxon, Holm and Cohen's d of each stated pair of names over the keys both have: ``(a, b, n, mean_a, mean_b, diff,
    p_value, p_holm, effect_d, significant)``. Pairs with fewer than three common keys are left out."""
    spark = long.sparkSession
    table = spark.createDataFrame(pairs, "a string, b string")
    side = lambda n, v: long.select(key, F.col(name).alias(n), F.col(value).cast("double").alias(v))
    rows = F.broadcast(table).join(side("a", "x"), "a").join(side("b", "y"), [key, "b"]).withColumn("d", F.col("x") - F.col("y"))
    g = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{m}_{c}") for c in ("x", "y") for m, f in (("mean", F.avg), ("var", F.var_samp))])
    r = signed_ranks(rows, "d", "a", "b").select("a", "b", F.col("n").alias("m"), "w_plus", "w_minus", "ties")
    out = []
    for t in g.where("n >= 3").join(r, ["a", "b"], "left").collect():  # one row a stated pair
        p = wilcoxon_p(t["m"] or 0, min(t["w_plus"] or 0, t["w_minus"] or 0), t["ties"] or 0, None if t["m"] == t["n"] else False)
        sd = math.sqrt((t["var_x"] + t["var_y"]) / 2)  # the same number of keys on both sides
        out.append((t["a"], t["b"], t["n"], t["mean_x"], t["mean_y"], t["mean_x"] - t["mean_y"], p, (t["mean_x"] - t["mean_y"]) / sd if sd else 0.0))
    df = spark.createDataFrame(out, "a string, b string, n bigint, mean_a double, mean_b double, diff double, p_value double, effect_d double")
    return holm(df, "p_value", "a", "b").withColumn("significant", F.col("p_holm") < alpha)


def significance(long: DataFrame, key: str, mode: str, metric: str, value: str, modes: list[str], base: str, binary: tuple[str, ...], reps: int = 2000) -> DataFrame:
    """``(metric, mode, n, mean, low, high, diff, diff_low, diff_high, p_value, test, significant)`` of each mode against ``base``.

    Keys are those that all modes have. ``binary`` metrics are tested by McNemar, others by Wilcoxon; intervals are of
    2.5 to 97.5 % of replicates. The base has no difference and no p value."""
    from tessella.operators.resampling import aligned, mean_bootstrap

    spark, rows = long.sparkSession, []
    for m in sorted(r[0] for r in long.select(metric).distinct().collect()):  # one a metric
        part = written(aligned(long.where(F.col(metric) == m), key, mode, modes).select(key, mode, F.col(value).cast("double").alias("v")), "aligned")
        boot = mean_bootstrap(part, key, mode, "v", modes, reps)
        b = part.where(F.col(mode) == base).select(key, F.col("v").alias("b"))
        pairs = part.join(b, key).withColumn("d", F.col("v") - F.col("b"))
        n = part.where(F.col(mode) == base).count()
        if m in binary:
            t = {r[mode]: (r["x"], r["y"]) for r in pairs.groupBy(mode).agg(F.count_if(F.col("d") > 0).alias("x"), F.count_if(F.col("d") < 0).alias("y")).collect()}
            p = {k: mcnemar_p(*v) for k, v in t.items()}
        else:
            p = {r[mode]: wilcoxon_p(r["n"], min(r["w_plus"], r["w_minus"]), r["ties"], None if r["n"] == n else False) for r in signed_ranks(pairs, "d", mode).collect()}
        for k in modes:
            v = boot[k]
            low, high = np.quantile(v[1:], [0.025, 0.975])
            d = v - boot[base]
            dl, dh = np.quantile(d[1:], [0.025, 0.975]) if k != base else (0.0, 0.0)
            test = "bootstrap" if k == base else "mcnemar" if m in binary else "wilcoxon"
            rows.append((m, k, n, *(round(float(x), 6) for x in (v[0], low, high, d[0], dl, dh)), None if k == base else round(p.get(k, 1.0), 9), test, bool(k != base and (dl > 0 or dh < 0))))
    kinds = "metric string, mode string, n bigint, mean double, low double, high double, diff double, diff_low double, diff_high double, p_value double, test string, significant boolean"
    return spark.createDataFrame(rows, kinds)
