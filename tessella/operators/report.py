"""Long metric tables: pivots, deltas, ranks, composites and the decision gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unnested(df: DataFrame, payload: str, *keys: str) -> DataFrame:
    """JSON ``{section: {name: {metric: value}}}`` as rows; NULL values go, bad JSON gives none."""
    j = F.from_json(F.col(payload), "map<string,map<string,map<string,double>>>")
    a = df.select(*keys, F.explode(j).alias("section", "_a"))
    b = a.select(*keys, "section", F.explode("_a").alias("strategy", "_b"))
    return b.select(*keys, "section", "strategy", F.explode("_b").alias("metric", "value")).where("value is not null")


def wide(long: DataFrame, key: str, column: str, value: str, values: list[str]) -> DataFrame:
    """Long to wide with stated columns (no pass to find them); the first value of a cell."""
    return long.groupBy(key).pivot(column, values).agg(F.first(value, ignorenulls=True))


def deltas(long: DataFrame, base: str, mode: str = "mode", keys: tuple[str, ...] = ("strategy", "metric")) -> DataFrame:
    """Each value with its difference to the baseline mode's."""
    b = F.max(F.when(F.col(mode) == base, F.col("value"))).over(Window.partitionBy(*keys))
    return long.withColumn("delta", F.round(F.col("value") - b, 6))


def ranks(long: DataFrame, lower_is_better: tuple[str, ...] = (), by: tuple[str, ...] = ("metric",)) -> DataFrame:
    """Competition ranks within a metric, in its own direction."""
    v = F.when(F.col("metric").isin(*lower_is_better), F.col("value")).otherwise(-F.col("value")) if lower_is_better else -F.col("value")
    return long.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(v)))


def leaders(ranked: DataFrame, name: str = "strategy") -> DataFrame:
    """First places per name, most first."""
    return ranked.groupBy(name).agg(F.count_if(F.col("rank") == 1).alias("firsts"), F.round(F.avg("rank"), 6).alias("mean_rank"))


def composite(long: DataFrame, weights: dict[str, float], name: str = "mode") -> DataFrame:
    """Weighted sum of metrics, missing ones skipped, four decimals, with its rank."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    m = long.where(F.col("metric").isin(*weights)).groupBy(name).agg(F.round(F.sum(F.col("value") * F.try_element_at(w, F.col("metric"))), 4).alias("score"))
    return m.withColumn("rank", F.rank().over(Window.orderBy(F.desc("score"))))  # a table of modes


# Differences to the baseline from which a metric counts as gained or lost.
GAINS = {"hit_rate": 0.02, "mrr": 0.01, "avg_fmr": 0.01}
DROPS = {"hit_rate": -0.02, "mrr": -0.01, "avg_fmr": -0.03}


def gate(deltas: DataFrame, focus: str, *by: str) -> DataFrame:
    """``(*by, verdict, retrieval_gain, retrieval_drop, answer_gain, answer_drop)`` over ``(*by, strategy, metric, delta)``.

    Only the ``focus`` strategy counts; NULL differences say nothing. A drop of retrieval (``hit_rate``,
    ``mrr``) stops unless answers (``avg_fmr``) gained, which leaves it open; a drop of answers stops
    unless retrieval gained; any gain without a drop of answers proceeds; all else is ``neutral``."""
    f = F.when(F.col("strategy") == focus, F.col("delta"))
    retrieval = F.col("metric").isin("hit_rate", "mrr")
    limit = lambda d: F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col("metric"))
    said = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    g = deltas.groupBy(*by).agg(
        said(retrieval & (f >= limit(GAINS))).alias("retrieval_gain"),
        said(retrieval & (f <= limit(DROPS))).alias("retrieval_drop"),
        said((F.col("metric") == "avg_fmr") & (f >= limit(GAINS))).alias("answer_gain"),
        said((F.col("metric") == "avg_fmr") & (f < limit(DROPS))).alias("answer_drop"),
    )
    rg, rd, ag, ad = (F.col(c) for c in ("retrieval_gain", "retrieval_drop", "answer_gain", "answer_drop"))
    verdict = F.when(rd & ~ag, "stop").when(rd, "neutral").when(ad & ~rg, "stop").when((rg | ag) & ~ad, "proceed").otherwise("neutral")
    return g.select(*by, verdict.alias("verdict"), rg, rd, ag, ad)


def group_stats(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Rows with mean, sample deviation (NULL for one) and count of their group."""
    g = df.groupBy(*keys).agg(F.round(F.avg(value), 6).alias("group_mean"), F.round(F.stddev_samp(value), 6).alias("group_std"), F.count(F.lit(1)).alias("n_runs"))
    return df.join(g, list(keys))


def pairs_of(df: DataFrame, name: str) -> DataFrame:
    """All pairs of distinct names, each once in order: a small table of names."""
    n = df.select(F.col(name).alias("a")).distinct()
    return n.join(n.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))


def undone(tasks: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Tasks without a result: resume by anti join."""
    return tasks.join(done.select(*keys).distinct(), list(keys), "left_anti")


def manifest(df: DataFrame, group: str, *cols: str) -> DataFrame:
    """A 12-digit fingerprint of each group's rows, independent of their order: sha256 over the sorted hashes of rows."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)
    # hashes are first combined by prefix, so a group of any size is 4096 short strings
    part = df.select(group, row.alias("h")).groupBy(group, F.substring("h", 1, 3).alias("p")).agg(F.sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    return part.groupBy(group).agg(F.sum("n").alias("rows"), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "p", F.col("s").cast("string"), F.col("n").cast("string")))), ","), 256), 1, 12).alias("fingerprint"))
