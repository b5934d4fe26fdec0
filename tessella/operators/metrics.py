"""Evaluation: classification, safety, calibration, thresholds, answers, systems. DataFrame -> DataFrame."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

zero = lambda c: F.coalesce(c, F.lit(0.0))
ratio = lambda a, b: zero(a / F.nullif(b, F.lit(0)))


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    """``(true, pred, n)``: the one small table the class metrics come from."""
    return df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_report(conf: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label seen on either side; what divides by zero is 0."""
    t = conf.select(F.col("true").alias("label"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"), F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"))
    p = conf.select(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("tp"))
    s = t.union(p).groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))
    s = s.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return s.select("label", "support", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def overall(conf: DataFrame) -> DataFrame:
    """Accuracy, macro-F1 over labels of either side, balanced accuracy over true labels; one row."""
    r = class_report(conf).agg(F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced"))
    a = conf.agg(F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)).alias("ok"), F.sum("n").alias("n"))
    return a.join(r).select(F.col("n"), F.round(ratio(F.col("ok"), F.col("n")), 6).alias("accuracy"), F.round(zero(F.col("macro_f1")), 6).alias("macro_f1"), F.round(zero(F.col("balanced")), 6).alias("balanced_accuracy"))


def safety(df: DataFrame, true: str, pred: str, urgency: str, risky: str = "anamnesis", harmless: str = "faq", urgent: tuple[str, ...] = ("urgent", "emergency", "high")) -> DataFrame:
    """How often risky messages are recognised or taken for harmless ones, and the same of urgent ones."""
    r, u = F.col(true) == risky, (F.col(true) == risky) & F.lower(F.trim(F.coalesce(F.col(urgency), F.lit("")))).isin(*urgent)
    ok = F.col(pred) == risky
    return df.agg(
        F.round(ratio(F.count_if(r & ok), F.count_if(r)), 6).alias("recall"),
        F.round(ratio(F.count_if(r & (F.col(pred) == harmless)), F.count_if(r)), 6).alias("false_harmless"),
        F.round(ratio(F.count_if(u & ok), F.count_if(u)), 6).alias("recall_urgent"),
        F.count_if(r & ~ok).alias("missed"),
        F.count_if(u & ~ok).alias("missed_urgent"),
    )


def misrouted(conf: DataFrame, risky: str = "anamnesis") -> DataFrame:
    return conf.where((F.col("true") == risky) & (F.col("pred") != risky)).select(F.col("pred").alias("misrouted_to"), "n")


def transitions(df: DataFrame, before: str, true: str, pred: str) -> DataFrame:
    """Accuracy per change of domain; a blank context is ``unknown``."""
    name = F.concat(F.coalesce(F.nullif(F.trim(F.col(before)), F.lit("")), F.lit("unknown")), F.lit("->"), F.col(true))
    return df.groupBy(name.alias("transition")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(true) == F.col(pred)).alias("correct")).withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 6))


def edges(bins: int) -> list[float]:
    """Bin edges as evenly spaced doubles (0.1 * 3 is 0.30000000000000004, as it must be)."""
    return [float(x) for x in np.linspace(0.0, 1.0, bins + 1)]


def binned(conf: Column, bins: int) -> Column:
    """Bin of a confidence, right edge open but in the last bin; out of range or NULL is NULL."""
    e = edges(bins)
    out = F.lit(None).cast("int")
    for k in range(bins - 1, -1, -1):
        upper = conf <= e[k + 1] if k == bins - 1 else conf < e[k + 1]
        out = F.when((conf >= e[k]) & upper, F.lit(k)).otherwise(out)
    return out


def reliability(df: DataFrame, conf: str, correct: str, bins: int = 10) -> DataFrame:
    """Count, mean confidence, accuracy and their gap per bin; empty bins have no row."""
    g = df.withColumn("bin", binned(F.col(conf), bins)).where("bin is not null").groupBy("bin")
    g = g.agg(F.count(F.lit(1)).alias("count"), F.avg(conf).alias("avg_confidence"), F.avg(F.col(correct).cast("double")).alias("avg_accuracy"))
    return g.withColumn("gap", F.abs(F.col("avg_accuracy") - F.col("avg_confidence"))).select("bin", "count", *[F.round(c, 6).alias(c) for c in ("avg_confidence", "avg_accuracy", "gap")])


def ece(df: DataFrame, conf: str, correct: str, bins: int = 10) -> DataFrame:
    """Expected calibration error, one row; no rows give 0."""
    g = df.withColumn("bin", binned(F.col(conf), bins)).where("bin is not null").groupBy("bin")
    g = g.agg(F.count(F.lit(1)).alias("n"), F.avg(conf).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    return g.agg(F.round(ratio(F.sum(F.abs(F.col("a") - F.col("c")) * F.col("n")), F.sum("n")), 6).alias("ece"))


def brier(df: DataFrame, true: str, proba: str, classes: list[str]) -> DataFrame:
    """One-versus-rest Brier score per class of a probability array in the order of ``classes``."""
    rows = df.select(F.col(true).alias("t"), F.posexplode(proba).alias("k", "p"))
    name = F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("k") + 1)
    return rows.groupBy(name.alias("label")).agg(F.round(F.avg(F.pow(F.col("p") - (F.col("t") == name).cast("int"), 2)), 6).alias("brier"))


def thresholds(df: DataFrame, conf: str, true: str, pred: str, grid: list[float], risky: str = "anamnesis", harmless: str = "faq") -> DataFrame:
    """Coverage, accuracy among accepted, recall of the risky class over all of it,
    and share of it taken for harmless, at every threshold. Rows are first
    counted by the last threshold they pass, so nothing is multiplied by the grid."""
    g = F.array(*[F.lit(float(t)) for t in grid])
    step = F.size(F.filter(g, lambda t: F.col(conf) >= t))
    t, p = F.col(true), F.col(pred)
    c = df.groupBy(step.alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(t == p).alias("ok"), F.count_if(t == risky).alias("r"), F.count_if((t == risky) & (p == risky)).alias("r_ok"), F.count_if((t == risky) & (p == harmless)).alias("r_bad")
    )
    grid_df = df.sparkSession.createDataFrame([(k + 1, float(x)) for k, x in enumerate(sorted(grid))], "k int, threshold double")
    got = lambda x: F.sum(F.when(F.col("step") >= F.col("k"), F.col(x)).otherwise(0))
    out = grid_df.join(F.broadcast(c), F.lit(True)).groupBy("k", "threshold").agg(got("n").alias("acc"), got("ok").alias("ok"), got("r_ok").alias("r_ok"), got("r_bad").alias("r_bad"), F.sum("n").alias("n"), F.sum("r").alias("r"))
    return out.select(
        "threshold", F.round(ratio(F.col("acc"), F.col("n")), 6).alias("coverage"), F.round(ratio(F.col("ok"), F.col("acc")), 6).alias("accuracy"), F.round(ratio(F.col("r_ok"), F.col("r")), 6).alias("recall"), F.round(ratio(F.col("r_bad"), F.col("r")), 6).alias("false_harmless")
    )


def pareto(df: DataFrame, up: str, down: str, top: int = 5) -> DataFrame:
    """Rows no other row beats: ``up`` as large and ``down`` as small, one of them
    strictly. A running minimum over ``up`` falling finds them in one pass; more than
    ``top`` are thinned to evenly spaced ones (half to even), largest ``up`` first."""
    by = df.groupBy(up).agg(F.min(down).alias(down))
    w = Window.orderBy(F.desc(up)).rowsBetween(Window.unboundedPreceding, -1)  # distinct values of a threshold table
    best = by.withColumn("_m", F.min(down).over(w)).where(F.col("_m").isNull() | (F.col(down) < F.col("_m"))).select(up, down)
    kept = df.join(best, [up, down])
    order = Window.orderBy(F.desc(up), *[F.col(c) for c in sorted(df.columns) if c != up])
    kept = kept.withColumn("_k", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    if top > 1:
        at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(top - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (top - 1)).cast("bigint")))
        kept = kept.where((F.col("_n") <= top) | F.array_contains(at, F.col("_k")))
    else:
        kept = kept.where(F.col("_k") < top)
    return kept.select(*df.columns)


def taxonomy(df: DataFrame, rules: list[tuple[str, Column]], wrong: Column) -> DataFrame:
    """One row an error tag of every wrong row, in rule order; ``generic_error`` where no rule fits."""
    tags = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    return df.where(wrong).withColumn("error_type", F.explode(F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("generic_error")))))


def taxonomy_summary(tagged: DataFrame, key: str) -> DataFrame:
    """Count, share of the wrong rows and first example per tag."""
    n = tagged.select(F.countDistinct(key).alias("all"))
    s = tagged.groupBy("error_type").agg(F.count(F.lit(1)).alias("count"), F.min(key).alias("example"))
    return s.join(F.broadcast(n)).select("error_type", "count", F.round(100 * F.col("count") / F.col("all"), 4).alias("pct"), "example")


def system(df: DataFrame, by: str, latency: str, failed: Column) -> DataFrame:
    """Rows, linear p50/p95 of the latency of those that didn't fail, and the share that did."""
    ok = F.when(~failed, F.col(latency))
    p = lambda q: F.round(zero(F.percentile(ok, F.lit(q))), 6)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.round(F.avg(failed.cast("int")), 6).alias("fail_rate"))


def outer_summary(key: str, main: list[DataFrame], extra: list[DataFrame]) -> DataFrame:
    """Keys of any of ``main`` with all their columns, and those of ``extra`` where they have the key."""
    out = main[0]
    for d in main[1:]:
        out = out.join(d, key, "full")
    for d in extra:
        out = out.join(d, key, "left")
    return out


def fact_match(df: DataFrame, answer: str, facts: str, *keys: str) -> DataFrame:
    """``(*keys, facts, fact_match)``: share of a row's facts that its answer holds, NULL without facts.

    Phones and prices compare digits on both sides; a schedule's days and hours must all be among the
    answer's; names, addresses and other facts, normalised in their own way, must stand in the answer's words. A fact
    that normalises to nothing counts and never matches."""
    from tessella.operators.text import address, answer_words, digits, phone, schedule_tokens, surname

    f = df.select(*keys, F.coalesce(F.col(answer), F.lit("")).alias("_a"), F.explode_outer(facts).alias("_f"))
    value, kind, a = F.coalesce(F.col("_f.canonical_value"), F.lit("")), F.col("_f.fact_type"), F.col("_a")
    held = lambda want, have: (want != "") & F.contains(have, want)
    days = schedule_tokens(value)
    hit = (
        F.when(kind == "phone", held(phone(value), phone(a)))
        .when(kind == "price", held(digits(value), digits(a)))
        .when(kind == "schedule", (F.size(days) > 0) & (F.size(F.array_except(days, schedule_tokens(a))) == 0))
        .when(kind == "fio", held(surname(value), answer_words(a)))
        .when(kind == "address", held(address(value), answer_words(a)))
        .otherwise(held(answer_words(value), answer_words(a)))
    )
    hit = F.when(F.col("_f").isNotNull(), hit.cast("int"))
    return f.groupBy(*keys).agg(F.count(hit).alias("facts"), F.round(F.avg(hit), 6).alias("fact_match"))
