"""Dialogues: ordered folds of turns into fields, and their figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged(old: Column, new: Column) -> Column:
    """A field's value after a turn: empty takes the new one, what contains the other
    stays, else both joined by '; '."""
    o, n = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    return F.when(n == "", o).when(o == "", n).when(F.contains(F.lower(o), F.lower(n)), o).when(F.contains(F.lower(n), F.lower(o)), n).otherwise(F.concat(o, F.lit("; "), n))


def folded(df: DataFrame, case: str, turn: str, field: str, value: str) -> DataFrame:
    """``(case, field, value, turns)``: the values of a field folded in order of turns. One dialogue's
    field is one array: bounded by its length."""
    rows = df.groupBy(case, field).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.coalesce(F.col(value), F.lit("")).alias("v")))).alias("a"))
    return rows.select(case, field, F.aggregate("a", F.lit(""), lambda acc, x: merged(acc, x["v"])).alias("value"), F.size("a").alias("turns"))


def figures(df: DataFrame, case: str, role: str, tokens: Column) -> DataFrame:
    """Turns (half the messages, rounded up), messages and tokens per role side of a dialogue."""
    return df.groupBy(case).agg(F.floor((F.count(F.lit(1)) + 1) / 2).alias("turns"), F.count(F.lit(1)).alias("messages"), F.countDistinct(role).alias("roles"), F.sum(tokens).alias("tokens"))


def routing_match(marks: list[Column], least: int = 5) -> Column:
    """All routing marks reach the threshold."""
    out = F.lit(True)
    for m in marks:
        out = out & (F.coalesce(m, F.lit(0)) >= least)
    return out
