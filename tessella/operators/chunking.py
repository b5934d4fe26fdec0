"""Chunks from lists and sections under a size budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import written


def list_chunks(df: DataFrame, group: str, order: str, line: Column, size: Column, budget: int = 600) -> DataFrame:
    """Items of a group as chunks: one if its sizes fit ``budget``, else parts of
    n // (total // budget + 1) + 1 items in order. ``(group, part, items, content)``."""
    t = df.where(F.col(group).isNotNull()).select(group, F.col(order).alias("_o"), line.alias("_l"), size.alias("_z"))
    w = Window.partitionBy(group)
    n, total = F.count(F.lit(1)).over(w), F.sum("_z").over(w)
    per = F.when(total > budget, F.floor(n / (F.floor(total / budget) + 1)) + 1).otherwise(n)
    t = t.withColumn("_p", per).withColumn("_k", F.row_number().over(w.orderBy("_o")) - 1).withColumn("part", F.floor(F.col("_k") / F.col("_p")))
    rows = F.array_sort(F.collect_list(F.struct("_k", "_l")))  # a chunk's items: within the budget
    return t.groupBy(group, "part").agg(F.count(F.lit(1)).alias("items"), F.array_join(F.transform(rows, lambda r: r["_l"]), "\n").alias("content"))


def placed(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``df`` with each row's place in an order, from 1. Two levels: ranges are sorted and written
    once, then counted and numbered from their offsets, so no single task orders the table."""
    t = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id())
    t = written(t, "ranges")  # sampled ranges may differ from run to run
    t = t.withColumn("_inside", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    c = t.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    return t.join(F.broadcast(c.select("_range", "_before")), "_range").withColumn(name, F.col("_inside") + F.col("_before")).drop("_range", "_inside", "_before")


def numbered(df: DataFrame, order: list[str], prefix: str, width: int = 4) -> DataFrame:
    """Ids ``prefix_0001``... in an order."""
    n = F.col("_n").cast("string")
    return placed(df, order, "_n").withColumn("id", F.concat(F.lit(prefix), F.lpad(n, F.greatest(F.lit(width), F.length(n)), "0"))).drop("_n")


def context_prefix(source_type: Column, title: Column, source: Column, names: dict[str, str]) -> Column:
    """Three lines before a chunk: kind, title, source."""
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), source_type), source_type, F.lit(""))
    return F.concat_ws("\n", F.concat(F.lit("Kind: "), kind), F.concat(F.lit("Title: "), F.coalesce(title, F.lit(""))), F.concat(F.lit("Source: "), F.coalesce(source, F.lit(""))))


def embedding_text(prefixes: list[Column], title: Column, content: Column) -> Column:
    """Non-empty prefixes by lines, a blank line, then title and content."""
    head = F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in prefixes])
    body = F.concat_ws("\n", title, content)
    return F.when(head == "", body).otherwise(F.concat(head, F.lit("\n\n"), body))
