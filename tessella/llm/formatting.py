"""Records that differ in layout alone: dictionary-encoded tuples, grouped.

Every distinct raw value is canonicalised once and gets an integer identifier;
a record becomes the sorted tuple of its identifiers, and equal tuples are one
record. Values travel as 128-bit digests after the dictionary is built, so long
texts are shuffled once. The identifier of a value is the smallest cell that
holds it: a pure function of the data, so a task that is run again after an
executor was lost hands out the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.records import with_fields
from tessella.session import written


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", "")


def _digest(*cols: Column) -> Column:
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(11), *cols).alias("b"))


def encoded(df: DataFrame, key: str = "row_no", text: str = "text") -> DataFrame:
    """``(key, tuple array<bigint>)``: each record as sorted value identifiers.

    NULL texts and texts without a letter or digit have no content to compare
    and give no row. Repeated keys are allowed to share cells only if their
    texts are equal; ``key`` is expected to be unique and below 2^43.
    """
    rec = with_fields(df.select(F.col(key).alias("_key"), F.col(text).alias("_t")), "_t")
    free = F.array(F.struct(F.lit("").alias("name"), F.col("_clean").alias("value")))
    cells = rec.select("_key", F.posexplode(F.coalesce("_fields", free)).alias("_pos", "_f"))
    cells = cells.select("_key", "_pos", "_f.name", "_f.value", _digest(F.col("_f.name"), F.col("_f.value")).alias("raw"))
    cells = written(cells, "cells")  # read thrice below; parsed once
    # dictionary: distinct raw values (the one shuffle of strings) -> canonical -> integer
    values = cells.groupBy("name", "value", "raw").agg(F.min(F.col("_key").cast("bigint") * (1 << 20) + F.col("_pos")).alias("cell"))
    canon = values.select("raw", "cell", _letters(F.col("name")).alias("n"), _letters(F.col("value")).alias("v")).where("v <> ''")
    canon = written(canon.select("raw", "cell", _digest(F.col("n"), F.col("v")).alias("canon")), "dictionary")
    ids = canon.groupBy("canon").agg(F.min("cell").alias("value_id"))
    mapping = canon.join(ids, "canon").select("raw", "value_id")
    coded = cells.select("_key", "raw").join(mapping, "raw").select("_key", "value_id")
    # a form's own fields only: the list is as long as the record
    return coded.groupBy("_key").agg(F.array_sort(F.collect_list("value_id")).alias("tuple")).withColumnRenamed("_key", key)


def collapsed(df: DataFrame, key: str = "row_no", text: str = "text") -> DataFrame:
    """One row per record: ``(first_<key>, copies)``; ``copies`` counts all rows of it."""
    return (
        encoded(df, key, text)
        .groupBy("tuple")
        .agg(F.min(key).alias(f"first_{key}"), F.count(F.lit(1)).alias("copies"))
        .drop("tuple")
    )


def copies(df: DataFrame, key: str = "row_no", text: str = "text") -> DataFrame:
    """``(first_<key>, copy_<key>)``: each further copy beside the first of its record."""
    rows = written(encoded(df, key, text).select(F.col(key).alias(f"copy_{key}"), _digest(F.col("tuple")).alias("d")), "tuples")
    groups = rows.groupBy("d").agg(F.min(f"copy_{key}").alias(f"first_{key}"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(groups, "d").where(F.col(f"copy_{key}") != F.col(f"first_{key}")).select(f"first_{key}", f"copy_{key}")
