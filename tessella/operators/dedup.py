"""Duplicates and leakage by equality and by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.retrieval import vectors
from tessella.session import written


def first_of(df: DataFrame, norm: Column, order: str) -> DataFrame:
    """The first row of each text. A minimum per text and a join back, so a text that
    a third of the rows share is never one task's window."""
    t = df.withColumn("_n", norm)
    first = t.groupBy("_n").agg(F.min(order).alias(order))
    return t.join(first, ["_n", order]).drop("_n")


def repeated(df: DataFrame, norm: Column) -> DataFrame:
    """``(texts, rows)``: texts on two rows or more, and all rows that bear them."""
    g = df.groupBy(norm.alias("_n")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return g.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def shared_values(left: DataFrame, right: DataFrame, norm: Column) -> DataFrame:
    """Distinct non-empty values on both sides, one row ``(shared)``."""
    a = left.select(norm.alias("v")).where("v <> ''").distinct()
    return a.join(right.select(norm.alias("v")).distinct(), "v", "left_semi").agg(F.count(F.lit(1)).alias("shared"))


def by_priority(df: DataFrame, norm: Column, priority: Column) -> DataFrame:
    """Rows of the best split that holds their text; repeats inside it stay."""
    t = df.withColumn("_n", norm).withColumn("_p", priority)
    best = t.groupBy("_n").agg(F.min("_p").alias("_b"))
    return t.join(best, "_n").where(F.col("_p") == F.col("_b")).drop("_n", "_p", "_b")


#: Bytes of vectors that go to every task at a time.
SENT = 16_000_000


def _sent(df: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(ids, matrix)`` of ``df(id, v)`` in hash blocks of about ``SENT`` bytes, sorted by id: the side that goes against all rows."""
    n, width = df.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    blocks = max(1, -(-n * 8 * (width or 1) // SENT))
    for b in range(blocks if n else 0):
        part = df.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else df
        rows = part.select("id", "v").toPandas().sort_values("id")
        if len(rows):
            yield rows["id"].to_numpy(np.int64), np.array([np.asarray(v, np.float64) for v in rows["v"]])


def nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(r_id, max_sim, l_id)``: for every right row its most similar left row (ties: the
    smaller id). ``left`` and ``right``: (id, v). The left side goes out in blocks; each is one
    matrix product a batch, and one maximum a right row leaves it."""
    out, kinds = None, "r_id bigint, sim double, l_id bigint"
    for ids, m in _sent(left):

        def run(batches: Iterator[pa.RecordBatch], ids=ids, m=m) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v, own = vectors(b.column("v")), b.column("id").to_numpy()
                for lo in range(0, len(own), 1_000):
                    s = np.round(v[lo : lo + 1_000] @ m.T, 6)
                    at = s.argmax(1)  # ids are sorted: the first maximum is the smaller id
                    yield pa.RecordBatch.from_arrays([pa.array(own[lo : lo + 1_000]), pa.array(s[np.arange(len(at)), at]), pa.array(ids[at])], ["r_id", "sim", "l_id"])

        s = right.select(F.col("id").cast("bigint").alias("id"), "v").mapInArrow(run, kinds)
        out = s if out is None else out.union(s)
    if out is None:
        out = left.sparkSession.createDataFrame([], kinds)
    best = out.groupBy("r_id").agg(F.max(F.struct(F.col("sim"), (-F.col("l_id")).alias("i"))).alias("m"))
    return best.select("r_id", F.col("m.sim").alias("max_sim"), (-F.col("m.i")).alias("l_id"))


def similar_pairs(df: DataFrame, t: float, segment: str | None = None) -> DataFrame:
    """``(i, j)`` with i < j and dot product of at least ``t``, from ``(id, v)``, block against all; of one ``segment`` only, if given."""
    out = None
    parts = [df.select("id", "v")]
    if segment:  # each segment meets itself alone
        parts = [df.where(F.col(segment).eqNullSafe(F.lit(r[0]))).select("id", "v") for r in df.select(segment).distinct().collect()]
    for rows in parts:
        for ids, m in _sent(rows):

            def run(batches: Iterator[pa.RecordBatch], ids=ids, m=m) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    v, own = vectors(b.column("v")), b.column("id").to_numpy()
                    for lo in range(0, len(own), 1_000):
                        part = own[lo : lo + 1_000]
                        j, i = np.nonzero((np.round(v[lo : lo + 1_000] @ m.T, 6) >= t) & (ids[None] < part[:, None]))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(part[j])], ["i", "j"])

            p = rows.select(F.col("id").cast("bigint").alias("id"), "v").mapInArrow(run, "i bigint, j bigint")
            out = p if out is None else out.union(p)
    return out if out is not None else df.sparkSession.createDataFrame([], "i bigint, j bigint")


def _greedy(df: DataFrame, pairs: DataFrame, sure: DataFrame | None = None) -> DataFrame:
    """Ids left when rows are taken in id order and one goes if an earlier row that stays is similar; those
    of ``sure`` stay whatever is similar. Rounds over the similar pairs alone: a row with no undecided earlier
    neighbour stays, its later neighbours go; there are as many as the longest chain of them."""
    if sure is not None:
        pairs = pairs.join(sure.select(F.col("id").alias("j")), "j", "left_anti").select("i", "j")
    live, gone, k = written(pairs, "pairs"), None, 0
    while not live.isEmpty():
        free = live.select(F.col("i").alias("id")).distinct().join(live.select(F.col("j").alias("id")).distinct(), "id", "left_anti")
        free = written(free, f"free{k}")
        out = written(live.join(free.select(F.col("id").alias("i")), "i", "left_semi").select(F.col("j").alias("id")).distinct(), f"out{k}")
        gone = out if gone is None else gone.union(out)
        live = live.join(out.select(F.col("id").alias("j")), "j", "left_anti").join(out.select(F.col("id").alias("i")), "i", "left_anti")
        live = written(live.join(free.select(F.col("id").alias("i")), "i", "left_anti").select("i", "j"), f"live{k}")
        k += 1
    ids = df.select("id")
    return ids.join(gone, "id", "left_anti") if gone is not None else ids


def greedy(df: DataFrame, t: float) -> DataFrame:
    """Ids kept when rows are taken in id order and one is dropped if any kept row is similar."""
    return _greedy(df, similar_pairs(df, t))


def greedy_by_segment(df: DataFrame, segment: str, t: float, seed: Column | None = None, style: tuple[str, ...] = ()) -> DataFrame:
    """The same inside each segment. Rows marked as ``seed`` always stay, and so does the first other row (by id) of
    each value of ``style``, which is counted over all segments."""
    sure = None
    if seed is not None:
        d = df.withColumn("_seed", F.coalesce(seed, F.lit(False)))
        sure = d.where("_seed").select("id")
        if style:
            blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{n}") for n, c in enumerate(style)]
            sure = sure.union(d.where("not _seed").groupBy(*blank).agg(F.min("id").alias("id")).select("id"))
        sure = written(sure, "sure")
    return _greedy(df, similar_pairs(df, t, segment), sure)


def across_splits(splits: list[DataFrame], t: float) -> DataFrame:
    """Kept ids of splits taken in order, ``(id, stage)``: a row goes if a kept row of an earlier split is
    similar; rows of its own split don't matter."""
    kept = splits[0].select("id", "v", F.lit(0).alias("stage"))
    for n, s in enumerate(splits[1:], 1):
        far = nearest(kept.select("id", "v"), s).where(F.col("max_sim") >= t).select(F.col("r_id").alias("id"))
        kept = written(kept.union(s.join(far, "id", "left_anti").select("id", "v", F.lit(n).alias("stage"))), f"stage{n}")
    return kept.select("id", "stage")
