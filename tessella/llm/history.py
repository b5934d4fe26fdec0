"""Deduplicating new batches against all history.

Band keys of minwise signatures are kept on disk, partitioned by hash, with the
word sets they stand for. A batch reads the partitions its own keys fall into,
never the history's texts; candidates are verified exactly, and only accepted
records' keys are appended. A manifest beside the tables says which batches are
complete, so another session may go on where one ended, and a batch that broke
off is simply added again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessella.llm.records import tokenized
from tessella.llm.slots import BANDS, ENTRIES, ROWS, bands_of, between, chunks, closed, opened, slot_ids, slotted, verified, within
from tessella.session import get_text, names, put_text, remove, scratch, tidy, written

#: Edges of a batch that one task may resolve; with more, rounds of joins do, to the same rows.
ONE_TASK_EDGES = 200_000
#: Rows that are looked up by a list of their numbers; more are joined, to the same rows.
LISTED = 1_000
MET = "row bigint, other bigint, own boolean, hot bigint"


def _first(rows: DataFrame, *by: str) -> DataFrame:
    """One row for the copies of each text, with the smallest number. A copy has the same words and
    numbers, whichever it is; copies are reduced before they are shuffled."""
    same = [F.any_value(c).alias(c) for c in ("words", "nums", "map", "size")]
    return rows.groupBy(*by, "digest").agg(F.min("row").alias("row"), *same).drop("digest")


def _resolve_small(edges: DataFrame) -> DataFrame:
    """Rejected rows of a checked, small number of edges (row, other, own), in one
    task: in order of rows, each that has an accepted neighbour before it. Neighbours
    from the history (not ``own``) are accepted already."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = pd.concat([*parts, pd.DataFrame({"row": [], "other": []}, dtype="int64").assign(own=False)]).sort_values(["row", "other"])
        out: set[int] = set()
        for row, other, own in zip(e["row"].to_numpy(), e["other"].to_numpy(), e["own"].to_numpy(), strict=True):
            if not own or other not in out:
                out.add(int(row))
        yield pd.DataFrame({"row": sorted(out)}, dtype="int64")

    return edges.repartition(1).mapInPandas(run, "row bigint")


def _meetings(most: int, crowd: int):
    """What one slot's new entries meet: each other, and those of the history."""

    def run(new: pa.Table, old: pa.Table) -> pa.Table:
        if not new.num_rows:
            return pa.Table.from_arrays([pa.nulls(0, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64())], ["row", "other", "own", "hot"])
        mine = opened(new)
        own, hot = within(mine, most, crowd)
        # stored entries are sorted as they are: they are neither copied nor sorted again
        past = np.concatenate([np.empty((0, 2), np.int64), *(between(mine, c) for c in chunks(old))])
        slot = new.column("slot")[0].as_py()
        keys = (mine[0][hot].astype(np.int64) << 24) ^ slot  # names the key among all slots
        rows = np.r_[own[:, 0], past[:, 0], mine[1][hot]]
        others = np.r_[own[:, 1], past[:, 1], np.zeros(len(hot), np.int64)]
        single = np.arange(len(rows)) >= len(own) + len(past)
        hots = np.r_[np.zeros(len(own) + len(past), np.int64), keys]
        flag = np.arange(len(rows)) < len(own)
        return pa.Table.from_arrays([pa.array(rows), pa.array(others, mask=single), pa.array(flag), pa.array(hots, mask=~single)], ["row", "other", "own", "hot"])

    return run


def _dropped(gone: np.ndarray):
    """Packed entries without those of the rows ``gone`` (sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [closed(slot, tuple(x[~np.isin(c[1], gone)] for x in c)) for slot, c in zip(b.column("slot").to_pylist(), chunks(pa.Table.from_batches([b])), strict=True)]
            for t in kept:
                yield from t.to_batches()

    return run


def _others(rows: DataFrame, gone: np.ndarray) -> DataFrame:
    """``rows(row, words)`` without those of ``gone``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(~np.isin(b.column("row").to_numpy(), gone)))

    return rows.mapInArrow(run, "row bigint, words binary")


def _without(new: pa.Table, gone: pa.Table) -> pa.Table:
    """One slot's new entries but for those of rows turned away."""
    if not new.num_rows:
        return closed(0, opened(new))
    cols = opened(new)
    if gone.num_rows:
        keep = ~np.isin(cols[1], opened(gone)[1])
        cols = tuple(c[keep] for c in cols)
    return closed(new.column("slot")[0].as_py(), cols)


class History:
    """What was accepted so far, in tables below ``path`` (the shared folder if none is given).

    A path that holds a history is opened as it was left: its index settings, its
    batches and nothing of a batch that broke off. ``bands`` x ``rows`` set the index:
    sets with a share s of common words meet with probability 1-(1-s^rows)^bands,
    which is 0.988 at 0.6, 0.998 at 0.65 and 0.9999 at 0.7 with the defaults. Keys
    lie with their signatures in hash slots, bucketed so that probing shuffles the
    batch's keys alone; ``buckets`` are set by the first batch's size unless given, and a
    batch reads the slots that its keys fall into. A key of over ``most`` rows
    of one batch with more than ``crowd`` likely pairs a row isn't listed by pairs but settled
    in rounds against its first undecided row. Each way is exact for rows that meet.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, bands: int = BANDS, rows: int = ROWS, buckets: int | None = None, most: int = 5_000, crowd: int = 64):
        self.spark, self.path, self.most, self.crowd = spark, path or scratch(spark, "history"), most, crowd
        self.meta = {"bands": bands, "rows": rows, "slots": [], "buckets": buckets or 0, "done": []}
        if known := [n for n in names(spark, f"{self.path}/manifest") if not n.startswith("_")]:
            self.meta = json.loads(get_text(spark, f"{self.path}/manifest/{known[-1]}"))
        self.name = f"tessella_{uuid.uuid4().hex}"
        if self.meta["done"]:
            self._open()

    @property
    def batches(self) -> int:
        return len(self.meta["done"])

    def _open(self) -> None:
        self._make(f"{self.name}_keys", f"{ENTRIES}, attempt INT", "slot", f"{self.path}/keys")
        self._make(f"{self.name}_sets", "row BIGINT, words BINARY, attempt INT", "row", f"{self.path}/sets")

    def _make(self, name: str, columns: str, by: str, path: str) -> None:
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (compression 'zstd', 'parquet.block.size' '8388608') CLUSTERED BY ({by}) INTO {self.meta['buckets']} BUCKETS LOCATION '{path}'")

    def _drop(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, path)

    def _kept(self, what: str) -> DataFrame:
        """The stored rows of complete batches."""
        return self.spark.table(f"{self.name}_{what}").where(F.col("attempt").isin(self.meta["done"])).drop("attempt")


    def accepted(self) -> DataFrame:
        """``(row)`` of every accepted record that has words."""
        if not self.batches:
            return self.spark.createDataFrame([], "row bigint")
        return self._kept("sets").select("row")

    def add(self, batch: DataFrame) -> DataFrame:
        """Checks a batch (as :func:`prepared` gives it) and keeps what is new; gives the rows turned away, as ``(row)``.

        A row is turned away when an accepted row of an earlier batch, or one of
        its own batch with a smaller ``row``, is near-same. Rows without words
        are no record: accepted, never matched. Copies inside the batch are
        settled by a minimum a digest, so a group of any size costs one row.
        """
        rows = written(batch.where("size > 0"), "batch")
        reps = written(_first(rows), "reps")
        self._check(reps, reps.count())
        return rows.select("row").join(self.accepted(), "row", "left_anti")

    def _check(self, reps: DataFrame, n: int) -> None:
        """Settles the next batch, given the ``n`` stored rows that stand for their copies, and appends what is accepted."""
        spark, meta = self.spark, self.meta
        reps = reps.select("row", "words", "nums", "map", "size")
        # the attempt is marked before anything is stored under its number, so none is used twice
        attempt = len(names(spark, f"{self.path}/started"))
        put_text(spark, f"{self.path}/started/{attempt:09d}", "")
        if not meta["slots"]:
            meta["buckets"] = meta["buckets"] or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * meta["bands"] // 2_000_000))
            meta["slots"] = slot_ids(spark, meta["buckets"])
            self._open()
        keys = lambda df: slotted(df, bands_of(meta["bands"], meta["rows"]), ("words", "nums"), meta["slots"]).repartition(meta["buckets"], "slot")
        fresh, at = f"{self.name}_new{attempt}", scratch(spark, "new")
        self._make(fresh, ENTRIES, "slot", at)
        keys(reps).write.insertInto(fresh)
        new, old = spark.table(fresh), self._kept("keys")
        if n * meta["bands"] < 4 * len(meta["slots"]):  # few keys: name the slots they touch
            old = old.where(F.col("slot").isin([r[0] for r in new.select("slot").distinct().collect()]))
        past = Observation()
        met = new.groupBy("slot").cogroup(old.groupBy("slot")).applyInArrow(_meetings(self.most, self.crowd), MET)
        met = written(met.observe(past, F.count(F.when(~F.col("own") & F.col("hot").isNull(), 1)).alias("old"), F.count("hot").alias("hot")), "met")
        pairs = met.where("hot is null").select("row", "other", "own").distinct()
        own, before = pairs.where("own"), pairs.where("not own")
        sets = self._kept("sets")
        if past.get["old"] <= LISTED:
            sets = sets.where(F.col("row").isin([r[0] for r in met.where("hot is null and not own").select("other").distinct().collect()]))
        edges = verified(own, reps, reps).withColumn("own", F.lit(True))
        edges = edges.union(verified(before.hint("shuffle_hash"), reps, sets).withColumn("own", F.lit(False)))
        found = Observation()
        edges = written(edges.observe(found, F.count(F.lit(1)).alias("n")), "near")
        if found.get["n"] <= ONE_TASK_EDGES and not past.get["hot"]:
            # no more rows than edges, so the numbers alone may go to every task
            gone = np.array(sorted(r[0] for r in _resolve_small(edges).collect()), np.int64)
            kept = new.mapInArrow(_dropped(gone), ENTRIES)
            accepted = _others(reps.select("row", "words"), gone)
        else:
            known = written(edges.where("not own").select("row").distinct(), "known")
            own = edges.where("own").join(known, "row", "left_anti").join(known.select(F.col("row").alias("other")), "other", "left_anti")
            hot = met.where("hot is not null").select(F.col("hot").alias("key"), "row").join(known, "row", "left_anti")
            out = known.union(self._resolve(own.select("row", "other"), written(hot, "hot"), reps))
            out = written(out, "out")
            kept = new.groupBy("slot").cogroup(keys(reps.join(out, "row", "left_semi")).groupBy("slot")).applyInArrow(_without, ENTRIES)
            accepted = reps.join(out, "row", "left_anti").select("row", "words")
        kept.withColumn("attempt", F.lit(attempt)).write.insertInto(f"{self.name}_keys")
        accepted.withColumn("attempt", F.lit(attempt)).repartition(meta["buckets"], "row").write.insertInto(f"{self.name}_sets")
        for what in ("keys", "sets"):  # the batch may come from another session, whose writes this one doesn't see by itself
            spark.catalog.refreshTable(f"{self.name}_{what}")
        meta["done"].append(attempt)
        put_text(spark, f"{self.path}/manifest/{attempt:09d}", json.dumps(meta))
        self._drop(fresh, at)
        tidy(spark)

    def _resolve(self, edges: DataFrame, hot: DataFrame | None, reps: DataFrame) -> DataFrame:
        """Rejected rows in rounds: a row with no undecided row before it, neither
        along an edge nor in one of its hot keys, is accepted; its neighbours go.
        There are as many rounds as the longest chain of rows each undecided before the next."""
        out, k = None, 0
        while True:
            blocked = edges.select("row")
            nodes = edges.select("row").union(edges.select(F.col("other").alias("row")))
            if hot is not None:
                lead = hot.groupBy("key").agg(F.min("row").alias("lead"))
                led = written(hot.join(lead, "key"), f"led{k}")
                blocked = blocked.union(led.where("row <> lead").select("row"))
                nodes = nodes.union(led.select("row"))
            free = written(nodes.distinct().join(blocked.distinct(), "row", "left_anti"), f"free{k}")
            gone = edges.join(free.select(F.col("row").alias("other")), "other", "left_semi").select("row")
            if hot is not None:
                star = led.where("row <> lead").select("row", F.col("lead").alias("other")).distinct()
                star = star.join(free.select(F.col("row").alias("other")), "other", "left_semi")
                gone = gone.union(verified(star.select("row", "other"), reps, reps).select("row"))
            gone = written(gone.distinct(), f"gone{k}")
            out = gone if out is None else out.union(gone)
            done = gone.union(free)
            edges = edges.join(done, "row", "left_anti").join(gone.select(F.col("row").alias("other")), "other", "left_anti").select("row", "other")
            edges = written(edges, f"left{k}")
            if hot is not None:
                hot = written(hot.join(done, "row", "left_anti").select("key", "row"), f"hot{k}")
                if hot.isEmpty():
                    hot = None
            k += 1
            if hot is None and edges.isEmpty():
                return out.distinct()


def prepared(df: DataFrame, key: str = "row_no", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(row, *keep, words, nums, digest, map, size)`` of messages."""
    return tokenized(df.select(F.col(key).alias("row"), F.col(text).alias("_text"), *keep), "_text")


def _gathered(batches: list[tuple[int, int, int, int]], alone: bool) -> list[tuple[int, int, int]]:
    """``(batch, group, base)`` of ``(batch, rows, least row, greatest row)`` in order. Batches that wait together are checked together, as
    long as they have no more than half the rows of all before them: the index of n rows is probed some log n times at most, however many
    batches there are, and what a check moves beside it stays small. ``row + base`` is the row's place in the order of batches, then rows: the order in which rows are
    settled, in one group or in many. Where places outgrow 63 bits, or if ``alone``, each batch is a group and rows are as they are."""
    low = min((x[2] for x in batches), default=0)
    span = max((x[3] for x in batches), default=0) - low + 1
    if alone or len(batches) * span + abs(low) >= 1 << 62:
        return [(b, k, 0) for k, (b, *_) in enumerate(batches)]
    out, group, inside, before = [], 0, 0, 0
    for k, (b, n, *_) in enumerate(batches):
        if inside and 2 * (inside + n) > before:
            group, inside, before = group + 1, 0, before + inside
        inside += n
        out.append((b, group, k * span - low))
    return out


def turned_away(df: DataFrame, key: str = "row_no", text: str = "text", batch: str = "batch_no", **index) -> DataFrame:
    """``(key)`` of all rows that a later-than-accepted, near-same text keeps out, batch after batch.

    NULL batch numbers come last, as one batch. All rows are prepared once; batches
    are gathered (:func:`_gathered`), but for those of a history at a path of its own, where rows keep their numbers.
    """
    history = History(df.sparkSession, **index)
    number: Column = F.coalesce(F.col(batch).cast("bigint"), F.lit(1 << 62)).alias("_b")
    rows = written(prepared(df.select(key, text, number), key, text, ("_b",)).where("size > 0"), "messages")
    seen = rows.groupBy("_b").agg(F.count(F.lit(1)), F.min("row"), F.max("row"))
    groups = df.sparkSession.createDataFrame(_gathered(sorted(map(tuple, seen.collect())), bool(index.get("path"))), "_b bigint, _g int, _base bigint")
    rows = rows.withColumn("_key", F.col("row")).join(F.broadcast(groups), "_b").withColumn("row", F.col("row") + F.col("_base"))
    reps = written(_first(rows, "_g"), "reps", ["_g"])
    for g, n in sorted((r["_g"], r["n"]) for r in reps.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).collect()):
        history._check(reps.where(F.col("_g") == g), n)
    return rows.select("row", "_key").join(history.accepted(), "row", "left_anti").select(F.col("_key").alias(key))
