"""Family-aware splits and samples. Order is by md5 of key and seed: the same on every engine and run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lot(key: Column, seed: int) -> Column:
    """A row's draw: md5 of key and seed."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def first_in(df: DataFrame, by: str, order: list[str], slot: Column, take: Callable[[Column], Column]) -> DataFrame:
    """``df`` with ``taken``: whether a row is among the first ``take(rows)`` of its ``by`` group in an order.

    ``slot`` is a coarse key that rises with the order. A histogram by slot shows where the number is reached:
    slots before are taken whole, and only inside a slot are rows ordered, so no task sorts a group."""
    t = df.withColumn("_slot", slot)
    group = Window.partitionBy(by)
    h = t.groupBy(by, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(group.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # as many rows as slots
    h = h.select(F.col(by).alias("_by"), F.col("_slot").alias("_s"), (take(F.sum("_n").over(group)) - before).alias("_left"))
    t = t.join(h, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_slot") == F.col("_s")))
    k = F.row_number().over(Window.partitionBy(by, "_slot").orderBy(*order))
    return t.withColumn("taken", k <= F.col("_left")).drop("_slot", "_by", "_s", "_left")


def _hex(c: str) -> Column:
    """A coarse key of a draw: 4,096 slots."""
    return F.substring(c, 1, 3)


def family_split(df: DataFrame, family: str, stratum: str, order: str, ratio: float, seed: int = 42) -> DataFrame:
    """``(family, stratum, held)``: families to hold out, per stratum max(1, round(n * ratio)) of them, half to
    even. A family's stratum is that of its first row; blank families are never held out."""
    f = df.where(F.coalesce(F.trim(F.col(family)), F.lit("")) != "").groupBy(family).agg(F.min_by(stratum, order).alias("stratum"))
    f = f.withColumn("_l", lot(F.col(family), seed))
    f = first_in(f, "stratum", ["_l", family], _hex("_l"), lambda n: F.greatest(F.lit(1), F.bround(n * F.lit(ratio)).cast("bigint")))
    return f.select(family, "stratum", F.col("taken").alias("held"))


def modal_split(df: DataFrame, family: str, category: str, ratio: float, seed: int = 42) -> DataFrame:
    """``(family, category, held)``: a family's category is its most frequent (ties: the
    smaller), at least one family of a category stays."""
    c = df.groupBy(family, category).agg(F.count(F.lit(1)).alias("n"))
    f = c.groupBy(family).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(category).alias("c"))).alias("m")).select(family, F.col("m.c").alias("category"))
    f = f.withColumn("_l", lot(F.col(family), seed))
    f = first_in(f, "category", ["_l", family], _hex("_l"), lambda n: F.least(F.greatest(F.lit(1), F.bround(n * F.lit(ratio)).cast("bigint")), n - 1))
    return f.select(family, "category", F.col("taken").alias("held"))


def stratified(df: DataFrame, key: str, stratum: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows: n // strata of each, topped up from the rest by draw."""
    t = df.select(key, F.col(stratum).alias("stratum")).withColumn("_l", lot(F.col(key), seed))
    s = t.withColumn("_k", F.row_number().over(Window.partitionBy("stratum").orderBy("_l", key))).where(F.col("_k") <= n)
    strata = t.select(F.countDistinct(F.coalesce(F.col("stratum"), F.lit(""))).alias("_s"))
    s = s.join(F.broadcast(strata)).withColumn("_x", (F.col("_k") > F.floor(F.lit(n) / F.col("_s"))).cast("int"))
    return s.orderBy("_x", "_l", key).limit(n).select(key, "stratum")


def family_sample(df: DataFrame, family: str, share: float, seed: int = 42) -> DataFrame:
    """Rows of max(1, round(n * share)) whole families; blank families are an error to
    the caller, who sees them as a family of their own."""
    f = df.groupBy(family).agg(F.count(F.lit(1)).alias("rows")).withColumn("_l", lot(F.coalesce(F.col(family), F.lit("")), seed))
    n = f.count()
    take = max(1, round(n * share)) if n else 0
    return df.join(f.orderBy("_l", family).limit(take).select(F.col(family).alias("_f")), F.col(family).eqNullSafe(F.col("_f")), "left_semi")


def quota_sample(df: DataFrame, key: str, family: str, category: str, quotas: dict[str, int], seed: int = 42) -> DataFrame:
    """Per category its quota of rows: one of each family first, then others, by draw."""
    q = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    t = df.select(key, family, F.col(category).alias("category")).withColumn("_l", lot(F.col(key), seed)).withColumn("_q", F.try_element_at(q, F.col("category"))).where("_q > 0")
    # a family's first row is a minimum; all its others come after the first ones of all families
    first = t.groupBy("category", family).agg(F.min(F.struct("_l", key)).alias("_f"))
    t = t.join(first.select(F.col("category").alias("_c"), F.col(family).alias("_fam"), F.col(f"_f.{key}").alias("_key")), (F.col("category") == F.col("_c")) & F.col(family).eqNullSafe(F.col("_fam")))
    t = t.withColumn("_x", (F.col(key) != F.col("_key")).cast("int"))
    quota = lambda n: F.try_element_at(q, F.col("category"))
    t = first_in(t, "category", ["_x", "_l", key], F.concat(F.col("_x").cast("string"), _hex("_l")), quota)
    return t.where("taken").select(key, family, "category")


def holdout(df: DataFrame, family: str, marked: Column) -> DataFrame:
    """Rows with ``held``: whole families move when one of their rows is marked."""
    hit = df.where(marked).select(F.col(family).alias("_f")).where("_f is not null").distinct()
    return df.join(hit.withColumn("_h", F.lit(True)), F.col(family) == F.col("_f"), "left").withColumn("held", F.coalesce("_h", F.lit(False))).drop("_f", "_h")


def audit_sample(df: DataFrame, key: str, n: int, blank: tuple[str, ...] = (), seed: int = 42) -> DataFrame:
    """``n`` rows by draw, all if there are no more, with blank columns for the auditor."""
    picked = df.withColumn("_l", lot(F.col(key), seed)).orderBy("_l", key).limit(n).drop("_l")
    return picked.withColumns({b: F.lit("") for b in blank}) if blank else picked


def balance(df: DataFrame, label: str, least: float = 0.05, *by: str) -> DataFrame:
    """Rows and share of each label, and whether it falls under ``least``."""
    c = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by))  # one row a label
    return c.withColumn("share", F.round(share, 6)).withColumn("low", share < least)


def safety_subset(df: DataFrame, label: Column, urgency: Column, risky: str = "anamnesis", urgent: tuple[str, ...] = ("urgent", "emergency")) -> DataFrame:
    """Risky messages that are urgent."""
    return df.where((label == risky) & F.lower(F.trim(F.coalesce(urgency, F.lit("")))).isin(*urgent))


def split_pipeline(df: DataFrame, key: str, family: str, stratum: str, text: str, extended: Column, marked: Column, test: float = 0.2, val: float = 0.125, seed: int = 42) -> DataFrame:
    """``(key, split)``: ``extended`` rows apart; families with a ``marked`` row to test; of the others a share of families to
    test and, of what is left, to val, by stratum; then repeats of a text go, inside train and from any split that a better one holds
    (test before val before train before extended). Rows of blank families stay in train."""
    from tessella.operators.dedup import by_priority, first_of
    from tessella.operators.text import dedup_norm
    from tessella.session import written

    ext = F.coalesce(extended, F.lit(False))
    core = written(df.where(~ext), "core")
    held = holdout(core, family, F.coalesce(marked, F.lit(False)))
    rest = written(held.where(~F.col("held")).drop("held"), "rest")
    a = family_split(rest, family, stratum, key, test, seed).select(F.col(family).alias("_f"), F.col("held").alias("_t"))
    rest = rest.join(a, F.col(family) == F.col("_f"), "left").withColumn("_t", F.coalesce("_t", F.lit(False))).drop("_f")
    left = written(rest.where(~F.col("_t")).drop("_t"), "left")
    b = family_split(left, family, stratum, key, val, seed + 1).select(F.col(family).alias("_f"), F.col("held").alias("_v"))
    left = left.join(b, F.col(family) == F.col("_f"), "left").withColumn("split", F.when(F.coalesce("_v", F.lit(False)), "val").otherwise("train"))
    pick = lambda d, s: d.select(key, text, (F.lit(s) if isinstance(s, str) else s).alias("split"))
    every = pick(held.where("held"), "test").union(pick(rest.where("_t"), "test")).union(pick(left, F.col("split"))).union(pick(df.where(ext), "extended"))
    every = written(every, "dealt")
    train = first_of(every.where("split = 'train'"), dedup_norm(F.col(text)), key)
    every = every.where("split <> 'train'").unionByName(train)
    place = F.array_position(F.array(*[F.lit(x) for x in ("test", "val", "train", "extended")]), F.col("split"))
    return by_priority(every, dedup_norm(F.col(text)), place).select(key, "split")


def leaks(split: DataFrame, df: DataFrame, key: str, family: str, marked: Column) -> DataFrame:
    """``(kind, leaks)`` of a split: families in train and another split, marked rows in train. All 0 if it is sound."""
    r = split.join(df.select(key, F.col(family).alias("_f"), F.coalesce(marked, F.lit(False)).alias("_m")), key)
    per = r.where("split in ('train', 'test', 'val') and coalesce(_f, '') <> ''").groupBy("_f").agg(F.count_if(F.col("split") == "train").alias("a"), F.count_if(F.col("split") != "train").alias("b"))
    fam = per.agg(F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("leaks")).select(F.lit("family").alias("kind"), "leaks")
    return fam.union(r.agg(F.count_if((F.col("split") == "train") & F.col("_m")).alias("leaks")).select(F.lit("marked"), "leaks"))
