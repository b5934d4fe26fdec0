"""Splits that keep related records together.

Rows name seeds; seeds named by one row are related. Components are found by
random-mate contraction in SQL joins, unwound to labels, and dealt to splits by
cumulative weight within each stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.quota import denoted
from tessella.session import written

#: A seed's number after its prefix, at the start, or after a list separator. What follows a
#: variant's number (``var_seed_12_9ab3``) isn't preceded by one of these and names nothing.
SEED = r"(?:seed[\s_\-№#]*|#\s*|№\s*|^[\s\"']*|[;|+/,]\s*)0*([1-9][0-9]{0,6})(?![0-9])"


def seed_numbers(col: Column) -> Column:
    """Distinct numbers of the seeds that a loosely written ``seed_id`` names; empty for placeholders and NULL."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(SEED), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("bigint"))))


def seed_name(col: Column) -> Column:
    return F.concat(F.lit("seed_"), F.lpad(col.cast("string"), 7, "0"))


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(v, component)`` of every vertex of ``edges(u, v)`` (bigint), ``component`` being its smallest vertex.

    Random mate: each round every vertex tosses a coin that is a hash of vertex
    and round; a tail beside a head is merged into its smallest head, edges are
    relabelled, loops and repeats go. A tail with a neighbour is merged with
    probability 1/2 or more, so the rounds are logarithmic whatever the shape (a path of a
    billion vertices too). Then the merges are unwound last to first. No vertex
    list is ever gathered: a hub costs one partially aggregated minimum.
    """
    coin = lambda c, i: F.pmod(F.xxhash64(c, F.lit(i)), F.lit(2)) == 1
    pair = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    live = edges.where("u <> v").select(*pair(F.col("u"), F.col("v"))).distinct()
    live = first = written(live, "edges")
    merged = []
    for i in range(max_rounds):
        if live.isEmpty():
            break
        both = live.union(live.select("v", "u"))
        link = both.where(~coin(F.col("u"), i) & coin(F.col("v"), i)).groupBy("u").agg(F.min("v").alias("p"))
        link = written(link, f"links{i}")
        merged.append(link)
        a, b = link.select(F.col("u"), F.col("p").alias("pu")), link.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        new = live.join(a, "u", "left").join(b, "v", "left")
        new = new.select(*pair(F.coalesce("pu", "u"), F.coalesce("pv", "v"))).where("u <> v").distinct()
        live = written(new, f"edges{i}")
    else:
        raise RuntimeError("components: edges left after the last round")
    label = None
    for k, link in enumerate(reversed(merged)):
        if label is None:
            label = link.select("u", F.col("p").alias("root"))
        else:
            up = label.select(F.col("u").alias("p"), "root")
            label = link.join(up, "p", "left").select("u", F.coalesce("root", "p").alias("root")).union(label)
        if k % 6 == 5:
            label = written(label, f"labels{k}")
    if label is None:
        return first.select("v", F.col("u").alias("component"))
    label = written(label, "labels")
    # roots were never merged; they label themselves
    label = label.union(label.select(F.col("root").alias("u"), "root").distinct())
    least = label.groupBy("root").agg(F.min("u").alias("component"))
    return label.join(least, "root").select(F.col("u").alias("v"), "component")


def grouped(df: DataFrame, key: str = "row_no", seed: str = "seed_id") -> DataFrame:
    """``(key, group bigint)`` for every row that names a seed. Rows naming none are tied to nothing and give no row."""
    rows = df.select(F.col(key), seed_numbers(F.col(seed)).alias("s")).where(F.size("s") > 0)
    # a row is tied by its first seed to each other it names: a star, never all pairs
    edges = rows.where(F.size("s") > 1).select(F.col("s")[0].alias("u"), F.explode(F.slice("s", 2, 1 << 30)).alias("v"))
    label = components(edges).select(F.col("v").alias("first"), "component")
    # labels are unique and only seeds with ties have one; AQE splits the rows of a hot seed
    return rows.select(key, F.col("s")[0].alias("first")).join(label, "first", "left").select(key, F.coalesce("component", "first").alias("group"))


def shared_groups(df: DataFrame, key: str = "row_no", seed: str = "seed_id") -> DataFrame:
    """``(key, group_seed)`` of the rows whose group has two rows or more."""
    rows = written(grouped(df, key, seed), "grouped")
    alone = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias(key)).where("n = 1").select(key)
    return rows.join(alone, key, "left_anti").select(key, seed_name(F.col("group")).alias("group_seed"))


def assigned(df: DataFrame, targets: DataFrame, key: str = "row_no", seed: str = "seed_id", stratum: str = "route_domain", big: float = 0.002, slots: int = 256, labels: list[str] | None = None) -> DataFrame:
    """``(key, split, group, stratum)`` of every row; rows of one group share a split.

    ``targets(split_name, share)`` is a small table (its shares are normalised).
    A group holding more than ``big`` of all rows (there are at most 1/``big``
    of them, so the driver may hold them) goes to the split farthest below its
    share, largest first. The others are laid on a line per stratum, in an order
    given by a hash, and cut where the cumulative weight passes what is left of
    the shares. The line is a two-level prefix sum: over ``slots`` hash ranges,
    then inside each, so no task orders a whole stratum. Rows that name no seed
    are groups of their own. A group's stratum is the one most of its rows have
    (ties: by a fixed hash). ``labels`` are the strata; rows whose label denotes
    none of them are the stratum ``''``. Without ``labels`` there is one stratum.
    """
    g = grouped(df, key, seed)
    base = df.select(F.col(key), F.lit("").alias("_s"))
    if labels:  # read once a spelling
        spelled = df.select(F.col(stratum).alias("_l")).distinct().where("_l is not null")
        spelled = written(spelled.select("_l", F.coalesce(denoted(F.col("_l"), labels), F.lit("")).alias("_s")), "spellings")
        base = df.select(F.col(key), F.col(stratum).alias("_l")).join(spelled, "_l", "left").select(key, F.coalesce("_s", F.lit("")).alias("_s"))
    base = base.join(g, key, "left")
    base = written(base.withColumn("_g", F.coalesce(F.col("group"), -F.xxhash64(F.lit(3), F.col(key)).bitwiseAND(F.lit((1 << 62) - 1)) - 1)), "split_rows")
    by = base.groupBy("_g", "_s").agg(F.count(F.lit(1)).alias("n"))
    comp = by.groupBy("_g").agg(F.sum("n").alias("w"), F.max_by("_s", F.struct(F.col("n"), -F.crc32("_s"))).alias("_s"))
    comp = written(comp, "split_groups")
    want = [(r[0], float(r[1])) for r in targets.select("split_name", "share").orderBy("split_name").collect()]
    total_share = sum(s for _, s in want)
    if not want or total_share <= 0:
        raise ValueError("targets need at least one split with a positive share")
    want = [(n, s / total_share) for n, s in want if s > 0]
    total = comp.agg(F.sum("w")).first()[0] or 0
    large = comp.where(F.col("w") > max(1.0, big * total)).collect()
    sums = {r["_s"]: r["w"] for r in comp.groupBy("_s").agg(F.sum("w").alias("w")).collect()}  # one row a stratum
    got = {(s, n): 0 for s in sums for n, _ in want}
    fixed = []
    for r in sorted(large, key=lambda r: (-r["w"], r["_g"])):
        s = r["_s"]
        name = max(want, key=lambda t: (t[1] * sums[s] - got[s, t[0]], t[1]))[0]
        got[s, name] += r["w"]
        fixed.append((r["_g"], name))
    cuts = []
    for s in sums:
        need = [(n, max(0.0, sh * sums[s] - got[s, n])) for n, sh in want]
        whole = sum(x for _, x in need) or 1.0
        at = 0.0
        for n, x in need:
            if x > 0:
                cuts.append((s, n, at, at + x / whole))
                at += x / whole
    spark = df.sparkSession
    fixed_df = spark.createDataFrame(fixed, "_g bigint, _fixed string")
    cuts_df = spark.createDataFrame(cuts, "_s string, split string, lo double, hi double")
    small = comp.join(F.broadcast(fixed_df), "_g", "left_anti")  # at most 1/big rows
    small = small.withColumn("_o", F.xxhash64(F.lit(5), F.col("_g"))).withColumn("_slot", F.pmod("_o", F.lit(slots)))
    slot = small.groupBy("_s", "_slot").agg(F.sum("w").alias("sw"))  # strata x slots rows
    before = Window.partitionBy("_s").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slot = slot.select("_s", "_slot", F.coalesce(F.sum("sw").over(before), F.lit(0)).alias("off"), F.sum("sw").over(Window.partitionBy("_s")).alias("all"))
    inside = Window.partitionBy("_s", "_slot").orderBy("_o", "_g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mid = small.withColumn("cum", F.sum("w").over(inside)).join(slot, ["_s", "_slot"])
    mid = mid.withColumn("at", (F.col("off") + F.col("cum") - F.col("w") / 2) / F.col("all"))
    cut = F.broadcast(cuts_df)  # strata x splits rows
    dealt = mid.join(cut, "_s").where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("_g", "split")
    rest = mid.select("_g", "_s").join(dealt, "_g", "left_anti").select("_g", F.lit(max(want, key=lambda t: t[1])[0]).alias("split"))
    where = dealt.union(rest).union(fixed_df.select("_g", "_fixed"))
    return base.join(where, "_g").select(key, "split", F.when(F.col("group").isNotNull(), seed_name(F.col("group"))).alias("group_seed"), F.col("_s").alias("stratum"))
