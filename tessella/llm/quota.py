"""Samples that match target category proportions.

Quotas are a two-way table (domain x subtype). It is made integer by a maximum
flow that keeps both margins, then every cell takes exactly its quota of rows,
those with the smallest random keys.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import written

#: Rows of a target table that the driver may hold.
MAX_CELLS = 100_000


def plain(label: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def denoted(label: Column, vocabulary: list[str]) -> Column:
    """The word of ``vocabulary`` that a loosely written label means, else NULL.

    Case, blanks and punctuation don't count. One letter wrong, lost, added or
    two swapped still denotes a word if that fits only one of them; words of
    under four letters allow a swap alone.
    """
    x = plain(label)
    keys = {"".join(ch for ch in v.lower() if ch.isalnum()): v for v in vocabulary}
    exact = F.coalesce(*[F.when(x == k, F.lit(v)) for k, v in keys.items()], F.lit(None).cast("string"))
    letters = F.array_sort(F.split(x, ""))

    def near(k: str) -> Column:
        swap = (F.length(x) == len(k)) & (letters == F.array(*[F.lit(c) for c in sorted(k)])) & (F.levenshtein(x, F.lit(k)) <= 2)
        return swap | (F.levenshtein(x, F.lit(k)) <= 1) if len(k) >= 4 else swap

    fits = F.filter(F.array(*[F.when(near(k), F.lit(v)) for k, v in keys.items()]), lambda v: v.isNotNull())
    return F.when(x == "", None).when(exact.isNotNull(), exact).when(F.size(fits) == 1, F.get(fits, F.lit(0)))


def target_rows(targets: DataFrame) -> list[dict]:
    rows = [r.asDict() for r in targets.select("route_domain", "subtype", "target_share", "min_rows").limit(MAX_CELLS + 1).collect()]
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} target categories")
    return sorted(rows, key=lambda r: (r["route_domain"] or "", r["subtype"] or ""))


def spellings(df: DataFrame, cells: list[dict]) -> DataFrame:
    """``(route_domain, subtype, _d, _s, n)``: each pair of labels as written, the target labels it
    denotes (NULL: none) and its rows. Labels are read once a spelling, not once a row."""
    spelled = df.groupBy("route_domain", "subtype").agg(F.count(F.lit(1)).alias("n"))
    doms, subs = (sorted({r[k] for r in cells if r[k]}) for k in ("route_domain", "subtype"))
    if not doms or not subs:
        return spelled.withColumn("_d", F.lit(None).cast("string")).withColumn("_s", F.lit(None).cast("string"))
    return written(spelled.withColumn("_d", denoted(F.col("route_domain"), doms)).withColumn("_s", denoted(F.col("subtype"), subs)), "spellings")


def run(df: DataFrame, targets: DataFrame, share: float = 0.2) -> tuple[list[dict], DataFrame]:
    """The quota table, a dict a target category, and the :func:`spellings` it was made from.

    ``rows`` it has, ``wanted`` by its share of the sample, ``quota`` after controlled
    rounding of the two-way table, and ``short``: what it is asked for, by share or by ``min_rows``, is more than it has.
    """
    cells = target_rows(targets)
    spelled = spellings(df, cells)
    # spellings that denote nothing are one row: the result is bounded by the target table
    have = {(r["_d"], r["_s"]): r["n"] for r in spelled.groupBy("_d", "_s").agg(F.sum("n").alias("n")).collect()}
    size = math.floor(sum(have.values()) * share + 1e-9)
    quota = quotas(cells, have, size)
    out = []
    for r in cells:
        k = (r["route_domain"], r["subtype"])
        n, want, least = have.get(k, 0), float(r["target_share"] or 0) * size, int(r["min_rows"] or 0)
        short = n < want - 1e-9 or n < least
        out.append({"route_domain": k[0], "subtype": k[1], "rows": n, "wanted": want, "min_rows": least, "quota": quota[k], "short": short})
    return out, spelled


def shortfalls(df: DataFrame, targets: DataFrame, share: float = 0.2) -> DataFrame:
    """Each target category with its rows, what was wanted of it, its quota and whether it falls short."""
    table, _ = run(df, targets, share)
    kinds = "route_domain string, subtype string, rows bigint, wanted double, min_rows int, quota bigint, short boolean"
    return df.sparkSession.createDataFrame([tuple(r.values()) for r in table], kinds)


class _Flow:
    def __init__(self, n: int):
        self.to, self.cap, self.adj = [], [], [[] for _ in range(n)]

    def edge(self, a: int, b: int, cap: int) -> int:
        for x, y, c in ((a, b, cap), (b, a, 0)):
            self.adj[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        flow = 0
        while True:
            level = {s: 0}
            queue = deque([s])
            while queue:
                u = queue.popleft()
                for e in self.adj[u]:
                    if self.cap[e] and self.to[e] not in level:
                        level[self.to[e]] = level[u] + 1
                        queue.append(self.to[e])
            if t not in level:
                return flow
            at = [0] * len(self.adj)
            while True:
                path, u = [], s
                while u != t:
                    while at[u] < len(self.adj[u]):
                        e = self.adj[u][at[u]]
                        if self.cap[e] and level.get(self.to[e], -1) == level[u] + 1:
                            break
                        at[u] += 1
                    else:
                        if u == s:
                            path = None
                            break
                        level[u] = -1
                        e = path.pop()
                        u = self.to[e ^ 1]
                        continue
                    path.append(e)
                    u = self.to[e]
                if path is None:
                    break
                push = min(self.cap[e] for e in path)
                for e in path:
                    self.cap[e] -= push
                    self.cap[e ^ 1] += push
                flow += push


def controlled_round(table: dict[tuple, float]) -> dict[tuple, int]:
    """Integers beside ``table[(row, column)]``: every entry, row sum, column sum
    and the total is the floor or the ceiling of its own value."""
    eps = 1e-9
    lo = lambda x: math.floor(x + eps)
    hi = lambda x: math.ceil(x - eps)
    rows, cols = sorted({i for i, _ in table}, key=repr), sorted({j for _, j in table}, key=repr)
    ri, ci = {r: k for k, r in enumerate(rows)}, {c: k + len(rows) for k, c in enumerate(cols)}
    s, t = len(rows) + len(cols), len(rows) + len(cols) + 1
    ss, tt = t + 1, t + 2
    net, need = _Flow(tt + 1), [0] * (tt + 1)

    def bounded(a: int, b: int, x: float) -> int:
        need[b] += lo(x)
        need[a] -= lo(x)
        return net.edge(a, b, hi(x) - lo(x))

    rsum, csum = dict.fromkeys(rows, 0.0), dict.fromkeys(cols, 0.0)
    for (i, j), x in table.items():
        rsum[i] += x
        csum[j] += x
    for i in rows:
        bounded(s, ri[i], rsum[i])
    own = {k: bounded(ri[k[0]], ci[k[1]], x) for k, x in table.items()}
    for j in cols:
        bounded(ci[j], t, csum[j])
    bounded(t, s, sum(table.values()))
    for v, x in enumerate(need):
        if x > 0:
            net.edge(ss, v, x)
        elif x < 0:
            net.edge(v, tt, -x)
    net.run(ss, tt)
    return {k: lo(x) + net.cap[own[k] ^ 1] for k, x in table.items()}


def quotas(cells: list[dict], have: dict, size: int) -> dict[tuple, int]:
    """Integer rows to take per category: the target shares of ``size``, at least
    ``min_rows``, at most what there is. What some categories can't fill goes to
    those with room, in proportion to their shares, so the sample keeps its size."""
    keys = [(r["route_domain"], r["subtype"]) for r in cells]
    share = {k: float(r["target_share"] or 0) for k, r in zip(keys, cells, strict=True)}
    room = {k: have.get(k, 0) for k in keys}
    least = {k: min(int(r["min_rows"] or 0), room[k]) for k, r in zip(keys, cells, strict=True)}
    size = min(size, sum(room.values()))
    q = {k: float(least[k]) for k in keys}
    # water level: q = clip(level * share, least, room) with sum = size
    low, high = 0.0, 1.0
    at = lambda f: {k: min(max(f * share[k] * max(size, 1), least[k]), room[k]) for k in keys}
    while sum(at(high).values()) < size and high < 1e12:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(at(mid).values()) < size else (low, mid)
    if sum(at(high).values()) >= size - 1e-6:
        q = at(high)
    return controlled_round(q)


def drawn(df: DataFrame, targets: DataFrame, share: float = 0.2, key: str = "row_no", seed: int = 17, slots: int = 4096) -> DataFrame:
    """``(key, route_domain, subtype)``: the sample, exactly each cell's quota.

    Rows of a cell are ordered by a random key. A histogram of keys by cell
    (``slots`` ranges) shows in which range the quota is reached: lower ranges
    are taken whole, and only that one range is ordered, so a cell with a third
    of all rows is never sorted in one task.
    """
    table, spelled = run(df, targets, share)
    spark = df.sparkSession
    q = spark.createDataFrame([(r["route_domain"], r["subtype"], r["quota"]) for r in table], "_d string, _s string, _q bigint")
    # labels that denote a category are never NULL; Spark broadcasts the spellings if it finds them few
    names = spelled.where("_d is not null and _s is not null").select("route_domain", "subtype", "_d", "_s")
    rows = df.select(F.col(key), "route_domain", "subtype").join(names, ["route_domain", "subtype"])
    rows = rows.select(key, "_d", "_s", F.xxhash64(F.lit(seed), F.col(key)).alias("_r"))
    rows = rows.withColumn("_b", F.pmod("_r", F.lit(slots)))
    seen = rows.groupBy("_d", "_s", "_b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_d", "_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # slots rows a cell
    cut = seen.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(q), ["_d", "_s"])
    cut = cut.where("_before < _q").select("_d", "_s", "_b", (F.col("_q") - F.col("_before")).alias("_left"), "n")
    kept = rows.join(cut, ["_d", "_s", "_b"])
    whole = kept.where("n <= _left")
    order = Window.partitionBy("_d", "_s", "_b").orderBy("_r", key)
    part = kept.where("n > _left").withColumn("_k", F.row_number().over(order)).where("_k <= _left")
    pick = [F.col(key), F.col("_d").alias("route_domain"), F.col("_s").alias("subtype")]
    return whole.select(*pick).union(part.select(*pick))
