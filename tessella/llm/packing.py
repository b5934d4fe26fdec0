"""Filling fixed-capacity containers with documents.

Documents are dealt to pools by a hash, each pool is packed by bin completion
(branch and bound over containers, best fit as incumbent),
and what a pool's last, poorly filled containers hold is pooled and packed again,
until one small pool is left. Nothing but sizes and keys is moved.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import written

#: Documents of a pool; completions that the search of a pool may try before its incumbent stands.
POOL, NODES = 4_000, 2_000
#: Fillings of one container that are set against each other, and steps to list them.
CHOICES, STEPS = 4, 200


def byte_tokens(text: Column) -> Column:
    """Size under a byte-level tokenizer: one token a UTF-8 byte and one end mark."""
    return F.octet_length(text) + F.lit(1)


def lower_bound(sizes: np.ndarray, count: np.ndarray, capacity: int) -> int:
    """Containers that ``count`` documents of the distinct ``sizes`` need at least: for each t up to half a
    container, documents of more than capacity - t stand alone, those of more than a half
    share with none of their kind, and what those of t or more leave over needs room of its own."""
    total = sizes * count
    best = -(-int(total.sum()) // capacity)
    half = int(count[2 * sizes > capacity].sum())
    for t in np.unique(sizes[2 * sizes <= capacity]):
        big, mid = sizes > capacity - t, (sizes <= capacity - t) & (2 * sizes > capacity)
        low = (2 * sizes <= capacity) & (sizes >= t)
        room = int(count[mid].sum()) * capacity - int(total[mid].sum())
        best = max(best, int(count[big].sum()) + int(count[mid].sum()) + max(0, -(-(int(total[low].sum()) - room) // capacity)))
        if len(sizes) > 2_000:  # the sum alone decides among so many sizes
            break
    return max(best, half)


def dominated(filling: list[int], sizes: np.ndarray, left: np.ndarray, slack: int) -> bool:
    """Whether another filling of the same container is at least as good whatever comes after: one
    of its documents, or two together, can be swapped for one larger unused document that fits the
    ``slack`` too (what is swapped out fits wherever that one would have gone). ``filling`` holds indices into
    ``sizes`` (distinct, descending), ``left`` what is unused besides."""
    if not slack and len(filling) < 2:
        return False

    def larger(low: int, high: int) -> bool:
        """An unused size in (low, high]."""
        a, z = int(np.searchsorted(-sizes, -high)), int(np.searchsorted(-sizes, -low))
        return bool(left[a:z].any())

    own = [int(sizes[k]) for k in filling]
    if slack and any(larger(x, x + slack) for x in set(own)):
        return True
    pairs = {x + y for i, x in enumerate(own) for y in own[i + 1 :]}
    return any(larger(x - 1, x + slack) for x in pairs)


def completions(sizes: np.ndarray, left: np.ndarray, room: int, choices: int = CHOICES, steps: int = STEPS) -> list[tuple[int, list[int]]]:
    """``(waste, filling)`` of up to ``choices`` undominated fillings of ``room``, the fullest first, each as
    indices into ``sizes`` (distinct, descending). The first filling tried is best fit: the largest that
    fits, again and again. A branch is cut when even all that it may still take can't beat the worst filling kept."""
    n, left = len(sizes), left.copy()

    def largest(room: int, start: int) -> int:
        k = max(start, int(np.searchsorted(-sizes, -room)))
        while k < n and not left[k]:
            k += 1
        return k

    found: list[tuple[int, list[int]]] = []
    stack: list[tuple[int, int]] = []  # (index taken, room before)
    gap, at, seen = room, largest(room, 0), 0
    while True:
        if at < n and gap > 0:
            seen += 1
            stack.append((at, gap))
            left[at] -= 1
            gap -= int(sizes[at])
            at = largest(gap, at)
            continue
        filling = [k for k, _ in stack]  # maximal: nothing more fits after its last document
        if filling and all(f != filling for _, f in found) and not dominated(filling, sizes, left, gap):
            found = sorted([*found, (gap, filling)], key=lambda f: f[0])[:choices]
        if not stack or seen >= steps or (len(found) == choices and not found[-1][0]):
            break
        k, gap = stack.pop()
        left[k] += 1
        at = k + 1
        while at < n and not left[at]:
            at += 1
        worst = found[-1][0] if len(found) == choices else room + 1
        if at < n and int(sizes[at]) * int(left[at:].sum()) <= gap - worst:
            at = n
    if not found:  # no step was left to reach an undominated one: best fit is always allowed
        filling, gap, left = [], room, left.copy()
        for k, _ in stack:
            left[k] += 1
        at = largest(room, 0)
        while at < n:
            filling.append(at)
            left[at] -= 1
            gap -= int(sizes[at])
            at = largest(gap, at)
        found = [(gap, filling)] if filling else []
    return found


def _best_fit(sizes: np.ndarray, count: np.ndarray, capacity: int) -> list[list[int]]:
    """Largest first, each into the fullest container with room."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # sorted (room, container)
    for k, c in enumerate(count):
        x = int(sizes[k])
        for _ in range(int(c)):
            p = bisect_left(rooms, (x, -1))
            if p < len(rooms):
                room, b = rooms.pop(p)
            else:
                room, b = capacity, len(bins)
                bins.append([])
            bins[b].append(k)
            if room > x:
                insort(rooms, (room - x, b))
    return bins


def searched(sizes: np.ndarray, count: np.ndarray, capacity: int, nodes: int = NODES) -> tuple[list[list[int]], bool]:
    """Containers as lists of indices into the distinct, descending ``sizes``, and whether they are known to be the fewest (the bound is met).

    Bin completion: the largest document left opens a container, which is completed
    by each of its undominated fillings in turn, the fullest first, and the rest is
    packed likewise; the search goes back over containers. A branch is cut when its containers and the
    room that the rest fills at least are no fewer than the incumbent's. Best-fit decreasing is the first incumbent. The search
    ends when :func:`lower_bound` is met, all listed fillings are searched, or ``nodes`` completions beyond the first descent are tried.
    """
    best = _best_fit(sizes, count, capacity)
    bound = lower_bound(sizes, count, capacity)
    if len(best) <= bound:
        return best, True
    tried, left = 0, count.copy()
    done: list[list[int]] = []
    stack: list[list[list[int]]] = []  # fillings not yet tried, per open container
    left_sum = int((sizes * count).sum())

    def options() -> list[list[int]]:
        top = int(np.flatnonzero(left)[0])
        left[top] -= 1
        room = capacity - int(sizes[top])
        # full ones last: they are taken from the end
        out = [[top, *f] for _, f in reversed(completions(sizes, left, room))] if room else []
        left[top] += 1
        return out or [[top]]

    stack.append(options())
    while stack:
        if not stack[-1]:
            stack.pop()
            if done:
                for k in done.pop():
                    left[k] += 1
                    left_sum += int(sizes[k])
            continue
        filling = stack[-1].pop()
        tried += 1
        for k in filling:
            left[k] -= 1
            left_sum -= int(sizes[k])
        done.append(filling)
        rest = -(-left_sum // capacity)
        if not left_sum:
            if len(done) < len(best):
                best = [list(f) for f in done]
            if len(best) <= bound:
                return best, True
        elif len(done) + rest < len(best) and tried < nodes + len(best):  # the first descent is always finished
            stack.append(options())
            continue
        for k in done.pop():
            left[k] += 1
            left_sum += int(sizes[k])
        if tried >= nodes + len(best):
            break
    return best, False


def packed(sizes: np.ndarray, capacity: int, nodes: int = NODES) -> np.ndarray:
    """Container number of each document (sizes at most ``capacity``)."""
    uniq, inv, count = np.unique(-sizes, return_inverse=True, return_counts=True)
    out = np.full(len(sizes), -1, np.int64)
    if not len(sizes):
        return out
    members = np.split(np.argsort(inv, kind="stable"), np.cumsum(count)[:-1])
    queue = [list(m[::-1]) for m in members]
    for b, filling in enumerate(searched(-uniq, count, capacity, nodes)[0]):
        for k in filling:
            out[queue[k].pop()] = b
    return out


def _pack_pools(items: DataFrame, good: float, pools: int) -> DataFrame:
    """Packs each ``(pack_id, pool)`` of ``(pack_id, cap, pool, doc, size)``; adds container number and whether it
    stays: it is filled to ``good`` or belongs to the fuller half of its pool's."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        cap = int(pdf["cap"].iloc[0])
        pdf = pdf.sort_values(["size", "doc"], ascending=[False, True], kind="stable")
        pdf["bin"] = packed(pdf["size"].to_numpy(), cap)
        fill = pdf.groupby("bin")["size"].sum()
        # the fuller half stays in any case, so that each level has at most half the containers of the one before
        stays = (fill >= good * cap) | (fill.rank(method="first", ascending=False) <= (len(fill) + 1) // 2)
        pdf["full"] = pdf["bin"].map(stays)
        return pdf[["pack_id", "cap", "pool", "doc", "size", "bin", "full"]]

    # a pool is few bytes and much work: pools are dealt to tasks by number, four or so to each
    return items.repartition(max(1, -(-pools // 4)), "pack_id", "pool").groupBy("pack_id", "pool").applyInPandas(one, "pack_id string, cap bigint, pool bigint, doc bigint, size bigint, bin bigint, full boolean")


def containers(docs: DataFrame, packs: DataFrame, key: str = "doc_id", text: str = "text", pool: int = POOL, good: float = 0.98, size: Column | None = None) -> DataFrame:
    """``(pack_id, key, container, part, tokens)`` of every document for every kind of container.

    Documents that fit are whole (``part`` 0). A larger one alone is split: full
    containers of its own (``part`` 0, 1, ...), and its rest is packed like a
    document (the last part). NULL and empty texts have no content and are left
    out; blank ones have. ``size`` may replace the byte-level token count.
    ``container`` is unique per kind. Kinds without a positive capacity are left out.
    """
    spark = docs.sparkSession
    sized = docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).cast("bigint").alias("doc"), (size if size is not None else byte_tokens(F.col(text))).cast("bigint").alias("tokens"))
    kinds = packs.where("capacity_tokens > 0").select("pack_id", "capacity_tokens").dropDuplicates(["pack_id"]).limit(1001).collect()
    if len(kinds) > 1000:
        raise ValueError("more than 1000 kinds of containers")
    kind = F.array(*[F.struct(F.lit(k).alias("pack_id"), F.lit(int(c)).cast("bigint").alias("cap")) for k, c in kinds])
    none = F.array().cast("array<struct<pack_id:string,cap:bigint>>")
    each = sized.select("doc", "tokens", F.explode(kind if kinds else none).alias("k"))
    each = written(each.select("doc", "tokens", "k.pack_id", "k.cap"), "sized")
    whole = F.floor(F.col("tokens") / F.col("cap"))
    over = each.where("tokens > cap").withColumn("n", whole)
    own = over.select("pack_id", "cap", "doc", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("part"), F.col("cap").alias("tokens"))
    own = own.select("pack_id", "doc", F.concat_ws("-", F.lit("own"), "doc", "part").alias("container"), "part", "tokens")
    rest = over.select("pack_id", "cap", "doc", (F.col("tokens") - F.col("n") * F.col("cap")).alias("size"), F.col("n").alias("part")).where("size > 0")
    fit = each.where("tokens <= cap").select("pack_id", "cap", "doc", F.col("tokens").alias("size"), F.lit(0).cast("bigint").alias("part")).union(rest)
    parts = fit.select("pack_id", "doc", "part")
    todo, level, done = fit.select("pack_id", "cap", "doc", "size"), 0, []
    while True:
        n = {r[0]: r[1] for r in todo.groupBy("pack_id").count().collect()}  # one row a kind
        pools = spark.createDataFrame([(k, max(1, -(-v // pool))) for k, v in n.items()], "pack_id string, pools bigint")
        t = todo.join(F.broadcast(pools), "pack_id").withColumn("pool", F.pmod(F.xxhash64(F.lit(level), F.col("doc")), F.col("pools")))
        last = all(v <= pool for v in n.values())
        got = written(_pack_pools(t.select("pack_id", "cap", "pool", "doc", "size"), 0.0 if last else good, sum(max(1, -(-v // pool)) for v in n.values())), f"pools{level}")
        name = F.concat_ws("-", F.lit(f"{level}"), "pool", "bin")
        done.append(got.where("full").select("pack_id", "doc", name.alias("container"), "size"))
        if last:
            break
        todo, level = got.where("not full").select("pack_id", "cap", "doc", "size"), level + 1
    packed_all = done[0]
    for d in done[1:]:
        packed_all = packed_all.union(d)
    out = packed_all.join(parts, ["pack_id", "doc"]).select("pack_id", "doc", "container", "part", F.col("size").alias("tokens"))
    return out.union(own).select("pack_id", F.col("doc").alias(key), "container", "part", "tokens")


def oversize(packing: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(pack_id, key)`` of the documents a packing had to split."""
    return packing.where("part > 0").select("pack_id", key).distinct()


def waste(packing: DataFrame, packs: DataFrame) -> DataFrame:
    """Per kind: containers, documents' tokens, and the share of room unused."""
    by = packing.groupBy("pack_id").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    cap = F.col("containers") * F.col("capacity_tokens")
    return by.join(F.broadcast(packs.select("pack_id", "capacity_tokens")), "pack_id").select("pack_id", "containers", "tokens", F.round(1 - F.col("tokens") / cap, 6).alias("unused"))
