"""Keys of records in slots.

A record bears many 64-bit keys (bands of minwise hashes, fingerprints). Each key
goes to a slot by hash, with a signature of its record: the row, a 64-bit map of
its words and their number. Keys travel and are stored as packed arrays, a few
per slot, and meet in numpy: two records under one key are a pair only if their
signatures allow them to be near-same, so most chance meetings end where they
happen and no list of them is ever moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.records import unpacked

#: Two records are near-same from this share of common words: 3/5.
NUM, DEN = 3, 5
#: Bands of minwise hashes and hashes a band: sets with a share of 0.6 of common words miss each other with probability 0.012, of 0.65 with 0.002.
BANDS, ROWS = 32, 4
ENTRIES = "slot int, keys binary, rows binary, maps binary, sizes binary"
_KINDS = (("keys", np.uint32), ("rows", np.int64), ("maps", np.uint64), ("sizes", np.int32))
#: Entries that a task holds before it packs them; pairs that are compared at a time.
_HELD, _AT_ONCE = 1_500_000, 1_000_000


def band_keys(flat: np.ndarray, starts: np.ndarray, nums: np.ndarray, bands: int = BANDS, rows: int = ROWS, seed: int = 1) -> np.ndarray:
    """``[records, bands]`` 64-bit keys of the non-empty word sets laid end to end in ``flat`` (uint32)."""
    rng = np.random.default_rng(seed)
    mul = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    out = np.empty((len(starts), bands), np.uint64)
    h = np.empty_like(flat)
    for b in range(bands):
        acc = nums.astype(np.uint64) ^ np.uint64((b + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        for r in range(rows):
            np.multiply(flat, mul[b * rows + r], out=h)
            h += add[b * rows + r]
            acc ^= np.minimum.reduceat(h, starts)
            acc *= np.uint64(0xFF51AFD7ED558CCD)
            acc ^= acc >> np.uint64(31)
        out[:, b] = acc
    return out


def bands_of(bands: int, rows: int, seed: int = 1) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]:
    """Band keys of batches of ``(words, nums)``, as ``(record, key)``; records without words have none."""

    def keys(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        flat, starts, lens = unpacked(b.column("words"))
        some = np.flatnonzero(lens)
        if not len(some):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        k = band_keys(flat, starts[some], b.column("nums").to_numpy()[some], bands, rows, seed)
        return np.repeat(some, bands), k.ravel()

    return keys


def slot_ids(spark: SparkSession, partitions: int, each: int = 2) -> list[int]:
    """Slot numbers of which exactly ``each`` fall into every one of ``partitions`` hash partitions."""
    width = 32
    while True:
        part = F.pmod(F.hash(F.col("id").cast("int")), F.lit(partitions))
        rows = spark.range(partitions * each * width).groupBy(part.alias("p")).agg(F.slice(F.array_sort(F.collect_list("id")), 1, each).alias("ids")).collect()
        if len(rows) == partitions and all(len(r["ids"]) == each for r in rows):
            return [int(i) for r in sorted(rows, key=lambda r: r["p"]) for i in r["ids"]]
        width *= 2


def _order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The order by ``high`` (32 bits, none negative), then ``low``: by one number of both where they fit, which is several times faster."""
    base, most = (low.min(), low.max()) if len(low) else (0, 0)
    if int(most) - int(base) >> 32:
        return np.lexsort((low, high))
    return np.argsort((high.astype(np.uint64) << np.uint64(32)) | (low - base).astype(np.uint64))


def _distinct(pairs: np.ndarray) -> np.ndarray:
    """The different rows of ``pairs``, sorted."""
    if not len(pairs):
        return pairs
    least, most = pairs.min(axis=0), pairs.max(axis=0)
    if any(int(z) - int(a) >> 32 for a, z in zip(least, most, strict=True)):
        return np.unique(pairs, axis=0)
    a, b = (pairs - least).astype(np.uint64).T
    both = np.unique((a << np.uint64(32)) | b)
    return np.stack([both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)], 1).astype(np.int64) + least


def slotted(df: DataFrame, keys: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], needs: tuple[str, ...], slots: list[int]) -> DataFrame:
    """``ENTRIES`` of ``df(row, map, size, *needs)``: what ``keys`` gives, packed by slot and sorted by key."""
    numbers = np.array(slots, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            slot, *cols = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = _order(slot, cols[0])
            slot = slot[order]
            cut = np.r_[0, np.flatnonzero(slot[1:] != slot[:-1]) + 1, len(slot)]
            cols = [np.ascontiguousarray(c[order]) for c in cols]
            packed = [pa.array([c[a:z].tobytes() for a, z in zip(cut, cut[1:], strict=False)], pa.binary()) for c in cols]
            return pa.RecordBatch.from_arrays([pa.array(numbers[slot[cut[:-1]]]), *packed], ["slot", *(k for k, _ in _KINDS)])

        for b in batches:
            rec, key = keys(b)
            if not len(rec):
                continue
            row, m, n = (b.column(c).to_numpy()[rec] for c in ("row", "map", "size"))
            held.append(((key % np.uint64(len(numbers))).astype(np.int32), (key >> np.uint64(32)).astype(np.uint32), row, m.view(np.uint64), n.astype(np.int32)))
            if sum(len(h[0]) for h in held) > _HELD:
                yield out()
        if held:
            yield out()

    return df.select("row", "map", "size", *needs).mapInArrow(run, ENTRIES)


def chunks(table: pa.Table) -> list[tuple[np.ndarray, ...]]:
    """``(keys, rows, maps, sizes)`` of every packed row, each sorted by key, as views of the table's memory."""
    out = []
    for b in table.to_batches():
        cols = []
        for name, kind in _KINDS:
            c = b.column(name)
            off = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            data = np.frombuffer(c.buffers()[2], np.uint8) if c.buffers()[2] else np.empty(0, np.uint8)
            cols.append([data[x:y].view(kind) for x, y in zip(off, off[1:], strict=False)])
        out += list(zip(*cols, strict=True))
    return out


def opened(table: pa.Table) -> tuple[np.ndarray, ...]:
    """The packed rows of one slot as one, sorted by key, then row."""
    parts = chunks(table)
    if not parts:
        return tuple(np.empty(0, kind) for _, kind in _KINDS)
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = _order(cols[0], cols[1])
    return tuple(c[order] for c in cols)


def closed(slot: int, cols: tuple[np.ndarray, ...]) -> pa.Table:
    """One packed row, or none of no entries."""
    some = len(cols[0]) > 0
    arrays = [pa.array([slot] if some else [], pa.int32())] + [pa.array([np.ascontiguousarray(c).tobytes()] if some else [], pa.binary()) for c in cols]
    return pa.Table.from_arrays(arrays, ["slot", *(k for k, _ in _KINDS)])


def _allowed(ma: np.ndarray, na: np.ndarray, mb: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Necessary for near-same: neither set may have more words that the other surely
    lacks (a bit of its map that the other's has not) than the share allows."""
    na, nb = na.astype(np.int64), nb.astype(np.int64)
    total, both = NUM * (na + nb), NUM + DEN
    return (both * np.bitwise_count(ma & ~mb).astype(np.int64) <= both * na - total) & (both * np.bitwise_count(mb & ~ma).astype(np.int64) <= both * nb - total)


def between(e: tuple[np.ndarray, ...], t: tuple[np.ndarray, ...], crowd: int | None = None) -> np.ndarray:
    """``[n, 2]`` distinct ``(row of e, row of t)`` that share a key and whose signatures allow a pair.

    A key with more than ``crowd`` times as many meetings as entries is passed over, so
    the work stays in proportion to the entries; without ``crowd`` none is.
    """
    (ek, er, em, en), (tk, tr, tm, tn) = e, t
    first, n = np.searchsorted(tk, ek, "left"), np.searchsorted(tk, ek, "right")
    n = n - first
    if crowd is not None and len(ek):
        mine = np.searchsorted(ek, ek, "right") - np.searchsorted(ek, ek, "left")
        n = np.where(mine * n > crowd * (mine + n), 0, n)
    at = np.flatnonzero(n)
    found, lo, cum = [], 0, np.cumsum(n[at])
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(cum, (cum[lo - 1] if lo else 0) + _AT_ONCE, "right")))
        i = np.repeat(at[lo:hi], n[at[lo:hi]])
        j = np.arange(len(i)) - np.repeat(np.cumsum(n[at[lo:hi]]) - n[at[lo:hi]], n[at[lo:hi]]) + first[i]
        ok = _allowed(em[i], en[i], tm[j], tn[j])
        found.append(np.stack([er[i[ok]], tr[j[ok]]], 1))
        lo = hi
    return _distinct(np.concatenate(found)) if found else np.empty((0, 2), np.int64)


def within(cols: tuple[np.ndarray, ...], most: int, crowd: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``[n, 2]`` of ``(row, smaller row)`` under one key that signatures allow, and entries
    of hot keys: of over ``most`` entries, over ``crowd`` allowed pairs each. Their pairs are not listed."""
    k, r, m, n = cols
    if not len(k):
        return np.empty((0, 2), np.int64), np.empty(0, np.int64)
    end = np.searchsorted(k, k, "right")
    start = np.searchsorted(k, k, "left")
    size = end - start

    def pairs(at: np.ndarray, limit: float) -> list[np.ndarray] | None:
        out, d, seen = [], 1, 0
        while len(at := at[at + d < end[at]]):
            for lo in range(0, len(at), _AT_ONCE):
                i = at[lo : lo + _AT_ONCE]
                i = i[_allowed(m[i], n[i], m[i + d], n[i + d])]
                if len(i):
                    out.append(np.stack([r[i + d], r[i]], 1))
                    seen += len(i)
            if seen > limit:
                return None
            d += 1
        return out

    found = pairs(np.flatnonzero((size > 1) & (size <= most)), np.inf)
    hot = []
    for a in np.unique(start[size > most]):
        group = np.arange(a, end[a])
        more = pairs(group, crowd * len(group))
        if more is None:
            hot.append(group)
        else:
            found += more
    p = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    return _distinct(p[p[:, 0] != p[:, 1]]), np.concatenate(hot) if hot else np.empty(0, np.int64)


def met(e: DataFrame, t: DataFrame, crowd: int | None = None) -> DataFrame:
    """``(erep, trep)`` of :func:`between`, slot by slot; a pair may come from several slots."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = not left.num_rows or not right.num_rows
        p = np.empty((0, 2), np.int64) if none else between(opened(left), opened(right), crowd)
        return pa.Table.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["erep", "trep"])

    return e.groupBy("slot").cogroup(t.groupBy("slot")).applyInArrow(run, "erep bigint, trep bigint")


def common(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in common and words of either side, pair by pair, of packed word sets."""
    (fa, _, na), (fb, _, nb) = unpacked(a), unpacked(b)
    pair = np.arange(len(na), dtype=np.uint64) << np.uint64(32)
    every = np.concatenate([np.repeat(pair, na) | fa, np.repeat(pair, nb) | fb])
    every.sort()
    twice = every[1:][every[1:] == every[:-1]]
    return np.bincount((twice >> np.uint64(32)).astype(np.int64), minlength=len(na)), na, nb


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, row: str = "row", other: str = "other") -> DataFrame:
    """The ``pairs(row, other)`` whose word sets in ``left`` and ``right`` (row, words) share at least ``NUM/DEN`` of all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, na, nb = common(b.column("_wa"), b.column("_wb"))
            keep = pa.array(DEN * same >= NUM * (na + nb - same))
            yield pa.RecordBatch.from_arrays([b.column(c).filter(keep) for c in (row, other)], [row, other])

    a = left.select(F.col("row").alias(row), F.col("words").alias("_wa"))
    b = right.select(F.col("row").alias(other), F.col("words").alias("_wb"))
    return pairs.select(row, other).join(a, row).join(b, other).select(row, other, "_wa", "_wb").mapInArrow(run, f"{row} bigint, {other} bigint")
