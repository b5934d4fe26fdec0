"""Same or near-same records across splits.

Winnowing over word grams: rolling hashes, the minimum of each window is kept as
a fingerprint, fingerprints are joined across the splits, the common grams of a
pair are chained in order and the chain is extended by alignment. A fingerprint
so common that its meetings outgrow its records (a set phrase, a greeting on a third
of all rows) is passed over: what it alone would join meets in bands of minwise
hashes, which know neither counts nor places, and find pairs of another order too.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.records import tokenized, unpacked
from tessella.llm.slots import bands_of, met, slot_ids, slotted, verified
from tessella.session import tidy, written

SHORT, WINDOW = 3, 3
#: Bands of minwise hashes and hashes a band: at a share of 0.6 of common words one pair in 7,000 shares no band, at 0.65 one in 290,000.
BANDS, ROWS = 64, 4
#: Bands that are joined at a time: their keys are moved and dropped before the next ones are.
AT_ONCE = 16
#: Meetings an entry that a fingerprint may cause: a limit to work, not to rows, see :func:`tessella.llm.slots.between`.
CROWD = 64
_B = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(flat: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of the ``k`` words from each place on (places near the end get junk; callers mask them)."""
    n = len(flat)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _B
        out[: max(0, n - j)] += flat[j:].astype(np.uint64) + np.uint64(1)
    return _mix(out)


def winnowed(window: int = WINDOW) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]:
    """Fingerprints of batches of ``(toks, nums)``, as ``(record, key)``.

    Of each ``window`` grams in a row the one of the smallest hash is kept; a record of
    one or two words is its own gram. The key holds the hash of the numbers, which must
    be the same in both records.
    """

    def keys(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        flat, starts, lens = unpacked(b.column("toks"))
        rec = np.repeat(np.arange(len(lens)), lens)
        left = np.repeat(starts + lens, lens) - np.arange(len(flat))
        h = rolling(flat, SHORT)
        tiny = lens[rec] < SHORT
        if tiny.any():
            first = starts[rec[tiny]]
            h[tiny] = _mix(flat[first].astype(np.uint64) * _B + flat[first + lens[rec[tiny]] - 1])
        valid = left >= np.minimum(lens[rec], SHORT)
        rank = np.where(valid, h >> np.uint64(1), np.uint64((1 << 64) - 1))
        best = np.zeros(len(h), bool)
        for shift in range(window):  # a place is kept if it is the least of some window that holds it
            least = np.ones(len(h), bool)
            for d in range(-shift, window - shift):
                if d:
                    j = np.arange(len(h)) + d
                    jj = np.clip(j, 0, max(0, len(h) - 1))
                    ok = (j >= 0) & (j < len(h)) & (rec[jj] == rec)
                    least &= ~ok | (rank <= rank[jj])
            best |= least
        keep = np.flatnonzero(best & valid)
        nums = b.column("nums").to_numpy().view(np.uint64)
        return rec[keep], _mix(h[keep] ^ (nums[rec[keep]] * np.uint64(0xC2B2AE3D27D4EB4F)))

    return keys


def _edges(a: list[int], b: list[int]) -> int:
    """Words in common order between two gaps: a longest common subsequence."""
    if not a or not b:
        return 0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            held = row[j]
            row[j] = before + 1 if x == y else max(row[j], row[j - 1])
            before = held
    return row[-1]


def aligned(a: list[int], b: list[int], k: int = SHORT) -> tuple[int, int]:
    """(seeds in the best chain, words aligned). Seeds are grams that stand once
    in either text; the chain is the longest run of them that keeps both orders;
    what lies between, before and after its seeds is aligned word by word."""
    places: dict[tuple, int] = {}
    for i in range(len(b) - k + 1):
        g = tuple(b[i : i + k])
        places[g] = -1 if g in places else i
    seen: dict[tuple, int] = {}
    for i in range(len(a) - k + 1):
        g = tuple(a[i : i + k])
        seen[g] = -1 if g in seen else i
    seeds = sorted((i, places[g]) for g, i in seen.items() if i >= 0 and places.get(g, -1) >= 0)
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(seeds):
        p = bisect_left(tails, j)
        back.append(ends[p - 1] if p else -1)
        tails[p : p + 1] = [j]
        ends[p : p + 1] = [n]
    chain, n = [], ends[-1] if ends else -1
    while n >= 0:
        chain.append(seeds[n])
        n = back[n]
    same, ia, ib = 0, 0, 0
    for i, j in reversed(chain):
        for d in range(k):
            if i + d >= ia and j + d >= ib:
                same += _edges(a[ia : i + d], b[ib : j + d]) + 1
                ia, ib = i + d + 1, j + d + 1
    return len(chain), same + _edges(a[ia:], b[ib:])


def _extended(pairs: DataFrame) -> DataFrame:
    """``pairs(erep, trep, te, tt)`` with the length of their chain and the words aligned."""

    def lists(col: pa.Array) -> list[list[int]]:
        flat, starts, lens = unpacked(col)
        return [flat[a : a + n].tolist() for a, n in zip(starts, lens, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [aligned(x, y) for x, y in zip(lists(b.column("te")), lists(b.column("tt")), strict=True)]
            cols = [b.column("erep"), b.column("trep"), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["erep", "trep", "chain", "words"])

    return pairs.select("erep", "trep", "te", "tt").mapInArrow(run, "erep bigint, trep bigint, chain int, words int")


class Overlap:
    """Overlaps of evaluation records with training records.

    ``train`` and ``evals`` need ``key`` (unique over both) and ``text``; other
    columns are ignored, but for ``extra`` ones of ``evals`` that reports use.
    Records without words (NULL, blank) overlap with nothing.
    """

    def __init__(self, train: DataFrame, evals: DataFrame, key: str = "row_no", text: str = "text", extra: tuple[str, ...] = ()):
        self.key, self.extra = key, extra
        pick = lambda df, keep, s: df.select(F.col(key).alias("row"), F.col(text).alias("_text"), F.lit(s).alias("side"), *keep)
        none = [F.lit(None).cast(evals.schema[c].dataType).alias(c) for c in extra]
        both = tokenized(pick(train, none, 0).unionByName(pick(evals, extra, 1)), "_text", ordered=True)
        self.members = written(both, "messages")
        # one text stands for its copies, the first row of them
        body = F.min_by(F.struct("words", "nums", "map", "size", "toks"), "row").alias("b")
        reps = self.members.where("size > 0").groupBy("side", "digest").agg(F.min("row").alias("row"), body)
        self.body = written(reps.select("side", "digest", "row", "b.*"), "bodies")

    def pairs(self) -> DataFrame:
        """``(erep, trep, chain, words)``: pairs of distinct records, each stood for by its first row; exact copies have one pair."""
        spark = self.body.sparkSession
        t, e = self.body.where("side = 0"), self.body.where("side = 1")
        slots = slot_ids(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
        found = e.select("digest", F.col("row").alias("erep")).join(t.select("digest", F.col("row").alias("trep")), "digest").select("erep", "trep")
        rounds = [(winnowed(), ("toks", "nums"), CROWD)]
        rounds += [(bands_of(min(AT_ONCE, BANDS - k), ROWS, k + 1), ("words", "nums"), None) for k in range(0, BANDS, AT_ONCE)]
        for keys, needs, crowd in rounds:
            found = found.union(written(met(slotted(e, keys, needs, slots), slotted(t, keys, needs, slots), crowd), "met"))
            tidy(spark)
        found = written(verified(found.distinct(), e, t, "erep", "trep"), "near")
        found = found.join(e.select(F.col("row").alias("erep"), F.col("toks").alias("te")), "erep").join(t.select(F.col("row").alias("trep"), F.col("toks").alias("tt")), "trep")
        return written(_extended(found), "pairs")

    def rows(self) -> DataFrame:
        """``(train, eval)`` keys of every overlapping pair of rows."""
        rep = self.body.select("side", "digest", F.col("row").alias("rep"))
        m = self.members.where("size > 0").select("row", "side", "digest").join(rep, ["side", "digest"])
        em = m.where("side = 1").select(F.col("row").alias("erow"), F.col("rep").alias("erep"))
        tm = m.where("side = 0").select(F.col("row").alias("trow"), F.col("rep").alias("trep"))
        return self.pairs().select("erep", "trep").join(em, "erep").join(tm, "trep").select(F.col("trow").alias(f"train_{self.key}"), F.col("erow").alias(f"eval_{self.key}"))

    def report(self, by: tuple[str, ...] = ("source",)) -> DataFrame:
        """Per group of evaluation rows: rows, rows that overlap, their number of
        links to different training records, and the mean share of their words that the best one covers."""
        best = self.pairs().groupBy("erep").agg(F.max("words").alias("words"), F.count(F.lit(1)).alias("links"))
        hit = self.body.where("side = 1").select("digest", F.col("row").alias("erep")).join(best, "erep").select("digest", F.col("words").alias("_words"), "links")
        size = (F.octet_length("toks") / 4).alias("_size")
        rows = self.members.where("side = 1").select("row", "digest", size, *by).join(hit, "digest", "left")
        cover = F.least(F.col("_words") / F.col("_size"), F.lit(1.0))
        return rows.groupBy(*by).agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("_words").alias("overlapping"),
            F.coalesce(F.sum("links"), F.lit(0)).alias("links"),
            F.round(F.coalesce(F.avg(cover), F.lit(0.0)), 6).alias("mean_coverage"),
        )
