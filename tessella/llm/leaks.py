"""Evaluation texts leaking into training text.

Word pairs of the test items, frequent or not, seed pairs of a document and an
item's sentence; as many seeds on near diagonals as any allowed copy has open a
pair, and a Smith-Waterman alignment over words decides how much of the sentence
the document holds, be it edited.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.sentences import Cutter
from tessella.session import written

#: Words of a seed, words in a row that make a leak, items that make a sentence stock text.
GRAM, LEAST, STOCK = 2, 10, 10
#: Share of a run's words that may be edited.
EDITED = 0.25
#: Words to either side of a diagonal that an alignment may reach.
BAND = 7
#: Items held by the driver and every task at a time; more are taken in blocks.
ITEMS = 20_000

# Letters that look alike, each mapped to one of its kind.
ALIKE = str.maketrans("abcehkmoptxyijsαβεικορτυχνё", "авсенкмортхуіјѕавеікортухѵе")
_GONE = re.compile("[­͏​-‏‪-‮⁠-⁯︀-️﻿]")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑]\s*[\r\n]\s*(?=[^\W\d_])")
_TOKEN = re.compile(r"[^\W_]+(?:[̀-ͯऀ-ःऺ-ॏัิ-ฺ็-๎ً-ٟ]+[^\W_]*)*")


def plain(text: str) -> str:
    """Without invisible characters and line-end hyphens, compatibility forms resolved."""
    return unicodedata.normalize("NFKC", _BROKEN.sub("", _GONE.sub("", text)))


def words(text: str) -> list[str]:
    return _TOKEN.findall(plain(text).lower().translate(ALIKE))


def item_words(sentence: str) -> tuple[list[str], list[bool]]:
    """Words of an item's sentence and which of them are numbers or names (capitalised
    past the first word), that no edit may turn into another."""
    raw = _TOKEN.findall(plain(sentence))
    key = [w[0].isdigit() or (k > 0 and w[0].isupper()) for k, w in enumerate(raw)]
    return [w.lower().translate(ALIKE) for w in raw], key


def _codes(tokens: list[str], held: dict[str, int]) -> list[int]:
    out = []
    for t in tokens:
        c = held.get(t)
        if c is None:
            c = held[t] = zlib.crc32(t.encode())
        out.append(c)
    return out


def grams(codes: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` words from each place on."""
    n = len(codes) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n].astype(np.uint64)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def close(a: str, b: str, most: int) -> bool:
    """Within ``most`` edits (a swap of neighbours is one)."""
    if abs(len(a) - len(b)) > most:
        return False
    if len(a) == len(b):
        d = [k for k in range(len(a)) if a[k] != b[k]]
        if len(d) <= most or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]):
            return True
        if most == 1:
            return False
    p = 0
    while p < len(a) and p < len(b) and a[p] == b[p]:
        p += 1
    a, b = a[p:], b[p:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return max(len(a), len(b)) <= most
    if max(len(a), len(b)) > most + 3:
        return False
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, prev2[j - 2] + 1)
            row.append(v)
        prev2, prev = prev, row
    return prev[-1] <= most


def alike(a: str, b: str, key: bool) -> int:
    """2: the same word, 1: misspelt, 0: another word."""
    if a == b:
        return 2
    if a[0].isdigit() or b[0].isdigit():
        return 0
    n = min(len(a), len(b))
    return int(close(a, b, 1 if key or n < 7 else 2)) if n >= 3 else 0


def held_words(item: list[str], key: list[bool], doc: list[str], shift: int, band: int = BAND) -> int:
    """Longest run of ``item``'s words that ``doc`` holds around the diagonal ``shift``.

    Smith-Waterman over words: same 2, misspelt 1, lost or added -1.4. Words broken
    in two or run together count as misspelt. A word is never exchanged for another
    (particles of up to three letters aside), which is what tells a sentence from one
    of the same pattern. The run begins and ends with words that are held, and of
    its words about one in five may be edited.
    """
    n = len(item)
    lo0, hi0 = max(0, shift - band), min(len(doc), shift + n + band)
    if hi0 <= lo0:
        return 0
    part = doc[lo0:hi0]
    m = len(part)
    off = shift - lo0
    gap = -1.4
    prev = [0.0] * (m + 1)
    table, steps = [prev], []
    best, at = 0.0, (0, 0)
    for i in range(1, n + 1):
        row = [0.0] * (m + 1)
        step = [0] * (m + 1)
        w, k = item[i - 1], key[i - 1]
        two = item[i - 2] + w if i > 1 else ""
        back = table[-2] if i > 1 else prev
        for j in range(max(1, i + off - band), min(m, i + off + band) + 1):
            v = part[j - 1]
            e = 2 if w == v else alike(w, v, k)
            s, t = 0.0, 0
            if e:
                s, t = prev[j - 1] + e, 2 if e == 2 else 1
            elif not k and len(w) <= 3 and len(v) <= 3:
                x = prev[j - 1] + gap
                if x > s:
                    s, t = x, 3
            x = prev[j] + gap
            if x > s:
                s, t = x, 4
            x = row[j - 1] + gap
            if x > s:
                s, t = x, 5
            if j > 1 and len(w) > len(v) and w.endswith(v) and part[j - 2] + v == w and prev[j - 2] + 1.5 > s:
                s, t = prev[j - 2] + 1.5, 6
            if i > 1 and len(v) > len(w) and v.endswith(w) and two == v and back[j - 1] + 1.5 > s:
                s, t = back[j - 1] + 1.5, 7
            row[j], step[j] = s, t
            if s > best:
                best, at = s, (i, j)
        table.append(row)
        steps.append(step)
        prev = row
    # back to the start; ops: (kind, item word or -1)
    ops: list[tuple[int, int]] = []
    i, j = at
    while i > 0 and j > 0 and table[i][j] > 0:
        t = steps[i - 1][j]
        if t == 0:
            break
        if t in (1, 2, 3):
            ops.append((t, i - 1))
            i, j = i - 1, j - 1
        elif t == 4:
            ops.append((4, i - 1))
            i -= 1
        elif t == 5:
            ops.append((5, -1))
            j -= 1
        elif t == 6:
            ops.append((1, i - 1))
            i, j = i - 1, j - 2
        else:
            ops += [(1, i - 1), (2, i - 2)]
            i, j = i - 2, j - 1
    ops.reverse()
    return _longest(ops, key)


def _longest(ops: list[tuple[int, int]], key: list[bool]) -> int:
    """Item words of the longest allowed run in an alignment: cut where a word was
    lost beside something added (that is, exchanged), then as long as edits stay
    near one in five and no more numbers and names are lost than held. ``LEAST`` words
    of it must be there, misspelt or not."""
    cuts: list[list[tuple[int, int]]] = [[]]
    for p, (t, i) in enumerate(ops):
        if t in (4, 5) and p and ops[p - 1][0] == 9 - t:
            cuts.append([])
        cuts[-1].append((t, i))
    top = 0
    for run in cuts:
        held = [p for p, (t, _) in enumerate(run) if t in (1, 2)]
        bad, have, keys = [0], [0], [0]
        for t, i in run:
            bad.append(bad[-1] + (t != 2))
            have.append(have[-1] + (t in (1, 2)))
            keys.append(keys[-1] + (0 if i < 0 or not key[i] else 1 if t in (1, 2) else -1))
        for p in held:
            for q in reversed(held):
                size = run[q][1] - run[p][1] + 1
                if q <= p or size <= top:
                    break
                if bad[q + 1] - bad[p] <= EDITED * size + 0.5 and keys[q + 1] >= keys[p] and have[q + 1] - have[p] >= min(size, LEAST):
                    top = size
                    break
    return top


def may_run(held: list[bool], least: int) -> bool:
    """Whether ``least`` or more words in a row may be held with no more edits than :func:`_longest` allows: every word that
    isn't ``held`` (as it is or run together with a neighbour, wherever in reach) is an edit at least, so what fails here fails there."""
    low, total, sums = math.inf, 0.0, [0.0]
    for k, h in enumerate(held, 1):
        total += EDITED - (not h)
        sums.append(total)
        if k >= least:
            low = min(low, sums[k - least])
            if total - low >= -0.5 - 1e-9:
                return True
    return False


class Items:
    """The sentences of test items, stock text aside: words, keys, samples, seeds."""

    def __init__(self, rows: list[tuple[str, str]], least: int = LEAST, stock: int = STOCK):
        cut = Cutter().cut
        where: dict[tuple, set[str]] = defaultdict(set)
        first: dict[tuple, tuple[list[str], list[bool]]] = {}
        for sample, text in rows:
            for a, b in cut(text):
                w, k = item_words(text[a:b])
                if w:
                    where[tuple(w)].add(sample)
                    first.setdefault(tuple(w), (w, k))
        self.sentences = [(w, k, sorted(where[t])) for t, (w, k) in sorted(first.items()) if len(w) >= least and len(where[t]) < stock]
        held: dict[str, int] = {}
        self.codes: list[tuple[list[int], list[int]]] = []  # of the words, and of each two run together
        seeds = set()
        for s, (w, _, _) in enumerate(self.sentences):
            one, two = _codes(w, held), _codes([x + y for x, y in zip(w, w[1:], strict=False)], held)
            self.codes.append((one, two))
            for p in range(len(w)):
                for c, q in [(one[p], p + 1)] + ([(two[p], p + 2)] if p < len(two) else []):
                    for e in one[q : q + 1] + two[q : q + 1]:
                        seeds.add((int(grams(np.array([c, e], np.int64))[0]), s, p))
        table = np.array(sorted(seeds), np.int64).reshape(-1, 3)
        self.grams, self.start = np.unique(table[:, 0], return_index=True)
        self.start = np.r_[self.start, len(table)]
        self.sent, self.place = table[:, 1], table[:, 2]

    def opened(self, codes: list[int], least: int) -> list[tuple[int, int]]:
        """``(sentence, diagonal)`` at which a document of these words may hold a run of ``least`` words.

        A run of n words has e <= n * ``EDITED`` + 0.5 edits, which leave n - e words in at most e + 1 pieces
        and so n - 2e - 1 pairs of neighbours (words run together count as one word, which is why they seed too),
        and n - e of its words stand in the document as they are or run together.
        """
        g = grams(np.array(codes, np.int64))
        at = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
        pos = np.flatnonzero(self.grams[at] == g)
        if not len(pos):
            return []
        first = self.start[at[pos]]
        size = self.start[at[pos] + 1] - first
        seed = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
        pos = np.repeat(pos, size)
        sent, d = self.sent[seed], pos - self.place[seed]
        # diagonals in two overlapping rows of bins of 16: seeds up to 8 apart share one
        base = np.r_[sent, sent] << 32
        key = base + (1 << 31) + np.r_[(d // 16) * 2, ((d + 8) // 16) * 2 + 1]
        order = np.lexsort((np.r_[pos, pos], key))
        k, q = key[order], np.r_[pos, pos][order]
        new = np.r_[True, k[1:] != k[:-1]]
        fresh = new | np.r_[True, q[1:] != q[:-1]]
        count = np.add.reduceat(fresh.astype(np.int64), np.flatnonzero(new))
        most = int(EDITED * least + 0.5)
        ok = np.repeat(count >= max(1, least - 2 * most - 1), np.diff(np.r_[np.flatnonzero(new), len(k)]))
        pick = order[ok] % len(d)
        out = []
        for x in np.unique((sent[pick] << 32) + (1 << 31) + d[pick] // 4).tolist():
            s, shift = x >> 32, ((x & 0xFFFFFFFF) - (1 << 31)) * 4 + 2
            one, two = self.codes[s]
            there = set(codes[max(0, shift - BAND) : max(0, shift + len(one) + BAND)])
            joined = [c in there for c in two]
            held = [c in there for c in one]
            if sum(held) + 2 * sum(joined) >= least - most and may_run([h or j or k for h, j, k in zip(held, [*joined, False], [False, *joined], strict=True)], least):
                out.append((s, shift))
        return out


def _block(docs: DataFrame, rows: list[tuple[str, str]], key: str, text: str, sample: str, least: int, stock: int) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    items = Items(rows, least, stock)
    if not items.sentences:
        return spark.createDataFrame([], f"{key} {kind}, {sample} string, words int")
    shared = spark.sparkContext.broadcast(items)  # bounded by ITEMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = shared.value, {}
        for b in batches:
            if len(held) > 2_000_000:
                held.clear()
            at, names, size = [], [], []
            for r, t in enumerate(b.column(1).to_pylist()):
                doc = words(t) if t else []
                best: dict[int, int] = {}
                for s, shift in own.opened(_codes(doc, held), least):
                    best[s] = max(best.get(s, 0), held_words(*own.sentences[s][:2], doc, shift))
                for s, n in best.items():
                    if n >= least:
                        samples = own.sentences[s][2]
                        at += [r] * len(samples)
                        names += samples
                        size += [n] * len(samples)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(size, pa.int32())], [key, sample, "words"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, {sample} string, words int").groupBy(key, sample).agg(F.max("words").alias("words"))


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", sample: str = "sample_id", answer: str = "expected_answer", least: int = LEAST, stock: int = STOCK) -> DataFrame:
    """``(key, sample, words)``: documents holding ``least`` or more words in a row of one
    sentence of an item's answer, and how many. NULL and blank texts and answers leak nothing.

    A sentence that ``stock`` items share is stock text. That is counted over
    all items, block by block of ``ITEMS`` only in how they are searched.
    """
    rows = items.where(F.col(answer).isNotNull() & (F.trim(answer) != "")).select(F.col(sample).cast("string"), answer)
    n = rows.count()
    if n <= ITEMS:
        return _block(docs, sorted(tuple(r) for r in rows.collect()), key, text, sample, least, stock).select(key, sample, "words")
    # stock text must be known over all items: sentences are counted first
    cut = F.udf(lambda t: [" ".join(item_words(t[a:b])[0]) for a, b in Cutter().cut(t)], "array<string>")
    common = rows.select(sample, F.explode(cut(answer)).alias("s")).distinct().groupBy("s").count().where(F.col("count") >= stock).select("s")
    raw = F.udf(lambda t: [(" ".join(item_words(t[a:b])[0]), t[a:b]) for a, b in Cutter().cut(t)], "array<struct<s:string,raw:string>>")
    kept = written(rows.select(sample, F.explode(raw(answer)).alias("x")).select(sample, "x.s", "x.raw").join(common, "s", "left_anti"), "items")
    out, blocks = None, math.ceil(n / ITEMS)
    for k in range(blocks):
        part = kept.where(F.pmod(F.xxhash64("s"), F.lit(blocks)) == k).select(sample, "raw").collect()
        found = _block(docs, sorted(tuple(r) for r in part), key, text, sample, least, 1 << 60)
        out = found if out is None else out.union(found)
    return out.groupBy(key, sample).agg(F.max("words").alias("words"))
