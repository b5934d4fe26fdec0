"""Sentence boundaries across languages and scripts.

A semi-Markov dynamic programme chooses, for each run of text between blank
lines, the whole spans that score best together: how a span opens, how it
closes, whether quotations and brackets are balanced in it, and its length. How
likely a word opens a sentence, and how likely a dotted word goes on, is counted
over all documents; short lists of well-known abbreviations help where the
corpus is silent. Spans may be of any length: the search looks back until no
earlier start can win.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import written


# Abbreviations that call for what follows (names, numbers, places).
CALLING = frozenset(
    "г ул д им см рис табл проф др стр гл т к м тел акад доц ст пр просп пер пл кв корп обл р-н пос св ср напр "
    "dr mr mrs ms prof st fig vol no rev gen sen rep capt lt col mt ave vs cf approx incl e.g i.e dept ed eds pp sec ch "
    "hr fr abb nr str med dipl ing vgl bzw ca max min z b d h u a o ä sog ggf inkl "
    "m mme mlle pr mgr art p ex chap env av bd "
    "sr sra srta dra ud uds pág págs n.º núm cap ej aprox avda "
    "د ص م أ ج ط ق "
    "डॉ श्री पं प्रो कु "
    "น ดร นพ พญ ศ รศ ผศ".split()
)
# Abbreviations that may as well end a sentence (units, "etc.", years).
ENDING = frozenset("г гг руб коп мин сек ч мг мл кг см ед мес нед шт тыс млн млрд др пр д н э т.д т.п т.е etc usw u.s a.m p.m inc ltd co jr sr uhr mg ml kg km cm mm h min sec".split())
# Month names after a dotted day ("26. Oktober").
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
# Polite particles that end a Thai unit.
THAI_END = "ครับ|ค่ะ|คะ"
# Verbs of speech right after a quotation in scripts without blanks.
SAID = re.compile(r"[^，。！？：“”、\s]{0,12}[问問说說道答喊叫][^：“”，]{0,3}[。！？]")
QUOTED_ON = re.compile(r"(?:と|って|という|とか)")

STOPS = ".!?…。！？｡؟।॥۔"
WIDE = "。！？｡"
CLOSE = "”\"'’»)\\]）」』】》〉›"
QUOTES = {"«": "»", "„": "“", "“": "”", "‘": "’", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "《": "》", "【": "】", "‹": "›"}
_MATES = {v: k for k, v in QUOTES.items()} | {"“": "„"}
_MARK = re.compile("[" + re.escape("".join(QUOTES) + "".join(QUOTES.values()) + '"') + "]")
_BLANK = re.compile(r"(?:\r\n|[\n\r\u0085  ])[^\S\n]*(?:(?:\r\n|[\n\r\u0085 ])[^\S\n]*)+| ")
#: Where a span may end: stops with their closing marks, or a Thai particle before a blank.
_CAND = re.compile(rf"[{STOPS}]+(?:[{CLOSE}]|“(?=[\s,;:.!?)—–-]|$)|[\s\u00a0\u202f]»)*|(?:{THAI_END})[{CLOSE}]*(?=\s|$)")
_L = "(?:[^\\W_]|[\u0300-\u036F\u064B-\u065F\u0900-\u0903\u093A-\u094F\u0951-\u0963\u0E31\u0E34-\u0E3A\u0E47-\u0E4E\u00AD])"
_WORD = re.compile(f"{_L}+(?:[’'\\-]{_L}+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_LISTED = re.compile(r"\(?\d{1,3}[.)]\s+[«“„\"(¿¡]*(?=[^\W\d_])")
_NUMBER = re.compile(r"\(?\d{1,3}[.)]$")
_SHIFT = {ord(c): None for c in "­​‌‍⁠﻿"}
_AFTER_NUMBER = re.compile(r"\d[\s\xa0]*$")
#: A word after a word or comma and one blank; a dotted word, what follows it, and its first letter.
_INSIDE = re.compile(rf"(?<=[\w,])[ \n]({_L}+(?:[’'\-]{_L}+)*)")
_AFTER_DOT = re.compile(rf"({_L}+)\.([,\s]{{1,2}})(?=([^\W_]))")
#: First letters after stops.
_FIRSTS = re.compile(r"[.!?…][»”\")]*\s+[«“„\"(—–-]*\s*([^\W\d_])")
#: Score of a span's length, by its characters.
_LENGTH = [-9.0] + [-0.15 * abs(math.log(n / 60.0)) - (1.0 if n < 3 else 0.0) for n in range(1, 2048)]
#: A mark that is open where a span starts or ends costs so much there.
OPEN = 3.5
#: Possible ends of this score or less are no ends. Cutting a span in two can gain no more than the length score takes
#: off the whole, 0.15 * log(size / 60), which is less than this for any text of under 10^17 characters.
NEVER = -5.5
#: Words seen in less than this share of their kind's places say nothing, at any size of the corpus. The table goes to every task;
#: by Zipf's law it holds far fewer words than the inverse, which is checked against ``MOST``.
RARE, MOST = 1e-7, 5_000_000


def _size_score(size: int) -> float:
    return _LENGTH[size] if size < len(_LENGTH) else -0.15 * math.log(size / 60.0)


def _key(text: str, at: int) -> str:
    """The word at ``at`` as the tables know it: capitalised words as they are, others
    in small letters after a tilde; two characters where words aren't set apart."""
    if at < len(text) and _CJK.match(text, at):
        return "~" + text[at : at + 2]
    m = _WORD.match(text, at)
    if not m:
        return ""
    w = m.group().translate(_SHIFT)
    return w if w[0].isupper() else "~" + w


def _first(text: str, at: int, end: int) -> int:
    """The first letter or digit of a span from ``at``, past quotes, brackets and dashes."""
    while at < end and not text[at].isalnum():
        at += 1
    return at


def blocks(text: str) -> list[tuple[int, int]]:
    """Runs between blank lines, without blanks at their ends."""
    out, at = [], 0
    for m in [*_BLANK.finditer(text), None]:
        a, b = at, m.start() if m else len(text)
        while a < b and _void(text[a]):
            a += 1
        while b > a and _void(text[b - 1]):
            b -= 1
        if a < b:
            out.append((a, b))
        at = m.end() if m else 0
    return out


def _void(c: str) -> bool:
    return c.isspace() or c in "​﻿⁠­‌‍"


class Seen:
    """What texts show beyond doubt: words that open a block (``o``) or stand inside a
    clause (``m``), and dotted words followed by a small letter or comma (``a``) or by
    anything else (``e``)."""

    def __init__(self) -> None:
        self.opens: Counter = Counter()
        self.inside: Counter = Counter()
        self.dotted: Counter = Counter()

    def __len__(self) -> int:
        return len(self.opens) + len(self.inside) + len(self.dotted)

    def add(self, text: str) -> None:
        for a, b in blocks(text):
            w = _key(text, _first(text, a, b))
            if w and not w.lstrip("~")[:1].isdigit():
                self.opens[w] += 1
        self.inside.update(_INSIDE.findall(text))
        if text != text.lower():
            self.dotted.update(_AFTER_DOT.findall(text))

    def rows(self) -> Counter:
        """``(kind, word) -> n`` with words as :func:`_key` has them; capitalised ones count in small letters too."""
        out: Counter = Counter()
        for w, n in self.opens.items():
            out["o", w] += n
            if w[0] != "~":
                out["o", "~" + w.lower()] += n
        for w, n in self.inside.items():
            if not _CJK.match(w):
                w = w.translate(_SHIFT)
                if w[:1].isupper():
                    out["m", w] += n
                out["m", "~" + w.lower()] += n
        for (w, between, c), n in self.dotted.items():
            out["a" if c.islower() or "," in between else "e", w.lower()] += n
        return out


def statistics(docs: DataFrame, text: str = "text", rare: float = RARE, least: int = 2) -> DataFrame:
    """``(word, kind, score)``: log odds that a word opens a sentence (kind ``o``)
    or that a dotted word goes on (kind ``a``), counted over all documents. Words
    of a share under ``rare`` of their kind, or under ``least`` places, score 0: so a
    corpus and its hundredfold give the same table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()

        def out() -> pa.RecordBatch:
            rows = list(seen.rows().items())
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["kind", "word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.add(t)
            if len(seen) > 300_000:
                yield out()
                seen = Seen()
        yield out()

    n = docs.select(F.col(text).alias("t")).mapInArrow(run, "kind string, word string, n bigint")
    flip = F.when(F.col("kind").isin("o", "m"), "o").otherwise("a")
    yes = F.sum(F.when(F.col("kind").isin("o", "a"), F.col("n")).otherwise(0))
    t = n.groupBy("word", flip.alias("kind")).agg(yes.alias("yes"), F.sum("n").alias("all")).where(F.col("all") >= least)
    t = written(t, "openings")  # read twice
    total = {r["kind"]: r["n"] for r in t.groupBy("kind").agg(F.sum("all").alias("n")).collect()}  # two rows
    floor = F.when(F.col("kind") == "o", rare * total.get("o", 0)).otherwise(rare * total.get("a", 0))
    return t.where(F.col("all") >= floor).select("word", "kind", F.log((F.col("yes") + 0.5) / (F.col("all") - F.col("yes") + 0.5)).alias("score"))


def _depths(text: str, a: int, b: int) -> tuple[list[int], list[int]]:
    """Starts and ends of matched quotations and brackets; marks without a mate don't count."""
    stack: list[tuple[str, int]] = []
    pairs = []
    for m in _MARK.finditer(text, a, b):
        c, p = m.group(), m.start()
        if c == '"':
            if stack and stack[-1][0] == '"':
                pairs.append((stack.pop()[1], p))
            else:
                stack.append((c, p))
            continue
        if c in "’‘":
            continue
        if c in _MATES:
            k = next((k for k in range(len(stack) - 1, max(-1, len(stack) - 4), -1) if stack[k][0] == _MATES[c] or (c == "“" and stack[k][0] == "„")), None)
            if k is not None:
                pairs.append((stack[k][1], p))
                del stack[k:]
                continue
        if c in QUOTES:
            stack.append((c, p))
    pairs.sort()
    return [p for p, _ in pairs], [q for _, q in pairs]


class Cutter:
    """Cuts texts; ``opens`` and ``goes_on`` map words to log odds (see :func:`statistics`)."""

    def __init__(self, opens: dict[str, float] | None = None, goes_on: dict[str, float] | None = None):
        self.opens, self.goes_on = opens or {}, goes_on or {}

    def cut(self, text: str | None) -> list[tuple[int, int]]:
        """Sentences as ``(start, end)`` in code points, in order, without overlap.
        NULL, empty and blank texts have none; text without any stop is one sentence a block."""
        if not text:
            return []
        first = _FIRSTS.findall(text)
        small = sum(map(str.islower, first))
        large = sum(map(str.isupper, first))
        # where few stops are followed by capitals, capitals tell nothing
        cased = large > 0.3 * (large + small) if large + small > 3 else sum(map(str.isupper, text)) * 100 > len(text)
        out: list[tuple[int, int]] = []
        for a, b in blocks(text):
            out += self._block(text, a, b, cased)
        return out

    def _ends(self, text: str, a: int, b: int, cased: bool) -> list[tuple[int, int, float, float]]:
        """Possible ends ``(end, next start, closing, opening)`` inside a block: how well a span
        closes here by its last word and marks, and how well the next one opens with its first word."""
        out = []
        for m in _CAND.finditer(text, a, b):
            e = m.end()
            if e >= b:
                break
            mark = m.group()
            stop = mark[0]
            nxt = text[e]
            n = e
            while n < b and _void(text[n]):
                n += 1
            gap = n > e
            if stop not in STOPS:
                out.append((e, n, 4.0, 0.0))  # Thai particle
                continue
            prev = text[m.start() - 1] if m.start() > a else " "
            wide = any(c in WIDE for c in mark) or (stop in "…！？!?" and bool(_CJK.match(prev)))
            f = _first(text, n, min(b, n + 12))
            lead = text[n:f]
            c = text[f] if f < b else ""
            if not gap and not wide:
                # no blank: only "word.Word", as where a blank was lost
                if not (c and f == n and prev.isalpha() and len(mark) == 1 and prev.islower() and (c.isupper() or not cased)):
                    continue
                if not c.isupper() and self.opens.get(_key(text, f), -9.0) < 0.5:
                    continue
            if "," in lead or nxt in ",;:،、，":
                continue
            digit = c.isdigit()
            listed = _LISTED.match(text, n, b) if digit else None
            at = listed.end() if listed else f
            word = _key(text, at) if c and at < b else ""
            o = max(-3.0, min(3.0, self.opens.get(word, 0.0))) if word and not (digit and not listed) else 0.0
            if lead[:1] and lead[0] in "«„“「『\"(（¿¡":
                o = max(o, 1.0)  # an opening mark opens
            closers = mark.lstrip(STOPS)
            quoted = any(x in "”\"»」』“’›" for x in closers)
            if wide:
                s, opening = 3.0, 0.0
                if "…" in mark and not any(x in WIDE for x in mark):
                    s, opening = -2.5, o
                elif quoted:
                    if QUOTED_ON.match(text, n):
                        s = -6.0
                    elif not gap and self._speech_first(text, a, m.start(), closers) and SAID.match(text, n):
                        s = -6.0
                out.append((e, n, s, opening))
                continue
            if lead[:1] in ("—", "–", "-") and (c.islower() or quoted or (not cased and o < 1.5)):
                out.append((e, n, 0.0, -6.0))
                continue
            weight, dotted, opening = 0.9, 0.0, 0.0
            if stop == "." and not mark.startswith("..") and not closers:
                dotted = self._dotted(text, a, m.start(), o, digit and not listed, cased, word)
            if stop in "!?؟":
                s = 3.5
                weight = 0.9 if quoted else 0.4
            elif stop in "।॥۔":
                s = 3.5
            elif mark[0] == "…" or mark.startswith(".."):
                s = -1.0
            else:
                s = 1.2
                if dotted == 0.0 and not c.isupper() and not digit and not closers:
                    s, weight = 2.4, 0.35  # an ordinary word before the stop: small letters say little here
            if quoted and stop not in "…":
                s += 0.3
            if digit:
                opening = 1.0 + 0.3 * max(o, 0.0) if listed else 0.0
            elif c.islower():
                if cased:
                    opening = -6.0
                else:
                    opening = weight * o - (0.8 if word not in self.opens else 0.0)
            elif c.isupper():
                opening = 1.5 + 0.6 * o
            elif c:  # scripts without case
                opening = weight * o
                if quoted and o < 0.5:
                    opening -= 6.0
            out.append((e, n, s + dotted, opening))
        return out

    @staticmethod
    def _speech_first(text: str, a: int, at: int, closers: str) -> bool:
        """Whether the quotation that closes here opened its unit (else its speaker came before it)."""
        q = max(text.rfind(x, a, at) for x in "“「『«\"")
        return q < 0 or q == a or text[q - 1] not in "：:，,"

    def _dotted(self, text: str, a: int, at: int, o: float, number: bool, cased: bool, word: str) -> float:
        """What the word before a full stop adds: an initial or abbreviation mostly goes on."""
        i = at
        while i > a and (text[i - 1].isalnum() or text[i - 1] in ".’'-º­́" or (text[i - 1] >= "ऀ" and not text[i - 1].isspace() and text[i - 1].isprintable() and text[i - 1] not in "।“”«»")):
            i -= 1
        w = text[i:at].lower().translate(_SHIFT)
        if not w:
            return 0.0
        tail = re.split(r"[.\-]", w)[-1] or w
        if w.isdigit():
            if len(w) <= 2 and word.lower().lstrip("~") in MONTHS:
                return -8.0
            j = i
            while j > a and (text[j - 1].isspace() or text[j - 1] in CLOSE):
                j -= 1
            # a number that opens its unit: a list number
            return -9.0 if len(w) <= 3 and (j == a or text[j - 1] in STOPS) and j < i or i == a else 0.0
        known = w in CALLING or tail in CALLING
        ends = w in ENDING or tail in ENDING
        single = len(tail) == 1 and tail.isalpha()
        if ends and not number and _AFTER_NUMBER.search(text, max(a, i - 8), i):
            return -0.5 if cased or o > 0 else -1.0  # "7 p.m.", "2019 г.": a measure, which may end
        learned = self.goes_on.get(tail)
        score = 0.0
        if known and not (ends and w not in CALLING):
            score = -5.0
        elif known or ends:
            score = -1.6
        if single and not ends:
            score = min(score, -4.5)
        if learned is not None and not known and not ends and learned > 1.0:
            score = min(score, -1.5 * learned)
        if score < 0:
            if number:
                score -= 2.5
            if o < -1.0:
                score -= 1.5
        return score

    def _block(self, text: str, a: int, b: int, cased: bool) -> list[tuple[int, int]]:
        cand = [c for c in self._ends(text, a, b, cased) if c[2] + c[3] > NEVER]
        if not cand:
            return [(a, b)]
        ends = [c[0] for c in cand] + [b]
        starts = [a] + [c[1] for c in cand]
        closing = [c[2] for c in cand] + [0.0]
        opening = [0.0] + [c[3] for c in cand]
        n = len(ends)
        cut = [0] * (n + 1)  # matched marks open across the cut before span k
        po, pc = _depths(text, a, b)
        if po:
            pc.sort()
            for k in range(n - 1):
                cut[k + 1] = bisect_left(po, ends[k]) - bisect_left(pc, ends[k])
        best = [0.0] * (n + 1)  # of the text before span k
        head = [0.0] * n  # that, and how span k opens
        back = [0] * (n + 1)
        live: list[int] = []  # starts that may yet win, in order
        for k in range(n):
            head[k] = best[k] + opening[k] - OPEN * cut[k]
            live.append(k)
            e, top, arg, kept, mark = ends[k], -1e18, -1, [], -1e18
            for j in live:  # the span from start j to end k
                v = best[j] + self._span(text, starts[j], e, opening[j], closing[k], cut[j], cut[k + 1])
                if v >= top:
                    top, arg = v, j
                # the lead that the length score gives to the later of two starts shrinks as both spans grow: past
                # 60 characters, a start that an earlier one has overtaken stays behind it
                if e - starts[j] < 60 or v > mark:
                    kept.append(j)
                    if e - starts[j] >= 60:
                        mark = v
            best[k + 1], back[k + 1] = top, arg
            # and an earlier start that isn't ahead without the length score never will be
            live, mark = [], -1e18
            for j in reversed(kept):
                if head[j] > mark:
                    live.append(j)
                if e - starts[j] >= 60:
                    mark = max(mark, head[j])
            live.reverse()
        cuts, k = [], n
        while k > 0:
            j = back[k]
            cuts.append((starts[j], ends[k - 1]))
            k = j
        return cuts[::-1]

    @staticmethod
    def _span(text: str, s: int, e: int, opening: float, closing: float, before: int, after: int) -> float:
        """What a whole span scores: how it opens and how it closes, what quotations and
        brackets it leaves open on either side, and its length. A list number or
        a bare mark is no sentence, and very short or very long spans are a little less likely."""
        size = e - s
        if size <= 5 and _NUMBER.match(text[s:e]):
            return opening + closing - OPEN * (before + after) - 9.0
        return opening + closing - OPEN * (before + after) + _size_score(size)


def _held(stats: DataFrame) -> Cutter:
    rows = stats.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} words to send to every task: raise the share under which they say nothing")
    return Cutter({r["word"]: r["score"] for r in rows if r["kind"] == "o"}, {r["word"]: r["score"] for r in rows if r["kind"] == "a"})


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", stats: DataFrame | None = None) -> DataFrame:
    """``(key, start_pos int, end_pos int)``: every sentence of every document, in code points, end exclusive."""
    spark = docs.sparkSession
    stats = stats if stats is not None else statistics(docs, text)
    cutter = spark.sparkContext.broadcast(_held(stats))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter.value.cut
        for b in batches:
            spans = [cut(t) for t in b.column(1).to_pylist()]
            count = np.array([len(s) for s in spans], np.int64)
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(spans)), count)))
            flat = np.array([x for s in spans for x in s], np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([ids, pa.array(flat[:, 0]), pa.array(flat[:, 1])], [key, "start_pos", "end_pos"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, start_pos int, end_pos int")
