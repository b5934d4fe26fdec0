"""Text expressions: normalisers, tokenisers, claims, slugs, parsers. Column -> Column."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Day words of a schedule and what each stands for.
DAYS = {
    "пн": ("пн",), "вт": ("вт",), "ср": ("ср",), "чт": ("чт",), "пт": ("пт",), "сб": ("сб",), "вс": ("вс",), "ежедневно": ("ежедневно",),
    "будни": ("пн", "пт"), "будням": ("пн", "пт"), "будних": ("пн", "пт"), "выходные": ("сб", "вс"), "выходных": ("сб", "вс"), "выходным": ("сб", "вс"),
}
# Street words dropped from addresses when dotted.
STREET_WORDS = ("г", "ул", "д", "пр", "пер", "корп", "стр")
#: Blanks of any width.
BLANK = r"[\s\p{Z}]"
_ANY_CASE = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("лет", "год", "час", "мес", "руб"))
# Claim families, in order; a string may be found by several.
CLAIMS = (
    ("phone", r"[+]?[0-9][0-9\s\p{Z}()-]{6,}"),
    ("email", r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+[.][\p{L}\p{N}_.-]+"),
    ("url", r"https?://[^\s\p{Z}]+"),
    ("name", rf"[А-ЯЁ][а-яё]+{BLANK}+[А-ЯЁ][а-яё]+{BLANK}+[А-ЯЁ][а-яё]+"),
    ("price", rf"(?:от{BLANK}+)?[0-9][0-9\s\p{{Z}}]*[0-9]{BLANK}*₽"),
    ("number", rf"[0-9]+{BLANK}*(?:{_ANY_CASE}|%)"),
)


def blank_to_null(c: Column) -> Column:
    """NULL and empty are one thing in string columns."""
    return F.nullif(F.trim(c), F.lit(""))


def dedup_norm(c: Column) -> Column:
    """Lower case, punctuation to blanks, runs of blanks to one; NULL is ''."""
    x = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{M}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def strip_lower(c: Column) -> Column:
    """Equality of the within-table audit: ends trimmed, case aside."""
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def just_lower(c: Column) -> Column:
    """Equality of the cross-split audit: case aside only."""
    return F.lower(F.coalesce(c, F.lit("")))


def squeezed(c: Column) -> Column:
    """Trimmed, lower case, runs of blanks to one."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"{BLANK}+", " "))


def answer_words(c: Column) -> Column:
    """Lower case, what is no letter, digit or underscore to blanks, runs of blanks to one."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def phone(c: Column) -> Column:
    """Digits; eleven of them that start with 8 start with 7 instead."""
    d = F.regexp_replace(c, r"[^0-9]", "")
    return F.when((F.length(d) == 11) & d.startswith("8"), F.concat(F.lit("7"), F.substring(d, 2, 10))).otherwise(d)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def surname(c: Column) -> Column:
    """First word of three letters or more, lower case; without one the text itself."""
    low = F.lower(F.trim(c))
    return F.coalesce(F.nullif(F.regexp_extract(low, r"([а-яёa-z]{3,})", 1), F.lit("")), low)


def address(c: Column) -> Column:
    """Dotted street words dropped, commas and stops to blanks."""
    x = F.regexp_replace(F.lower(c), rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(STREET_WORDS)})[.]{BLANK}*", "")
    return F.trim(F.regexp_replace(x, r"[,.\s\p{Z}]+", " "))


def schedule_tokens(c: Column) -> Column:
    """Days (distinct, first; working days and weekends by their ends) and hours (repeats kept) of a timetable text."""
    low = F.lower(F.coalesce(c, F.lit("")))
    names = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(y) for y in x]) for kv in DAYS.items() for x in kv])
    words = F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+)"))
    days = F.array_distinct(F.flatten(F.filter(F.transform(words, lambda w: F.try_element_at(names, w)), lambda x: x.isNotNull())))
    hours = F.regexp_extract_all(low, F.lit(r"(?<![\p{L}\p{N}_])([0-9]{1,2})(?::00)?(?![\p{L}\p{N}_])"), F.lit(1))
    bare = F.transform(hours, lambda h: F.coalesce(F.nullif(F.regexp_replace(h, "^0+", ""), F.lit("")), F.lit("0")))
    return F.concat(days, bare)


def tokens(c: Column) -> Column:
    """Runs of Latin and Russian letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-zа-яё0-9]+)"))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9а-яё]+", "_"), r"^_+|_+$", "")


def claims(df: DataFrame, text: str = "text") -> DataFrame:
    """One row a claim: ``(family, claim)`` beside the other columns; overlaps count in every family."""
    raw = F.coalesce(F.col(text), F.lit(""))
    per = [F.transform(F.regexp_extract_all(raw, F.lit(f"({rx})")), _family(name)) for name, rx in CLAIMS]
    return df.withColumn("_c", F.explode(F.concat(*per))).withColumn("family", F.col("_c.family")).withColumn("claim", F.trim(F.col("_c.claim"))).drop("_c")


def _family(name: str):
    return lambda x: F.struct(F.lit(name).alias("family"), x.alias("claim"))


def fenced_json(c: Column, schema: str) -> Column:
    """An answer's JSON with code fences dropped; text that is no JSON gives NULL."""
    return F.from_json(F.trim(F.regexp_replace(c, r"(?m)^```.*$", "")), schema)


def clamped(c: Column, low: int = 0, high: int = 10) -> Column:
    """A judge's mark as an integer within bounds; what isn't a number is 0."""
    return F.least(F.greatest(F.coalesce(F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double"), F.lit(0.0)).cast("int"), F.lit(low)), F.lit(high))


def family(explicit: Column, notes: Column, own: Column, pattern: str = r"(sf_[0-9]+)") -> Column:
    """Seed family: the stated one, else one named in the notes, else the row's own id."""
    return F.coalesce(blank_to_null(explicit), F.nullif(F.regexp_extract(F.coalesce(notes, F.lit("")), pattern, 1), F.lit("")), own)


def context(ids: str, title: str, content: str, rank: str) -> Column:
    """Aggregate: chunks as one context, in rank order."""
    block = F.concat(F.lit("["), F.col(ids).cast("string"), F.lit("] "), F.col(title), F.lit("\n"), F.col(content))
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b"))))
    return F.array_join(F.transform(rows, lambda x: x["b"]), "\n---\n")


def sections(df: DataFrame, headers: dict[str, str], keys: list[str], text: str = "text") -> DataFrame:
    """One row a section: the first hit of each header pattern opens one, the next header closes it."""
    t = F.coalesce(F.col(text), F.lit(""))
    hits = F.array(*[F.struct(F.regexp_instr(t, F.lit(rx)).alias("at"), F.lit(name).alias("section"), F.length(F.regexp_extract(t, rx, 0)).alias("size")) for name, rx in headers.items()])
    hits = F.array_sort(F.filter(hits, lambda h: h["at"] > 0))
    df = df.withColumn("_h", hits).select(*keys, F.col(text).alias("_t"), "_h", F.posexplode("_h").alias("section_no", "_s"))
    end = F.coalesce(F.get(F.col("_h"), F.col("section_no") + 1)["at"], F.length("_t") + 1)
    start = F.col("_s.at") + F.col("_s.size")
    return df.select(*keys, "section_no", F.col("_s.section").alias("section"), F.trim(F.substring(F.col("_t"), start, F.greatest(end - start, F.lit(0)))).alias("body"))


def label_of(c: Column, vocabulary: list[str]) -> Column:
    """The word of ``vocabulary`` (plain letters, four or more) that a loosely written label means, else NULL: case, blanks and
    punctuation don't count, and one wrong, lost, added or swapped letter still means a word if that fits only one of them."""
    x = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "")
    letters = F.array_sort(F.split(x, ""))

    def near(k: str) -> Column:
        swapped = (F.length(x) == len(k)) & (letters == F.array(*[F.lit(y) for y in sorted(k)])) & (F.levenshtein(x, F.lit(k)) <= 2)
        return (F.levenshtein(x, F.lit(k)) <= 1) | swapped

    fits = F.filter(F.array(*[F.when(near(k), F.lit(k)) for k in vocabulary]), lambda v: v.isNotNull())
    return F.when(x == "", None).when(x.isin(*vocabulary), x).when(F.size(fits) == 1, F.get(fits, F.lit(0)))


# Leftovers of paper forms, removed in this order.
JUNK = (
    r"Дата\s*«[_\s]+»[_\s]*2[0-9]{2}__?г\.?",
    r"Подпись\s+(?:пациента|врача|родителя|заказчика|законного).*?\(подпись,?\s*ФИО\)?",
    r"Второй\s+экземпляр\s+получил.*",
    r"Памятку\s+получил\(а\).*",
    r"Мною\s+заданы\s+все\s+интересующие.*?осложнений\.?",
    r"Я\s+обязуюсь\s+соблюдать.*?осложнений\.?",
    r"Повторное\s+проведение.*?рекомендовано:.*",
    r"_{4,}",
    r"^[0-9]+\.\s*Другое:\s*$",
)
#: What follows: pattern and replacement, in order.
_TIDY = ((r"\t", " "), (r"[○●■]\s*", "• "), (r"([0-9]+\.)\s{2,}", "$1 "), (r"\n{3,}", "\n\n"), (r"^\.\s*\n", ""))


def cleaned(c: Column) -> Column:
    """Text of a scanned form without its junk: tabs and bullets made one, gaps of lists and blank lines closed up, ends trimmed."""
    x = F.coalesce(c, F.lit(""))
    for junk in JUNK:
        x = F.regexp_replace(x, f"(?ms){junk}", "")
    for pattern, new in _TIDY:
        x = F.regexp_replace(x, pattern, new)
    return F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))


def spoken(value: str | None) -> str:
    """A JSON value as readable lines: ``key: value``, nested objects below their key, lists as dashes. What is no JSON stays as it is."""

    def lines(v: object, indent: int = 0) -> str:
        pad = "  " * indent
        if isinstance(v, dict):
            inner = [(k, lines(x, indent + 1)) for k, x in v.items()]
            return "\n".join(f"{pad}{k}:\n{x}" if "\n" in x else f"{pad}{k}: {x}" for k, x in inner)
        if isinstance(v, list):
            return "\n".join(f"{pad}- {lines(x)}" for x in v)
        return str(v)

    if value is None:
        return ""
    try:
        return lines(json.loads(value))
    except ValueError:
        return value


@F.pandas_udf(T.StringType())
def _spoken(v: pd.Series) -> pd.Series:
    return v.map(spoken)


def with_spoken(df: DataFrame, json_column: str, out: str = "spoken") -> DataFrame:
    """``df`` with nested JSON values as text (see :func:`spoken`), batch by batch: recursion has no expression."""
    return df.withColumn(out, _spoken(F.col(json_column)))


def resolved(queries: DataFrame, names: DataFrame, key: str, text: str, name: str, stem: int = 4) -> DataFrame:
    """``(key, name)``: names whose first word shares its first ``stem`` letters with a word of the text, whatever the ending; shorter
    ones never match. A join on stems: names are never compared with texts one by one."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"([а-яё]+)"))
    w = queries.select(key, F.explode(F.array_distinct(F.transform(F.filter(words, lambda x: F.length(x) >= stem), lambda x: F.substring(x, 1, stem)))).alias("_s"))
    first = F.lower(F.element_at(F.split(F.trim(F.col(name)), r"\s+"), 1))
    n = names.select(name, first.alias("_f")).distinct().where(F.length("_f") >= stem).select(name, F.substring("_f", 1, stem).alias("_s"))
    return w.join(n, "_s").select(key, name).distinct()
