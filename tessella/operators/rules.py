"""Pattern classifiers and filters over text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Route patterns for the message tables, by class; the order of classes is their priority.
ROUTES: dict[str, tuple[str, ...]] = {
    "anamnesis": ("болит|ноет|тянет|стреляет|пульсирует|дёргает", "распух|кровит|гноится|немеет|шатается", "чернеет|потемнел|крошится|реагирует|зудит|жжёт|ломит|скрипит"),
    "booking": ("запи[сш]", "перенес|отмен(?:ить|а)", "есть ли окно|свободный слот|держите место|хочу попасть"),
    "faq": ("сколько|стоит|цена|гарантия", "как проходит|зачем|чем заменить|больно ли|долго ли", "график|адрес"),
    "unsupported": ("погод", "обои", "сочините|посчитайте"),
}


def routed(text: Column, routes: dict[str, tuple[str, ...]] | None = None, fallback: str = "unsupported") -> Column:
    """``struct<route, confidence, rule>``: class with a hit of the highest priority
    (the fallback class gives way to any other), confidence by its number of hits."""
    routes = routes or ROUTES
    low = F.lower(F.coalesce(text, F.lit("")))
    order = [c for c in routes if c != fallback] + [c for c in routes if c == fallback]
    hits = F.array(*[F.struct(F.lit(c).alias("route"), sum((F.when(low.rlike(p), 1).otherwise(0) for p in routes[c]), F.lit(0)).alias("n")) for c in order])
    made = F.transform(
        F.filter(hits, lambda h: h["n"] > 0),
        lambda h: F.struct(h["route"].alias("route"), F.round(F.least(0.5 + 0.1 * h["n"], F.lit(0.95)), 6).alias("confidence"), F.concat(h["n"].cast("string"), F.lit("_patterns")).alias("rule")),
    )
    none = F.struct(F.lit(fallback).alias("route"), F.lit(0.3).cast("double").alias("confidence"), F.lit("no_match").alias("rule"))
    return F.coalesce(F.get(made, F.lit(0)), none)


def first_marker(text: Column, markers: dict[str, tuple[str, ...]]) -> Column:
    """First marker (in the given order) that stands in a text, case aside, as ``category:marker``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = [F.when(low.contains(m.lower()), F.lit(f"{cat}:{m}")) for cat, ms in markers.items() for m in ms]
    return F.coalesce(*found, F.lit(None).cast("string"))


def consistent(df: DataFrame, label: str, text: str = "text", routes: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rows whose text hits no pattern of a class other than its own."""
    routes = routes or ROUTES
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    other = F.lit(False)
    for c, ps in routes.items():
        other = other | ((F.col(label) != c) & low.rlike("|".join(f"(?:{p})" for p in ps)))
    return df.where(~other)


def only_alphabet(text: Column, allowed: str = r"^[\p{IsCyrillic}a-zA-Z0-9\p{P}\p{S}\s]*$", banned: str = "[іїєґІЇЄҐ]") -> Column:
    """Whether every character is allowed and none banned."""
    t = F.coalesce(text, F.lit(""))
    return t.rlike(allowed) & ~t.rlike(banned)
