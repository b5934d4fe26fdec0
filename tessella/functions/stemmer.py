"""Russian suffix stripping after the published Snowball description, as an Arrow UDF."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Endings of the published algorithm, by class.
GERUND_1 = ("вшись", "вши", "в")
GERUND_2 = ("ившись", "ывшись", "ивши", "ывши", "ив", "ыв")
ADJECTIVE = "ими ыми его ого ему ому ее ие ые ое ей ий ый ой ем им ым ом их ых ую юю ая яя ою ею".split()
PARTICIPLE_1 = ("ем", "нн", "вш", "ющ", "щ")
PARTICIPLE_2 = ("ивш", "ывш", "ующ")
REFLEXIVE = ("ся", "сь")
VERB_1 = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split()
VERB_2 = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()
VOWELS = "аеиоуыэюя"


def _drop(word: str, rv: int, plain: tuple | list, after_a: tuple | list = ()) -> str | None:
    """``word`` without its longest ending that lies in RV; endings of ``after_a`` need а or я before."""
    best = ""
    for e in plain:
        if len(e) > len(best) and word.endswith(e) and len(word) - len(e) >= rv:
            best = e
    for e in after_a:
        at = len(word) - len(e)
        if len(e) > len(best) and word.endswith(e) and at - 1 >= rv and word[at - 1] in "ая":
            best = e
    return word[: -len(best)] if best else None


def stem(word: str) -> str:
    w = word.replace("ё", "е")
    m = re.search(f"[{VOWELS}]", w)
    if not m:
        return w
    rv = m.end()
    at = 0
    for _ in range(2):
        m = re.compile(f"[{VOWELS}][^{VOWELS}]").search(w, at)
        if not m:
            at = len(w)
            break
        at = m.end()
    x = _drop(w, rv, GERUND_2, GERUND_1)
    if x is None:
        w = _drop(w, rv, REFLEXIVE) or w
        x = _drop(w, rv, ADJECTIVE)
        if x is not None:
            x = _drop(x, rv, PARTICIPLE_2, PARTICIPLE_1) or x
        else:
            x = _drop(w, rv, VERB_2, VERB_1)
            if x is None:
                x = _drop(w, rv, NOUN)
    w = x if x is not None else w
    if w.endswith("и") and len(w) - 1 >= rv:
        w = w[:-1]
    for e in ("ость", "ост"):
        if w.endswith(e) and len(w) - len(e) >= at:
            w = w[: -len(e)]
            break
    if w.endswith("нн") and len(w) - 1 >= rv:
        return w[:-1]
    for e in ("ейше", "ейш"):
        if w.endswith(e) and len(w) - len(e) >= rv:
            w = w[: -len(e)]
            return w[:-1] if w.endswith("нн") else w
    return w[:-1] if w.endswith("ь") and len(w) - 1 >= rv else w


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(words: pd.Series) -> pd.Series:
    held: dict[str, str] = {}
    return words.map(lambda ws: None if ws is None else [held.setdefault(w, stem(w)) if w not in held else held[w] for w in ws])


def stems(tokens: Column) -> Column:
    """Stems of an array of words, batch by batch."""
    return _stems(tokens)
