"""Retrieval: lexical, dense, fused, reranked, keyword and cascaded rankings, and their scores.

Queries are ``(query_id, query)``, chunks ``(chunk_id, content)`` with a title
or other columns beside; rankings are ``(query_id, chunk_id, score, rank)``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.operators.text import tokens

K1, B = 1.5, 0.75
# Words that say nothing about a text.
STOP = tuple("и в на не что я с он а как это по но к из у за бы от до то же вы мы да ли уже нет вот мне вас нас ещё или так все при".split())


def ranked(scores: DataFrame, k: int, *tie: Column) -> DataFrame:
    """The ``k`` best a query; ties by ``tie``, else the smaller chunk. A window whose
    filter Spark turns into a limit per group, before the shuffle and after it."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *(tie or (F.col("chunk_id"),)))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Bytes of a query side that goes to every task at a time; more queries go in blocks, for the same rows.
SENT = 64_000_000


def _blocks(queries: DataFrame, size: int) -> list[DataFrame]:
    """The stated query set in hash blocks of about ``size`` queries, each to be gathered and sent."""
    n = max(1, -(-queries.count() // size))
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) if n > 1 else queries for b in range(n)]


class _Best:
    """The ``k`` best chunks of every query that a task has met; ties go to the smaller id, or the ``larger``."""

    def __init__(self, n: int, k: int, larger: bool):
        self.k, self.larger, self.held = k, larger, [(np.empty(0), np.empty(0, object)) for _ in range(n)]

    def add(self, scores: np.ndarray, ids: np.ndarray, some: np.ndarray | None = None) -> None:
        """``scores[chunk, query]``; only cells of ``some`` count."""
        for q in range(scores.shape[1]):
            at = np.flatnonzero(some[:, q]) if some is not None else np.arange(len(ids))
            s = np.r_[self.held[q][0], scores[at, q]]
            i = np.concatenate([self.held[q][1], ids[at]])
            if len(s) > self.k:
                keep = np.flatnonzero(s >= np.partition(s, len(s) - self.k)[len(s) - self.k])  # with all ties at the limit
                s, i = s[keep], i[keep]
            order = sorted(range(len(s)), key=lambda x: i[x], reverse=self.larger)
            order = sorted(order, key=lambda x: -s[x])[: self.k]
            self.held[q] = s[order], i[order]

    def rows(self, names: list, kind: pa.DataType, chunk_kind: pa.DataType) -> pa.RecordBatch:
        q = [names[n] for n, (s, _) in enumerate(self.held) for _ in s]
        ids = [x for _, i in self.held for x in i]
        return pa.RecordBatch.from_arrays([pa.array(q, kind), pa.array(ids, chunk_kind), pa.array(np.concatenate([s for s, _ in self.held]) if self.held else [], pa.float64())], ["query_id", "chunk_id", "score"])


def _ranking_kinds(queries: DataFrame, chunks: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, score double"


def bm25(queries: DataFrame, chunks: DataFrame, k: int = 5, stop: tuple[str, ...] = STOP, tokenise: Callable[[Column], Column] = tokens, stems: Callable[[Column], Column] | None = None, block: int = 2_000) -> DataFrame:
    """BM25 of the title (if chunks have one) and content. Stop words go before ``stems`` are taken.
    Query terms are not made distinct: a repeated term counts again. Chunks without a common
    term aren't ranked; repeated chunk ids count as one text each. Empty tables give no row.

    The query set is stated and goes to every chunk in blocks: one pass counts the chunks that hold each query
    term, a second scores each chunk where it lies, and no more than ``k`` rows a query leave a task. No postings move.
    """

    def bag(c: Column) -> Column:
        t = F.filter(tokenise(c), lambda x: ~x.isin(*stop)) if stop else tokenise(c)
        return stems(t) if stems else t

    text = F.concat_ws(" ", "title", "content") if "title" in chunks.columns else F.coalesce("content", F.lit(""))
    docs = chunks.select("chunk_id", bag(text).alias("t"))
    n, total = docs.agg(F.count(F.lit(1)), F.sum(F.size("t"))).first()
    kinds, avg = _ranking_kinds(queries, chunks), (total or 0) / n if n else 0.0
    q_kind, c_kind = (to_arrow_type(x.dataType) for x in (queries.schema["query_id"], chunks.schema["chunk_id"]))
    out = None
    for part in _blocks(queries, block) if n and avg else []:
        rows = part.select("query_id", bag(F.col("query")).alias("t")).toPandas()  # a block of queries
        names, terms = rows["query_id"].tolist(), {}
        for q, ts in enumerate(rows["t"]):
            for x in ts:
                terms.setdefault(x, {}).setdefault(q, 0)
                terms[x][q] += 1
        wanted = F.broadcast(part.sparkSession.createDataFrame([(x,) for x in terms], "term string"))
        df = {r["term"]: r["n"] for r in docs.select(F.explode(F.array_distinct("t")).alias("term")).join(wanted, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # query terms
        idf = {x: math.log((n - c + 0.5) / (c + 0.5) + 1) for x, c in df.items()}
        weights = {x: (np.array(list(terms[x]), np.int64), np.array(list(terms[x].values())) * idf[x]) for x in df}

        def run(batches: Iterator[pa.RecordBatch], names=names, weights=weights) -> Iterator[pa.RecordBatch]:
            best = _Best(len(names), k, False)
            for b in batches:
                ids = np.array(b.column("chunk_id").to_pylist(), object)
                bags = b.column("t").to_pylist()
                for lo in range(0, len(bags), 1_000):
                    some = bags[lo : lo + 1_000]
                    scores, met = np.zeros((len(some), len(names))), np.zeros((len(some), len(names)), bool)
                    for d, ts in enumerate(some):
                        norm = K1 * (1 - B + B * len(ts) / avg)
                        for x, tf in Counter(x for x in ts if x in weights).items():
                            q, w = weights[x]
                            scores[d, q] += w * (tf * (K1 + 1) / (tf + norm))
                            met[d, q] = True
                    best.add(np.round(scores, 6), ids[lo : lo + 1_000], met)
            yield best.rows(names, q_kind, c_kind)

        s = docs.mapInArrow(run, kinds)
        out = s if out is None else out.union(s)
    return ranked(out if out is not None else chunks.sparkSession.createDataFrame([], kinds), k)


def vectors(col: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.empty((0, 0))


def dense(queries: DataFrame, chunks: DataFrame, k: int = 5, but_itself: bool = False) -> DataFrame:
    """Largest dot products of ``(query_id, v)`` with ``(chunk_id, v)``; ties go to the larger chunk id. The query set is
    stated and goes to every chunk in blocks of ``SENT`` bytes; a chunk block is one matrix product, and no more than ``k``
    rows a query leave a task. ``but_itself`` leaves out the chunk of the query's own id, where ids are of one kind."""
    first = queries.select(F.size("v").alias("n")).limit(1).collect()
    kinds = _ranking_kinds(queries, chunks)
    q_kind, c_kind = (to_arrow_type(x.dataType) for x in (queries.schema["query_id"], chunks.schema["chunk_id"]))
    out = None
    for part in _blocks(queries, max(1, SENT // (8 * first[0]["n"]))) if first else []:
        rows = part.select("query_id", "v").toPandas()
        names, m = rows["query_id"].tolist(), np.array([np.asarray(v, np.float64) for v in rows["v"]])

        def run(batches: Iterator[pa.RecordBatch], names=names, m=m) -> Iterator[pa.RecordBatch]:
            best = _Best(len(names), k, True)
            for b in batches:
                ids, v = np.array(b.column("chunk_id").to_pylist(), object), vectors(b.column("v"))
                if len(ids):
                    other = ids[:, None] != np.array(names, object)[None] if but_itself else None
                    best.add(np.round(v @ m.T, 6), ids, other)
            yield best.rows(names, q_kind, c_kind)

        s = chunks.select("chunk_id", "v").mapInArrow(run, kinds)
        out = s if out is None else out.union(s)
    return ranked(out if out is not None else chunks.sparkSession.createDataFrame([], kinds), k, F.desc("chunk_id"))


def fused(lists: list[DataFrame], k: int = 5, const: int = 60, boost: Column | None = None, beside: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Reciprocal rank fusion: sum of 1/(const + rank); ties keep the order of the lists, then of ranks.
    ``boost`` (a factor) applies before the cut; ``beside`` may join the columns it needs."""
    rows = None
    for n, r in enumerate(lists):
        part = r.select("query_id", "chunk_id", "rank", F.lit(n).alias("list"))
        rows = part if rows is None else rows.union(part)
    s = rows.groupBy("query_id", "chunk_id").agg(F.sum(1 / (F.lit(const) + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    s = beside(s) if beside else s
    s = s.select("query_id", "chunk_id", "first", F.round(F.col("score") * (boost if boost is not None else F.lit(1.0)), 9).alias("score"))
    return ranked(s, k, F.col("first.list"), F.col("first.rank")).drop("first")


def jaccard(a: Column, b: Column) -> Column:
    """Share of common tokens: a deterministic stand-in for a cross-encoder."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.round(F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0)), 6)


def reranked(ranking: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = 5, floor: float = 0.05, scorer: Callable[[Column, Column], Column] = jaccard) -> DataFrame:
    """Order by a scorer over (query, content). Where no candidate of a query
    reaches ``floor``, the given order stays and scores are 0."""
    c = ranking.select("query_id", "chunk_id", F.col("rank").alias("before"))
    c = c.join(queries.select("query_id", "query"), "query_id").join(chunks.select("chunk_id", "content"), "chunk_id")
    c = c.withColumn("s", scorer(F.col("query"), F.col("content")))
    top = F.max("s").over(Window.partitionBy("query_id"))
    c = c.withColumn("score", F.when(top < floor, F.lit(0.0)).otherwise(F.col("s")))
    return ranked(c.select("query_id", "chunk_id", "before", "score"), k, F.col("before"))


# Words by which the keyword baseline tells topics, doctors and prices.
TOPICS = {
    "clinic_location": ("адрес", "где", "находит", "расположен"),
    "clinic_contacts": ("телефон", "позвонить", "номер", "контакт", "связ"),
    "clinic_working_hours": ("работает", "время", "график", "часы", "выходн"),
    "clinic_patient_comfort_and_safety": ("седация", "наркоз", "сон", "закись"),
    "clinic_financing": ("рассрочка", "кредит", "оплата"),
}
PRICES = ("стоит", "цена", "стоимость", "прайс", "сколько", "почём")
DOCTORS = ("врач", "доктор", "стаж", "хирург", "ортодонт", "терапевт", "ортопед", "стоматолог", "имплантолог", "пародонтолог")


def keyword_scores(queries: DataFrame, chunks: DataFrame, topics: dict[str, tuple[str, ...]] = TOPICS, prices: tuple[str, ...] = PRICES) -> DataFrame:
    """Score of the keyword baseline over ``chunks(chunk_id, content, topic, is_doctor, is_price, surname, services)``: half a
    point a common word; 5 if a doctor's surname stands in the query; 3 a word of the chunk's topic that does; for price chunks 3
    if a price word does and 2 once if a service (``services`` is an array of texts) shares a word.

    Pairs are formed where something scores: by common words, and by triggers that need none (a topic's, a
    surname's, a price's chunks meet the queries that hold its words). Other pairs score 0 and give no row.
    """
    q = queries.select("query_id", F.lower("query").alias("low"), F.array_distinct(tokens(F.col("query"))).alias("qt"))
    flags = ("topic", "is_doctor", "is_price", "surname")
    c = chunks.select("chunk_id", *flags, F.array_distinct(tokens(F.col("content"))).alias("ct"), F.array_distinct(F.flatten(F.transform("services", tokens))).alias("st"))
    words = q.select("query_id", F.explode("qt").alias("t"))
    # the query set is stated; Spark broadcasts it where it is small
    common = words.join(c.select("chunk_id", F.explode("ct").alias("t")), "t").groupBy("query_id", "chunk_id").agg((0.5 * F.count(F.lit(1))).alias("s"))
    service = words.join(c.where("is_price").select("chunk_id", F.explode("st").alias("t")), "t").select("query_id", "chunk_id").distinct().withColumn("s", F.lit(2.0))
    spark = queries.sparkSession
    table = spark.createDataFrame([(t, w) for t, ws in topics.items() for w in ws], "topic string, w string")
    said = q.join(F.broadcast(table), F.contains("low", F.col("w"))).groupBy("query_id", "topic").agg((3.0 * F.count(F.lit(1))).alias("s"))
    topic = said.join(c.select("chunk_id", "topic"), "topic").select("query_id", "chunk_id", "s")
    asks = q.where(F.col("low").rlike("|".join(prices))).select("query_id", F.lit(True).alias("p"))
    price = asks.join(c.where("is_price").select("chunk_id", F.lit(True).alias("p")), "p").select("query_id", "chunk_id", F.lit(3.0).alias("s"))
    # one row a surname meets the queries, then its chunks
    names = c.where("is_doctor and coalesce(surname, '') <> ''").select(F.lower("surname").alias("n"), "chunk_id")
    named = names.select("n").distinct().join(F.broadcast(q.select("query_id", "low")), F.contains("low", F.col("n"))).select("query_id", "n")
    doctor = named.join(names, "n").select("query_id", "chunk_id").distinct().withColumn("s", F.lit(5.0))
    every = common.union(service).union(topic).union(price).union(doctor)
    return every.groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), 6).alias("score"))


def eligible(query: Column, answerable: Column, match_type: Column, entity_match: Column, allowed: tuple[str, ...], many: str, multifact: bool = False, aftercare: bool = False, exact: bool = True) -> Column:
    """Whether a template may answer directly: it has an answer, the query asks for one thing, the match is of an allowed kind,
    aftercare is allowed, a doctor was met exactly, and a query about doctors met a doctor."""
    low, kind = F.lower(F.coalesce(query, F.lit(""))), F.coalesce(match_type, F.lit("none"))
    doctor = kind == "doctor_query"
    ok = F.coalesce(answerable, F.lit(False)) & kind.isin(*allowed)
    if not multifact:
        ok = ok & ~low.rlike(many)
    if not aftercare:
        ok = ok & (kind != "aftercare_query")
    if exact:
        ok = ok & (~doctor | (F.coalesce(entity_match, F.lit("none")) == "exact"))
    return ok & (doctor | ~low.rlike("|".join(DOCTORS)))


def cascade(direct: DataFrame, retrieved: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Route of every query: ``direct`` if its template answer is eligible and sure
    enough, else retrieval with the reason. ``direct``: (query_id, confidence, eligible)."""
    low, bad = F.col("confidence") < threshold, ~F.col("eligible")
    why = F.when(low & bad, "below_threshold+failed_eligibility").when(low, "below_threshold").when(bad, "failed_eligibility")
    best = retrieved.where("rank = 1").select("query_id", F.col("chunk_id").alias("top_chunk"))
    return direct.join(best, "query_id", "left").select("query_id", F.when(low | bad, "retrieval").otherwise("direct").alias("route"), F.coalesce(why, F.lit("")).alias("reason"), "top_chunk")


def retrieval_scores(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Hit, recall, reciprocal rank and in-context of ``(query_id, ids array)`` against
    ``(query_id, gold array<array>)``: the best over alternatives, each measure by
    itself. Empty alternatives are skipped; queries without any are left out."""
    g = gold.withColumn("gold", F.filter("gold", lambda a: F.size(a) > 0)).where(F.size("gold") > 0)
    r = results.join(g, "query_id")
    ids = F.col("ids")
    hit = F.exists("gold", lambda a: F.arrays_overlap(a, ids))
    recall = F.array_max(F.transform("gold", lambda a: F.size(F.array_intersect(a, ids)) / F.size(F.array_distinct(a))))
    first = lambda a: F.array_min(F.filter(F.transform(a, lambda x: F.array_position(ids, x)), lambda p: p > 0))
    rr = F.array_max(F.transform("gold", lambda a: F.coalesce(1 / first(a), F.lit(0.0))))
    whole = F.exists("gold", lambda a: F.size(F.array_except(a, ids)) == 0)
    return r.select("query_id", hit.alias("hit"), F.round(recall, 6).alias("recall"), F.round(rr, 6).alias("rr"), whole.alias("in_context"))


def diversity_guard(ranking: DataFrame, pool: DataFrame, multi: Column, k: int, zones: tuple[str, ...] = ("doctors", "clinic_info")) -> DataFrame:
    """Zones the reranker lost come back: for a multi-fact query whose pool covers two
    zones or more, each lost zone's best pool chunk replaces the last chunk of the
    ranking that is not alone in its zone, in zone order.

    ``ranking`` and ``pool``: (query_id, query, chunk_id, zone, rank). One group
    holds one query's candidates, k and the pool's depth at most."""
    import pandas as pd

    both = ranking.withColumn("src", F.lit("r")).unionByName(pool.withColumn("src", F.lit("p"))).withColumn("multi", multi)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf[pdf["src"] == "r"].sort_values("rank").head(k)
        p = pdf[pdf["src"] == "p"].sort_values("rank")
        kept = list(zip(r["chunk_id"], r["zone"], strict=True))
        have = set(p["zone"]) & set(zones)
        if len(pdf) and bool(pdf["multi"].iloc[0]) and len(have) >= 2:
            slot = len(kept) - 1
            for z in zones:
                if z in have and z not in {x for _, x in kept} and slot >= 0:
                    chosen = {c for c, _ in kept}
                    best = next((c for c, x in zip(p["chunk_id"], p["zone"], strict=True) if x == z and c not in chosen), None)
                    if best is not None:
                        kept[slot] = (best, z)
                        slot -= 1
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[:1].repeat(len(kept)).to_list(), "chunk_id": [c for c, _ in kept], "rank": range(1, len(kept) + 1)})

    ids = {f.name: f.dataType.simpleString() for f in ranking.schema.fields}
    return both.groupBy("query_id").applyInPandas(one, f"query_id {ids['query_id']}, chunk_id {ids['chunk_id']}, rank int")


#: Strategies by id: name, what they need beside queries and chunks, and the operators they are composed of.
STRATEGIES: dict[str, tuple[str, tuple[str, ...], tuple[Callable, ...]]] = {
    "B0": ("keyword templates", ("topics",), (keyword_scores, ranked)),
    "S2": ("lexical", (), (bm25,)),
    "S3": ("dense", ("vectors",), (dense,)),
    "S4": ("hybrid", ("vectors",), (bm25, dense, fused)),
    "S4r": ("hybrid, reranked", ("vectors", "scorer"), (bm25, dense, fused, reranked, diversity_guard)),
    "S5": ("cascade", ("topics", "vectors", "scorer"), (keyword_scores, eligible, reranked, cascade)),
}
_EXPERIMENTAL = ("S4r", "S5")


def strategies(baseline: bool = True, experimental: bool = False, given: tuple[str, ...] = ("topics", "vectors", "scorer")) -> list[str]:
    """Ids of the strategies to run, in order: the core ones, the baseline and the experimental ones if asked for. A
    strategy that needs something not ``given`` is an error."""
    ids = [i for i in STRATEGIES if (baseline or i != "B0") and (experimental or i not in _EXPERIMENTAL)]
    if lost := {i: sorted(set(STRATEGIES[i][1]) - set(given)) for i in ids if set(STRATEGIES[i][1]) - set(given)}:
        raise ValueError(f"strategies lack what they need: {lost}")
    return ids
