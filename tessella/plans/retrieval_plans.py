"""Plans of retrieval: eval queries against all documents, vectors against all vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import retrieval as r
from tessella.plans.registry import plan, t

_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[a-zа-яё0-9]+')"
_BAG = "list_filter(" + _TOK + ", lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in r.STOP) + "))"
_TITLED = "concat_ws(' ', replace(entity_id, '_', ' '), text)"


def _bm25_sql(query: str, k: int) -> str:
    return f"""(WITH d AS (SELECT doc_id AS chunk_id, {_BAG.format(_TITLED)} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS al FROM d),
q AS (SELECT sample_id AS query_id, unnest({_BAG.format(query)}) AS term FROM eval_sample), qf AS (SELECT query_id, term, count(*) AS qf FROM q GROUP BY ALL),
p AS (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM d), tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT query_id, chunk_id, round(sum(qf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / al))), 6) AS score FROM qf JOIN tf USING (term) JOIN df USING (term), s GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM sc) SELECT * FROM rk WHERE rank <= {k})"""


def _queries(spark: SparkSession, d: str, text: str = "query") -> DataFrame:
    return t(spark, d, "eval_sample").select(F.col("sample_id").alias("query_id"), F.col(text).alias("query"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents under the title of their entity."""
    return t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.regexp_replace("entity_id", "_", " ").alias("title"), F.col("text").alias("content"))


@plan(f"SELECT * FROM {_bm25_sql('query', 5)}")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return r.bm25(_queries(spark, d), _chunks(spark, d), 5)


@plan()
def bm25_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """The same over stems."""
    from tessella.functions.stemmer import stems

    return r.bm25(_queries(spark, d), _chunks(spark, d), 5, stems=stems)


_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@plan(f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round({_DOT}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC)::INT AS rank FROM s) SELECT * FROM k WHERE rank <= 5""")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return r.dense(q, e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")), 5, but_itself=True)


# Vectors of texts come from an outside encoder; here rows of the embeddings table stand in for them, chosen by number.
_VQ = "('0x' || substr(md5(sample_id), 1, 6))::BIGINT % (SELECT count(*) FROM embeddings)"
_VEC_RANKS = f"""(WITH s AS (SELECT e.sample_id AS query_id, c.doc_id AS chunk_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM eval_sample e JOIN embeddings a ON a.vec_id = {_VQ}, documents c JOIN embeddings b ON b.vec_id = c.doc_id % (SELECT count(*) FROM embeddings)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC)::INT AS rank FROM s) SELECT * FROM k WHERE rank <= 10)"""
_PRICED = "сколько|стоит|цен"
_RRF = f"""(WITH a AS {_bm25_sql('query', 10)}, b AS {_VEC_RANKS}, l AS (SELECT query_id, chunk_id, rank, 0 AS l FROM a UNION ALL SELECT query_id, chunk_id, rank, 1 FROM b),
s AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(l * 1000 + rank) AS f FROM l GROUP BY ALL),
x AS (SELECT query_id, chunk_id, f, round(score * CASE WHEN source_type = 'clinic_info' AND regexp_matches(lower(query), '{_PRICED}') THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END, 9) AS score FROM s JOIN documents ON doc_id = chunk_id JOIN eval_sample ON sample_id = query_id),
k AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f)::INT AS rank FROM x) SELECT * FROM k WHERE rank <= 5)"""


@plan(f"SELECT * FROM {_RRF}")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """BM25 and vectors fused, chunks of the priced kind weighted up before the cut where a query asks for prices."""
    q, c, e = _queries(spark, d), _chunks(spark, d), t(spark, d, "embeddings")
    n = e.count()
    at = F.conv(F.substring(F.md5("query_id"), 1, 6), 16, 10).cast("bigint") % n
    vec = lambda x, i: x.withColumn("vec_id", i).join(e, "vec_id")
    qv = vec(q, at).select("query_id", F.col("embedding").alias("v"))
    cv = vec(c.select("chunk_id"), F.col("chunk_id") % n).select("chunk_id", F.col("embedding").alias("v"))
    asks = q.where(F.lower("query").rlike(_PRICED)).select("query_id", F.lit(True).alias("asks"))
    kinds = t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), (F.col("source_type") == "clinic_info").alias("priced"))
    boosts = lambda r: r.join(asks, "query_id", "left").join(kinds, "chunk_id", "left")
    return r.fused([r.bm25(q, c, 10), r.dense(qv, cv, 10)], 5, boost=F.when(F.col("asks") & F.col("priced"), 1.3).otherwise(1.0), beside=boosts)


@plan(f"""WITH a AS {_bm25_sql('query', 10)}, c AS (SELECT a.query_id, a.chunk_id, a.rank AS before, list_distinct({_TOK.format('query')}) AS x, list_distinct({_TOK.format('text')}) AS y FROM a JOIN eval_sample ON sample_id = query_id JOIN documents ON doc_id = chunk_id),
s AS (SELECT query_id, chunk_id, before, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS s FROM c), f AS (SELECT query_id, chunk_id, before, CASE WHEN max(s) OVER (PARTITION BY query_id) < 0.05 THEN 0 ELSE s END AS score FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before)::INT AS rank FROM f) SELECT * FROM k WHERE rank <= 5""")
def rerank_floor(spark: SparkSession, d: str) -> DataFrame:
    q, c = _queries(spark, d), _chunks(spark, d)
    return r.reranked(r.bm25(q, c, 10), q, c, 5)


@plan()
def diversity_guard(spark: SparkSession, d: str) -> DataFrame:
    q, c = _queries(spark, d), _chunks(spark, d)
    pool = r.bm25(q, c, 10)
    zone = t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("source_type", F.lit("")).alias("zone"))
    full = lambda x: x.select("query_id", "chunk_id", "rank").join(q, "query_id").join(zone, "chunk_id").select("query_id", "query", "chunk_id", "zone", "rank")
    return r.diversity_guard(full(r.reranked(pool, q, c, 5)), full(pool), F.lower("query").rlike(" и "), 5)


_TRIG = " UNION ALL ".join(f"SELECT '{k}' AS topic, '{w}' AS w" for k, ws in {"doctors": ("врач", "доктор", "лечил"), "clinic_info": ("где", "время", "можно")}.items() for w in ws)
_KW = f"""(WITH q AS (SELECT sample_id AS query_id, query, lower(query) AS low FROM eval_sample), w AS (SELECT query_id, unnest(list_distinct({_TOK.format('query')})) AS term FROM q),
d AS (SELECT doc_id AS chunk_id, source_type AS topic, coalesce(entity_id LIKE 'doctor%', false) AS dr, coalesce(source_type = 'clinic_info', false) AS pr, regexp_extract(text, '([А-ЯЁ][а-яё]{{4,}}(?:ов|ев|ин|ий))', 1) AS sur, regexp_extract(text, '^([^.]*)', 1) AS svc, text FROM documents),
a AS (SELECT query_id, chunk_id, 0.5::DOUBLE * count(*) AS s FROM w JOIN (SELECT chunk_id, unnest(list_distinct({_TOK.format('text')})) AS term FROM d) USING (term) GROUP BY ALL),
b AS (SELECT DISTINCT query_id, chunk_id, 2.0::DOUBLE AS s FROM w JOIN (SELECT chunk_id, unnest({_TOK.format('svc')}) AS term FROM d WHERE pr) USING (term)),
c AS (SELECT query_id, chunk_id, n * 3.0::DOUBLE AS s FROM (SELECT query_id, topic, count(*) AS n FROM q JOIN ({_TRIG}) k ON contains(low, w) GROUP BY ALL) JOIN d USING (topic)),
e AS (SELECT query_id, chunk_id, 3.0::DOUBLE AS s FROM q, d WHERE pr AND regexp_matches(low, '{"|".join(r.PRICES)}')),
f AS (SELECT query_id, chunk_id, 5.0::DOUBLE AS s FROM q, d WHERE dr AND coalesce(sur, '') <> '' AND contains(low, lower(sur))),
s AS (SELECT query_id, chunk_id, round(sum(s), 6) AS score FROM (FROM a UNION ALL FROM b UNION ALL FROM c UNION ALL FROM e UNION ALL FROM f) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s) SELECT * FROM k WHERE rank <= 5)"""


@plan(f"SELECT * FROM {_KW}")
def keyword_score(spark: SparkSession, d: str) -> DataFrame:
    """Kinds that occur in the documents stand for topics and price lists, a first sentence for services, a name in the text for the surname."""
    name = F.regexp_extract("text", "([А-ЯЁ][а-яё]{4,}(?:ов|ев|ин|ий))", 1)
    no = F.lit(False)
    c = t(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source_type").alias("topic"), F.coalesce(F.col("entity_id").startswith("doctor"), no).alias("is_doctor"),
        F.coalesce(F.col("source_type") == "clinic_info", no).alias("is_price"), name.alias("surname"), F.array(F.regexp_extract("text", "^([^.]*)", 1)).alias("services"),
    )
    return r.ranked(r.keyword_scores(_queries(spark, d), c, {"doctors": ("врач", "доктор", "лечил"), "clinic_info": ("где", "время", "можно")}), 5)


_MANY = " и что | и можно "
_CONF = "CASE WHEN score >= 6 THEN 0.8 WHEN score >= 3 THEN 0.7 WHEN score > 0 THEN 0.3 ELSE 0.0 END"


@plan(f"""WITH k AS (SELECT k.*, source_type, entity_id FROM {_KW} k JOIN documents ON doc_id = chunk_id WHERE rank = 1), b AS (SELECT query_id, chunk_id FROM {_bm25_sql('query', 1)}),
m AS (SELECT e.sample_id AS query_id, lower(e.query) AS low, coalesce(e.answerable, false) AS ok, {_CONF} AS c, CASE WHEN k.entity_id LIKE 'doctor%' THEN 'doctor_query' WHEN k.source_type = 'clinic_info' THEN 'price_query' WHEN k.source_type IS NULL THEN 'none' ELSE 'clinic_query' END AS kind, CASE WHEN score >= 8 THEN 'exact' ELSE 'none' END AS ent
FROM eval_sample e LEFT JOIN k ON k.query_id = e.sample_id),
d AS (SELECT *, ok AND kind IN ('doctor_query', 'price_query', 'clinic_query') AND NOT regexp_matches(low, '{_MANY}') AND (kind <> 'doctor_query' OR ent = 'exact') AND (kind = 'doctor_query' OR NOT regexp_matches(low, '{"|".join(r.DOCTORS)}')) AS good FROM m)
SELECT d.query_id, CASE WHEN c < 0.7 OR NOT good THEN 'retrieval' ELSE 'direct' END AS route, CASE WHEN c < 0.7 AND NOT good THEN 'below_threshold+failed_eligibility' WHEN c < 0.7 THEN 'below_threshold' WHEN NOT good THEN 'failed_eligibility' ELSE '' END AS reason, b.chunk_id AS top_chunk FROM d LEFT JOIN b USING (query_id)""")
def tiered_cascade(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "eval_sample").select(F.col("sample_id").alias("query_id"), "query", "answerable")
    doc = t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source_type", "entity_id")
    k = e.join(keyword_score(spark, d).where("rank = 1").join(doc, "chunk_id"), "query_id", "left")
    conf = F.expr(_CONF)
    kind = F.when(F.col("entity_id").startswith("doctor"), "doctor_query").when(F.col("source_type") == "clinic_info", "price_query").when(F.col("source_type").isNull(), "none").otherwise("clinic_query")
    ok = r.eligible(F.col("query"), F.col("answerable"), kind, F.when(F.col("score") >= 8, "exact").otherwise("none"), ("doctor_query", "price_query", "clinic_query"), _MANY)
    return r.cascade(k.select("query_id", conf.alias("confidence"), ok.alias("eligible")), r.bm25(_queries(spark, d), _chunks(spark, d), 1))


_RES = """(WITH g AS (SELECT sample_id AS query_id, category, seed_family_id AS fam, list_filter(gold_chunk_ids, lambda x: len(x) > 0) AS gold FROM eval_sample),
i AS (SELECT fam, list_sort(list_distinct(flatten(list(flatten(gold_chunk_ids))))) AS ids FROM (SELECT seed_family_id AS fam, gold_chunk_ids FROM eval_sample) GROUP BY fam),
j AS (SELECT query_id, category, ids, unnest(gold) AS a FROM g JOIN i USING (fam) WHERE len(gold) > 0)
SELECT query_id, category, bool_or(list_has_any(a, ids)) AS hit, round(max(len(list_intersect(list_distinct(a), ids)) / len(list_distinct(a))), 6) AS recall,
round(max(coalesce(1.0::DOUBLE / list_min(list_filter(list_transform(a, lambda x: coalesce(list_position(ids, x), 0)), lambda p: p > 0)), 0)), 6) AS rr, bool_or(list_has_all(ids, a)) AS in_context FROM j GROUP BY ALL)"""


@plan(f"SELECT query_id, hit, recall, rr, in_context FROM {_RES}")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "eval_sample")
    ids = e.select(F.col("seed_family_id").alias("fam"), F.explode_outer(F.flatten("gold_chunk_ids")).alias("x")).groupBy("fam").agg(F.array_sort(F.collect_set("x")).alias("ids"))
    g = e.select(F.col("sample_id").alias("query_id"), F.col("seed_family_id").alias("fam"), F.col("gold_chunk_ids").alias("gold"))
    return r.retrieval_scores(g.join(ids, "fam").select("query_id", "ids"), g.select("query_id", "gold"))


@plan(f"SELECT category, count(*) AS n, round(avg(hit::INT), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr FROM {_RES} GROUP BY category")
def retrieval_metrics_by_category(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "eval_sample").select(F.col("sample_id").alias("query_id"), "category")
    g = retrieval_metrics(spark, d).join(c, "query_id", "left").groupBy(F.coalesce("category", F.lit("unknown")).alias("category"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"))
