"""Plans of duplicates, leakage, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import dedup, splits
from tessella.operators import text as tx
from tessella.plans.registry import plan, t
from tessella.plans.text_plans import NORM

_ALL = " UNION ALL ".join(f"SELECT row_no, text, {p} AS p, '{n}' AS split FROM d1_v6_{n}" for p, n in enumerate(("blind_test", "hard_test", "train")))


def _three(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for p, n in enumerate(("blind_test", "hard_test", "train")):
        x = t(spark, d, f"d1_v6_{n}").select("row_no", "text", F.lit(p).alias("p"), F.lit(n).alias("split"))
        out = x if out is None else out.unionByName(x)
    return out


@plan(f"WITH a AS ({_ALL}), n AS (SELECT *, {NORM.format('text')} AS v FROM a) SELECT row_no, split FROM n QUALIFY p = min(p) OVER (PARTITION BY v)")
def priority_cross_split_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.by_priority(_three(spark, d), tx.dedup_norm(F.col("text")), F.col("p")).select("row_no", "split")


@plan(f"SELECT row_no FROM d1_v6_train QUALIFY row_number() OVER (PARTITION BY {NORM.format('text')} ORDER BY row_no) = 1")
def first_occurrence_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_of(t(spark, d, "d1_v6_train").select("row_no", "text"), tx.dedup_norm(F.col("text")), "row_no").select("row_no")


@plan("""SELECT 'seed' AS kind, count(*) AS shared FROM (SELECT seed_id FROM d1_v6_train WHERE coalesce(seed_id, '') <> '' INTERSECT SELECT seed_id FROM d1_v6_hard_test)
UNION ALL SELECT 'text', count(*) FROM (SELECT lower(text) FROM d1_v6_train WHERE coalesce(text, '') <> '' INTERSECT SELECT lower(text) FROM d1_v6_hard_test)""")
def leakage_audit(spark: SparkSession, d: str) -> DataFrame:
    a, b = t(spark, d, "d1_v6_train"), t(spark, d, "d1_v6_hard_test")
    seed = dedup.shared_values(a, b, F.coalesce("seed_id", F.lit(""))).select(F.lit("seed").alias("kind"), "shared")
    return seed.union(dedup.shared_values(a, b, tx.just_lower(F.col("text"))).select(F.lit("text").alias("kind"), "shared"))


_SIM = "round(list_dot_product(l.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6)"


def _vec(spark: SparkSession, d: str, cond: str) -> DataFrame:
    return t(spark, d, "embeddings").where(cond).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@plan(f"WITH s AS (SELECT r.vec_id AS r_id, l.vec_id AS l_id, {_SIM} AS s FROM embeddings l JOIN embeddings r ON l.label < 5 AND r.label >= 5) SELECT r_id, s AS max_sim, l_id FROM s QUALIFY row_number() OVER (PARTITION BY r_id ORDER BY s DESC, l_id) = 1")
def cosine_leakage(spark: SparkSession, d: str) -> DataFrame:
    return dedup.nearest(_vec(spark, d, "label < 5"), _vec(spark, d, "label >= 5"))


@plan(f"""WITH a AS (SELECT r.vec_id AS id, max({_SIM}) AS m FROM embeddings l JOIN embeddings r ON l.label < 3 AND r.label >= 6 GROUP BY 1), b AS (SELECT r.vec_id AS id, max({_SIM}) AS m FROM embeddings l JOIN embeddings r ON l.label BETWEEN 3 AND 5 AND r.label >= 6 GROUP BY 1)
SELECT a.id, concat_ws(',', CASE WHEN a.m >= 0.35 THEN 'hard' END, CASE WHEN b.m >= 0.35 THEN 'train' END) AS reasons FROM a JOIN b USING (id)""")
def anti_contamination(spark: SparkSession, d: str) -> DataFrame:
    right = _vec(spark, d, "label >= 6")
    a = dedup.nearest(_vec(spark, d, "label < 3"), right).select("r_id", F.col("max_sim").alias("a"))
    b = dedup.nearest(_vec(spark, d, "label between 3 and 5"), right).select("r_id", F.col("max_sim").alias("b"))
    return a.join(b, "r_id").select(F.col("r_id").alias("id"), F.concat_ws(",", F.when(F.col("a") >= 0.35, "hard"), F.when(F.col("b") >= 0.35, "train")).alias("reasons"))


@plan(f"""WITH s0 AS (SELECT vec_id, embedding FROM embeddings WHERE label < 4), s1 AS (SELECT * FROM embeddings r WHERE label BETWEEN 4 AND 6 AND NOT EXISTS (SELECT 1 FROM s0 l WHERE {_SIM} >= 0.35)),
k1 AS (SELECT vec_id, embedding FROM s0 UNION ALL SELECT vec_id, embedding FROM s1), s2 AS (SELECT * FROM embeddings r WHERE label > 6 AND NOT EXISTS (SELECT 1 FROM k1 l WHERE {_SIM} >= 0.35))
SELECT vec_id AS id, 0 AS stage FROM s0 UNION ALL SELECT vec_id, 1 FROM s1 UNION ALL SELECT vec_id, 2 FROM s2""")
def cross_split_cosine_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.across_splits([_vec(spark, d, "label < 4"), _vec(spark, d, "label between 4 and 6"), _vec(spark, d, "label > 6")], 0.35)


@plan()
def greedy_cosine_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.greedy(_vec(spark, d, "true"), 0.35)


@plan()
def segment_greedy_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector counts as a seed, its number by hundreds as the seed family."""
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label", F.floor(F.col("vec_id") / 100).alias("family"))
    return dedup.greedy_by_segment(e, "label", 0.3, F.col("id") % 20 == 0, ("family", "label"))


_BR = "round_even({0}, 0)::BIGINT"


@plan(f"""WITH f AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS stratum FROM orders GROUP BY 1), k AS (SELECT *, greatest(1, {_BR.format('count(*) OVER (PARTITION BY stratum) * 0.2')}) AS n,
row_number() OVER (PARTITION BY stratum ORDER BY md5(o_custkey || '|42'), o_custkey) AS k FROM f) SELECT o_custkey, stratum, k <= n AS held FROM k""")
def group_split_d1(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").withColumn("fam", F.col("o_custkey").cast("string"))
    return splits.family_split(o, "fam", "o_orderpriority", "o_orderkey", 0.2).select(F.col("fam").cast("bigint").alias("o_custkey"), "stratum", "held")


@plan(f"""WITH c AS (SELECT o_custkey, o_orderstatus AS c, count(*) AS n FROM orders GROUP BY ALL), f AS (SELECT o_custkey, c AS category FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, c) = 1),
k AS (SELECT *, count(*) OVER (PARTITION BY category) AS n, row_number() OVER (PARTITION BY category ORDER BY md5(o_custkey || '|42'), o_custkey) AS k FROM f)
SELECT o_custkey, category, k <= least(greatest(1, {_BR.format('n * 0.3')}), n - 1) AS held FROM k""")
def group_split_d4(spark: SparkSession, d: str) -> DataFrame:
    return splits.modal_split(t(spark, d, "orders"), "o_custkey", "o_orderstatus", 0.3)


@plan("""WITH s AS (SELECT c_custkey, c_mktsegment AS stratum, md5(c_custkey || '|42') AS l, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || '|42'), c_custkey) AS k FROM customer),
x AS (SELECT *, (k > 50 // (SELECT count(DISTINCT c_mktsegment) FROM customer))::INT AS x FROM s) SELECT c_custkey, stratum FROM x ORDER BY x, l, c_custkey LIMIT 50""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return splits.stratified(t(spark, d, "customer"), "c_custkey", "c_mktsegment", 50)


@plan("""WITH b AS (SELECT sample_id, seed_family_id, category, md5(sample_id || '|42') AS l, row_number() OVER (PARTITION BY category, seed_family_id ORDER BY md5(sample_id || '|42'), sample_id) AS r FROM eval_sample WHERE category IN ('pricing', 'doctor_info')),
k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY (r > 1)::INT, l, sample_id) AS k FROM b) SELECT sample_id, seed_family_id, category FROM k WHERE k <= CASE category WHEN 'pricing' THEN 10 ELSE 15 END""")
def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    return splits.quota_sample(t(spark, d, "eval_sample"), "sample_id", "seed_family_id", "category", {"pricing": 10, "doctor_info": 15})


@plan("""WITH f AS (SELECT seed_family_id AS f FROM eval_sample GROUP BY 1), n AS (SELECT greatest(1, round_even(count(*) * 0.5, 0)::BIGINT) AS n FROM f), k AS (SELECT f FROM f QUALIFY row_number() OVER (ORDER BY md5(coalesce(f, '') || '|42'), f) <= (SELECT n FROM n))
SELECT sample_id, seed_family_id FROM eval_sample WHERE seed_family_id IN (SELECT f FROM k)""")
def family_subsample(spark: SparkSession, d: str) -> DataFrame:
    return splits.family_sample(t(spark, d, "eval_sample"), "seed_family_id", 0.5).select("sample_id", "seed_family_id")


@plan("""SELECT h.row_no, coalesce(nullif(s.route_domain, ''), h.route_domain) AS route_domain, coalesce(nullif(s.subtype, ''), h.subtype) AS subtype, s.id IS NOT NULL AS audited FROM d1_v6_hard_test h LEFT JOIN d1_v6_seeds s ON s.id = h.seed_id""")
def audit_apply(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "d1_v6_seeds").select(F.col("id").alias("seed_id"), F.col("route_domain").alias("rd"), F.col("subtype").alias("st"), F.lit(True).alias("a"))
    h = t(spark, d, "d1_v6_hard_test").join(s, "seed_id", "left")
    over = lambda new, old: F.coalesce(F.nullif(new, F.lit("")), F.col(old)).alias(old)
    return h.select("row_no", over(F.col("rd"), "route_domain"), over(F.col("st"), "subtype"), F.coalesce("a", F.lit(False)).alias("audited"))


@plan("SELECT CASE p WHEN 0 THEN 'blind_test' WHEN 1 THEN 'hard_test' ELSE 'train' END AS split, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (" + _ALL + ") GROUP BY p")
def split_balance(spark: SparkSession, d: str) -> DataFrame:
    c = _three(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("s"))  # one row
    return c.join(F.broadcast(total)).select("split", "n", F.round(F.col("n") / F.col("s"), 6).alias("share"))


@plan()
def tfidf_logistic(spark: SparkSession, d: str) -> DataFrame:
    """Route classifier trained on the train messages, its confusion on the hard ones."""
    from tessella.operators import metrics, ml

    classes = ["anamnesis", "booking", "faq", "unsupported"]
    lab = lambda n: t(spark, d, n).select(tx.label_of(F.col("route_domain"), classes).alias("label"), "text").where("label is not null")
    train = lab("d1_v6_train")
    words = ml.TfIdf().fit(train, "text")
    model = ml.logistic("label", train.count()).fit(words.vectors(train, "text"))
    out = ml.predicted(model, words.vectors(lab("d1_v6_hard_test"), "text"), list(model.stages[0].labels))
    return metrics.confusion(out, "label", "pred")


@plan("""WITH p AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS c FROM p GROUP BY 1),
x AS (SELECT vec_id, c.label AS pred, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS dist FROM embeddings, c)
SELECT vec_id, pred FROM x QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, pred) = 1""")
def centroid_classifier(spark: SparkSession, d: str) -> DataFrame:
    from tessella.operators import ml

    e = t(spark, d, "embeddings")
    return ml.nearest_centroid(e, ml.centroids(e, "embedding", "label"), "embedding", "label", "vec_id")
