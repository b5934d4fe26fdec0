"""Plans of smaller operators: cleaning, resolving, blocks of reports, samples, pipelines, curves, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import chunking, evaluation, ml, resampling, retrieval, splits
from tessella.operators import text as tx
from tessella.plans import answer_plans, eval_plans, retrieval_plans
from tessella.plans.registry import plan, t
from tessella.plans.text_plans import NORM

_CLEAN = "coalesce(text, '')"
for _junk in tx.JUNK:
    _CLEAN = f"regexp_replace({_CLEAN}, '(?ms){_junk}', '', 'g')"
_CLEAN = f"regexp_replace(regexp_replace(regexp_replace({_CLEAN}, '\\t', ' ', 'g'), '[○●■]\\s*', '• ', 'g'), '([0-9]+\\.)\\s{{2,}}', '\\1 ', 'g')".replace("{{", "{").replace("}}", "}")
_CLEAN = f"trim(regexp_replace(regexp_replace(regexp_replace({_CLEAN}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\.\\s*\\n', ''), '^\\s+|\\s+$', '', 'g'))"


@plan(f"SELECT doc_id, md5({_CLEAN}) AS clean_md5 FROM documents")
def text_cleaning(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.md5(tx.cleaned(F.col("text")).cast("binary")).alias("clean_md5"))


@plan("SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS spoken FROM events")
def nl_serialise(spark: SparkSession, d: str) -> DataFrame:
    return tx.with_spoken(t(spark, d, "events").select("event_id", "props"), "props").select("event_id", "spoken")


@plan("""WITH n AS (SELECT DISTINCT expected_doctor AS doctor, substr(lower(string_split_regex(trim(expected_doctor), '\\s+')[1]), 1, 4) AS s FROM eval_sample WHERE length(string_split_regex(trim(expected_doctor), '\\s+')[1]) >= 4),
w AS (SELECT sample_id, unnest(regexp_extract_all(lower(coalesce(expected_answer, '')), '[а-яё]+')) AS w FROM eval_sample) SELECT DISTINCT sample_id, doctor FROM w JOIN n ON length(w) >= 4 AND substr(w, 1, 4) = s""")
def surname_resolver(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "eval_sample").withColumnRenamed("expected_doctor", "doctor")
    return tx.resolved(e, e.where("doctor is not null"), "sample_id", "expected_answer", "doctor")


@plan(f"SELECT strategy_id, count(*) AS n, count(*) FILTER (WHERE answerable) AS answerable_true, round(coalesce(sum(latency_ms), 0) / count(*), 0)::DOUBLE AS avg_latency_ms FROM {answer_plans._RESULTS} WHERE error IS NULL GROUP BY 1")
def quality_block(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.quality_block(answer_plans.results(spark, d))


@plan(f"""SELECT strategy_id, count(*) AS n, count(*) FILTER (WHERE answerability_correct) AS answerability_correct, count(*) FILTER (WHERE coalesce(expected_doctor, '') <> '' AND doctor_match) AS doctor_match, count(*) FILTER (WHERE coalesce(expected_doctor, '') <> '') AS doctor_total,
round(avg(fact_match), 4) AS avg_fmr, count(fact_match) AS fmr_annotated, sum(unsupported_claims)::BIGINT AS unsupported_claims, sum(total_claims)::BIGINT AS total_claims FROM {answer_plans._CHECKS} JOIN eval_sample USING (sample_id) GROUP BY 1""")
def det_block(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.det_block(answer_plans.answer_checks(spark, d), t(spark, d, "eval_sample"))


@plan("SELECT category, count(*) AS n, count(*) FILTER (WHERE len(flatten(gold_chunk_ids)) > 0) AS with_gold, sum(coalesce(len(gold_chunk_ids), 0))::BIGINT AS alternatives FROM eval_sample GROUP BY 1")
def gold_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "eval_sample")
    return evaluation.gold_coverage(e, e.select(F.lit("").alias("chunk_id")))[0]


@plan("SELECT g AS chunk_id, count(*) AS samples FROM (SELECT DISTINCT sample_id, unnest(flatten(gold_chunk_ids)) AS g FROM eval_sample) WHERE g NOT IN (SELECT entity_id FROM documents WHERE entity_id IS NOT NULL) GROUP BY 1")
def gold_unknown(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "documents").where("entity_id is not null").select(F.col("entity_id").alias("chunk_id"))
    return evaluation.gold_coverage(t(spark, d, "eval_sample"), c)[1]


@plan("WITH m AS (SELECT event_type, round(avg(value), 6) AS m FROM events GROUP BY 1), k AS (SELECT user_id, max(value) AS v FROM events GROUP BY 1) SELECT (SELECT event_type FROM m ORDER BY m DESC, event_type LIMIT 1) AS leader, (SELECT event_type FROM m ORDER BY m, event_type LIMIT 1) AS weakest, (SELECT round(avg(v), 6) FROM k) AS upper_bound")
def leader_and_bound(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.upper_bound(t(spark, d, "events"), "user_id", "event_type", "value")


@plan(f"""SELECT event_id, CASE WHEN event_type = 'view' THEN 0 ELSE {answer_plans._MARK} END AS accuracy, CASE WHEN event_type = 'view' THEN 0 ELSE least(user_id % 13, 10)::INT END AS fulness FROM events""")
def judge_parse(spark: SparkSession, d: str) -> DataFrame:
    """Marks as a judge's JSON; for one kind of event an axis is missing."""
    full = F.when(F.col("event_type") != "view", F.col("user_id") % 13)
    j = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("accuracy"), full.alias("fulness")))
    return t(spark, d, "events").select("event_id", evaluation.judged(j, ("accuracy", "fulness")).alias("j")).select("event_id", "j.*")


@plan(f"WITH g AS (SELECT t AS label, count(*) AS n FROM {eval_plans._P} GROUP BY 1) SELECT label, n, round(n / sum(n) OVER (), 6) AS share, n / sum(n) OVER () < 0.05 AS low FROM g")
def label_balance(spark: SparkSession, d: str) -> DataFrame:
    h = t(spark, d, "d1_v6_hard_test").select(tx.label_of(F.col("route_domain"), eval_plans.CLASSES).alias("label")).where("label is not null")
    return splits.balance(h, "label")


@plan(f"SELECT row_no FROM {eval_plans._P} WHERE t = 'anamnesis' AND urgency IN ('urgent', 'emergency')")
def safety_subset(spark: SparkSession, d: str) -> DataFrame:
    return splits.safety_subset(t(spark, d, "d1_v6_hard_test"), tx.label_of(F.col("route_domain"), eval_plans.CLASSES), F.col("urgency")).select("row_no")


@plan(f"SELECT row_no, error_type, '' AS verdict FROM {eval_plans._TAX} ORDER BY md5(row_no || '|42'), row_no, error_type LIMIT 100")
def audit_sample(spark: SparkSession, d: str) -> DataFrame:
    """A hundred tagged errors for people to look at: a sampling operator. A row's tags share its draw, the first by name count first."""
    tagged = eval_plans.error_taxonomy(spark, d)
    return tagged.orderBy(splits.lot(F.col("row_no"), 42), "row_no", "error_type").limit(100).withColumn("verdict", F.lit(""))


@plan("SELECT c_custkey, '' AS verdict FROM customer ORDER BY md5(c_custkey || '|7'), c_custkey LIMIT 40")
def random_sample(spark: SparkSession, d: str) -> DataFrame:
    return splits.audit_sample(t(spark, d, "customer").select("c_custkey"), "c_custkey", 40, ("verdict",), 7)


def _marked():
    return F.coalesce(F.lower("text"), F.lit("")).rlike("перлофенз|гимлорексин")


def _pipeline(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = t(spark, d, "d1_v6_train").select("row_no", "text", F.coalesce("seed_id", F.lit("")).alias("family"), tx.label_of(F.col("route_domain"), eval_plans.CLASSES).alias("label"), "source")
    return rows, splits.split_pipeline(rows, "row_no", "family", "label", "text", F.col("label").isNull(), _marked())


_N = NORM.format("text")
_MARK = "regexp_matches(lower(coalesce(text, '')), 'перлофенз|гимлорексин')"
_LABEL = f"(SELECT row_no, text, coalesce(seed_id, '') AS family, {eval_plans._T} AS label FROM (SELECT *, {eval_plans._X} AS x FROM d1_v6_train))"


def _held_sql(rows: str, share: float, seed: int) -> str:
    return f"""(WITH f AS (SELECT family, arg_min(coalesce(label, ''), row_no) AS st FROM {rows} WHERE trim(family) <> '' GROUP BY 1)
SELECT family FROM f QUALIFY row_number() OVER (PARTITION BY st ORDER BY md5(family || '|{seed}'), family) <= greatest(1, round_even(count(*) OVER (PARTITION BY st) * {share}, 0)::BIGINT))"""


_SPLIT = f"""a AS MATERIALIZED (SELECT * FROM {_LABEL}), core AS MATERIALIZED (SELECT * FROM a WHERE label IS NOT NULL), mk AS (SELECT DISTINCT family FROM core WHERE {_MARK}), rest AS MATERIALIZED (SELECT * FROM core WHERE family NOT IN (SELECT family FROM mk)),
th AS MATERIALIZED {_held_sql('rest', 0.2, 42)}, lf AS MATERIALIZED (SELECT * FROM rest WHERE family NOT IN (SELECT family FROM th)), vh AS MATERIALIZED {_held_sql('lf', 0.125, 43)},
dealt AS MATERIALIZED (SELECT row_no, text, CASE WHEN family IN (SELECT family FROM vh) THEN 'val' ELSE 'train' END AS split FROM lf UNION ALL SELECT row_no, text, 'test' FROM core WHERE family IN (SELECT family FROM mk) OR family IN (SELECT family FROM th) UNION ALL SELECT row_no, text, 'extended' FROM a WHERE label IS NULL),
n AS (SELECT *, {_N} AS v, list_position(['test', 'val', 'train', 'extended'], split) AS p FROM dealt), one AS (SELECT * FROM n WHERE split <> 'train' OR row_no = (SELECT min(row_no) FROM n m WHERE m.split = 'train' AND m.v = n.v)), fin AS (SELECT row_no, split FROM one QUALIFY p = min(p) OVER (PARTITION BY v))"""


@plan(f"WITH {_SPLIT} SELECT row_no, split FROM fin")
def split_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return _pipeline(spark, d)[1]


@plan("SELECT 'family' AS kind, 0::BIGINT AS leaks UNION ALL SELECT 'marked', 0")
def split_leaks(spark: SparkSession, d: str) -> DataFrame:
    """A sound pipeline leaks nothing, but for marked rows without a family, which it has none of."""
    rows, split = _pipeline(spark, d)
    return splits.leaks(split, rows, "row_no", "family", _marked())


_CURVE = ", ".join(f"({f}::DOUBLE, {s})" for f in (0.25, 0.5, 1.0) for s in (1, 2))


@plan(f"""WITH tr AS (SELECT coalesce(seed_id, '') AS fam, lower(trim(coalesce(source, ''))) AS f, label FROM (SELECT *, {eval_plans._T} AS label FROM (SELECT *, {eval_plans._X} AS x FROM d1_v6_train)) WHERE label IS NOT NULL),
te AS (SELECT lower(trim(coalesce(source, ''))) AS f, label FROM (SELECT *, {eval_plans._T} AS label FROM (SELECT *, {eval_plans._X} AS x FROM d1_v6_blind_test)) WHERE label IS NOT NULL), g(fraction, seed) AS (VALUES {_CURVE}),
p AS (SELECT g.*, tr.* FROM g JOIN tr ON fraction >= 1 OR ('0x' || substr(md5(fam || '|' || seed), 1, 8))::BIGINT / 4294967296.0::DOUBLE < fraction), c AS (SELECT fraction, seed, f, label, count(*) AS n FROM p GROUP BY ALL),
b AS (SELECT fraction, seed, f, label AS pred FROM c QUALIFY row_number() OVER (PARTITION BY fraction, seed, f ORDER BY n DESC, label) = 1), s AS (SELECT fraction, seed, count(*) AS train_rows, count(DISTINCT fam) AS train_families FROM p GROUP BY ALL),
a AS (SELECT g.fraction, g.seed, count(*) AS n, count(*) FILTER (WHERE coalesce(pred, 'anamnesis') = label) AS ok FROM g CROSS JOIN te LEFT JOIN b ON b.fraction = g.fraction AND b.seed = g.seed AND b.f = te.f GROUP BY ALL)
SELECT fraction, seed::INT AS seed, train_rows, train_families, n, round(ok / n, 6) AS accuracy FROM s JOIN a USING (fraction, seed)""")
def learning_curve(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent label of a message's source, learned from growing shares of the seed families."""
    low = F.lower(F.trim(F.coalesce("source", F.lit("")))).alias("f")
    rows = lambda n, *c: t(spark, d, n).select(tx.label_of(F.col("route_domain"), eval_plans.CLASSES).alias("label"), low, *c).where("label is not null")

    def fit(train: DataFrame, test: DataFrame) -> DataFrame:
        best = train.groupBy("f", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("f").agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), F.col("label").alias("l"))).alias("pred"))
        return test.join(best, "f", "left").withColumn("pred", F.coalesce("pred", F.lit("anamnesis")))

    train = rows("d1_v6_train", F.coalesce("seed_id", F.lit("")).alias("fam"))
    c = ml.learning_curve(train, rows("d1_v6_blind_test"), "label", "fam", [0.25, 0.5, 1.0], [1, 2], fit)
    return c.withColumn("accuracy", F.round("accuracy", 6))


@plan("""SELECT event_id, lag(event_type) OVER w AS before, ntile(4) OVER w AS quarter, round(avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rolling, event_id - first_value(event_id) OVER w AS since FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def window_frames(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t(spark, d, "events").select(
        "event_id", F.lag("event_type").over(w).alias("before"), F.ntile(4).over(w).alias("quarter"), F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("rolling"), (F.col("event_id") - F.first("event_id").over(w)).alias("since")
    )


@plan("SELECT event_type, true AS users_close, true AS median_close FROM events GROUP BY 1")
def approx_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Sketches held to exact values: distinct users within 10 %, the median between the 45th and 55th percentile."""
    e = t(spark, d, "events").groupBy("event_type")
    a = e.agg(F.approx_count_distinct("user_id", 0.02).alias("u"), F.countDistinct("user_id").alias("n"), F.percentile_approx("value", 0.5, 10_000).alias("m"), F.percentile("value", F.array(F.lit(0.45), F.lit(0.55))).alias("p"))
    return a.select("event_type", (F.abs(F.col("u") - F.col("n")) <= 0.1 * F.col("n")).alias("users_close"), F.col("m").between(F.col("p")[0], F.col("p")[1]).alias("median_close"))


@plan("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders")
def multi_key_sort(spark: SparkSession, d: str) -> DataFrame:
    """Places in an order of several keys, without one task that sorts all rows."""
    o = t(spark, d, "orders").select("o_orderkey", "o_orderpriority", (-F.col("o_totalprice")).alias("down"))
    return chunking.placed(o, ["o_orderpriority", "down", "o_orderkey"], "place").select("o_orderkey", "place")


@plan("SELECT event_type AS mode, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'purchase') AND user_id IN (SELECT user_id FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1 HAVING count(DISTINCT event_type) = 3) GROUP BY 1")
def paired_alignment(spark: SparkSession, d: str) -> DataFrame:
    a = resampling.aligned(t(spark, d, "events").select("user_id", F.col("event_type").alias("mode")), "user_id", "mode", ["view", "click", "purchase"])
    return a.groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


_PROBA = "pow((CASE WHEN p = k.label THEN c ELSE (1 - c) / 3 END) - (t = k.label)::INT, 2)"


@plan(f"SELECT round(avg(b), 6) AS brier_macro FROM (SELECT k.label, avg({_PROBA}) AS b FROM {eval_plans._P}, (VALUES ('anamnesis'), ('booking'), ('faq'), ('unsupported')) k(label) GROUP BY 1)")
def brier_macro(spark: SparkSession, d: str) -> DataFrame:
    return eval_plans.brier_ovr(spark, d).agg(F.round(F.avg("brier"), 6).alias("brier_macro"))


@plan(f"""WITH a AS (SELECT query_id, list(chunk_id::VARCHAR ORDER BY rank) AS ids FROM {retrieval_plans._bm25_sql('query', 10)} GROUP BY 1), g AS (SELECT query_id, list_slice(ids, 3, 4) AS gold, ids, list_slice(ids, 1, 3) AS kept FROM a WHERE len(ids) >= 4)
SELECT 'S4r' AS strategy_id, count(*) AS n_samples, round(avg(list_has_any(gold, kept)::INT), 6) AS hit_rate, round(avg(len(list_intersect(gold, kept)) / 2), 6) AS mean_recall, round(avg(CASE WHEN list_has_any(gold, kept) THEN 1 / 3 ELSE 0 END), 6) AS mrr, round(avg(list_has_all(kept, gold)::INT), 6) AS gold_in_context_rate,
1.0::DOUBLE AS pre_rerank_hit_rate, 1.0::DOUBLE AS pre_rerank_recall, round(round(avg(list_has_any(gold, kept)::INT), 6) - 1, 6) AS rerank_hit_lift, round(round(avg(len(list_intersect(gold, kept)) / 2), 6) - 1, 6) AS rerank_recall_lift FROM g""")
def retrieval_lift(spark: SparkSession, d: str) -> DataFrame:
    """Ten candidates of which three are kept, the third and fourth being gold."""
    r = retrieval.bm25(retrieval_plans._queries(spark, d), retrieval_plans._chunks(spark, d), 10)
    one = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("c")))), lambda x: x["c"])
    a = r.groupBy("query_id").agg(one.alias("ids")).where(F.size("ids") >= 4)
    gold = a.select("query_id", F.array(F.slice("ids", 3, 2)).alias("gold"))
    score = lambda ids: retrieval.retrieval_scores(a.select("query_id", ids.alias("ids")), gold).withColumn("strategy_id", F.lit("S4r"))
    return evaluation.retrieval_aggregate(score(F.slice("ids", 1, 3)), score(F.col("ids")))


@plan()
def latency_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """The router's time a text, measured: figures differ from run to run."""
    from tessella.operators import rules

    m = ml.latency(lambda x: x.select(rules.routed(F.col("text")).alias("r")), t(spark, d, "d1_v6_blind_test").select("text"), 3)
    return spark.createDataFrame([tuple(m.values())], "ms_per_text double, batch_p95_ms double, n double")

