"""Plans of evaluation: rule predictions of the messages against their labels, answers, systems, statistics, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import metrics as m
from tessella.operators import report, resampling, rules, stats
from tessella.operators import text as tx
from tessella.plans.registry import plan, t
from tessella.plans.text_plans import NORM, ROUTES_SQL

CLASSES = ["anamnesis", "booking", "faq", "unsupported"]
#: 0.3, 0.31, ... 0.99
GRID = [round(0.3 + 0.01 * k, 2) for k in range(70)]
_X = "regexp_replace(lower(coalesce(route_domain, '')), '[^\\p{L}\\p{N}]+', '', 'g')"
_NEAR = {k: f"(levenshtein(x, '{k}') <= 1 OR (length(x) = {len(k)} AND list_sort(string_split(x, '')) = [{', '.join(repr(c) for c in sorted(k))}] AND levenshtein(x, '{k}') <= 2))" for k in CLASSES}
_T = "CASE WHEN x = '' THEN NULL WHEN x IN (" + ", ".join(f"'{k}'" for k in CLASSES) + ") THEN x WHEN " + " + ".join(f"{c}::INT" for c in _NEAR.values()) + " = 1 THEN CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in _NEAR.items()) + " END END"
_P = f"""(SELECT row_no, text, seed_id, lower(trim(coalesce(urgency, ''))) AS urgency, lower(trim(coalesce(source, ''))) AS source, lower(trim(coalesce(subtype, ''))) AS subtype, t, route AS p, confidence AS c, (CASE WHEN h_booking > 0 THEN 'booking' ELSE route END) AS p2
FROM (SELECT *, {_T} AS t FROM (SELECT *, {_X} AS x FROM {ROUTES_SQL})) WHERE t IS NOT NULL)"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Rule routes of every message whose label, however written, is one of the classes; others have no label to be held to."""
    h = t(spark, d, "d1_v6_hard_test").repartition(spark.sparkContext.defaultParallelism).withColumn("t", tx.label_of(F.col("route_domain"), CLASSES))
    h = h.where(F.col("t").isNotNull()).withColumn("r", rules.routed(F.col("text")))
    second = rules.routed(F.col("text"), {"booking": rules.ROUTES["booking"]} | {k: v for k, v in rules.ROUTES.items() if k != "booking"})["route"]
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return h.select("row_no", "text", "seed_id", low("urgency").alias("urgency"), low("source").alias("source"), low("subtype").alias("subtype"), "t", F.col("r.route").alias("p"), F.col("r.confidence").alias("c"), second.alias("p2"))


@plan(f"SELECT t AS \"true\", p AS pred, count(*) AS n FROM {_P} GROUP BY ALL")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return m.confusion(predictions(spark, d), "t", "p")


_REP = f"""(WITH x AS {_P}, l AS (SELECT t AS label FROM x UNION SELECT p FROM x),
s AS (SELECT label, (SELECT count(*) FROM x WHERE t = label) AS support, (SELECT count(*) FROM x WHERE p = label) AS predicted, (SELECT count(*) FROM x WHERE t = label AND p = label) AS tp FROM l),
r AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS pr, coalesce(tp / nullif(support, 0), 0) AS rc FROM s)
SELECT label, support, round(pr, 6) AS precision, round(rc, 6) AS recall, round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0), 6) AS f1 FROM r)"""


@plan(f"SELECT * FROM {_REP}")
def class_report(spark: SparkSession, d: str) -> DataFrame:
    return m.class_report(confusion_matrix(spark, d))


@plan(f"""SELECT (SELECT count(*) FROM {_P}) AS n, (SELECT round(avg((t = p)::INT), 6) FROM {_P}) AS accuracy, round(avg(f1), 6) AS macro_f1,
round(avg(CASE WHEN support > 0 THEN recall END), 6) AS balanced_accuracy FROM {_REP}""")
def overall_report(spark: SparkSession, d: str) -> DataFrame:
    return m.overall(confusion_matrix(spark, d))


@plan(f"""SELECT round(avg((p = 'anamnesis')::INT) FILTER (WHERE t = 'anamnesis'), 6) AS recall, round(avg((p = 'faq')::INT) FILTER (WHERE t = 'anamnesis'), 6) AS false_harmless,
round(avg((p = 'anamnesis')::INT) FILTER (WHERE t = 'anamnesis' AND urgency IN ('urgent', 'emergency', 'high')), 6) AS recall_urgent,
count(*) FILTER (WHERE t = 'anamnesis' AND p <> 'anamnesis') AS missed, count(*) FILTER (WHERE t = 'anamnesis' AND p <> 'anamnesis' AND urgency IN ('urgent', 'emergency', 'high')) AS missed_urgent FROM {_P}""")
def safety_report(spark: SparkSession, d: str) -> DataFrame:
    return m.safety(predictions(spark, d), "t", "p", "urgency")


@plan(f"SELECT p AS misrouted_to, count(*) AS n FROM {_P} WHERE t = 'anamnesis' AND p <> 'anamnesis' GROUP BY p")
def misrouted_to(spark: SparkSession, d: str) -> DataFrame:
    return m.misrouted(confusion_matrix(spark, d))


@plan(f"SELECT coalesce(nullif(source, ''), 'unknown') || '->' || t AS transition, count(*) AS total, count(*) FILTER (WHERE t = p) AS correct, round(avg((t = p)::INT), 6) AS accuracy FROM {_P} GROUP BY 1")
def transition_report(spark: SparkSession, d: str) -> DataFrame:
    return m.transitions(predictions(spark, d), "source", "t", "p")


_EDGES = m.edges(10)
_BIN = "CASE " + " ".join(f"WHEN c >= {_EDGES[k]!r}::DOUBLE AND c {'<=' if k == 9 else '<'} {_EDGES[k + 1]!r}::DOUBLE THEN {k}" for k in range(10)) + " END"
_BINS = f"(SELECT bin, count(*) AS n, avg(c) AS conf, avg((t = p)::INT) AS acc FROM (SELECT *, {_BIN} AS bin FROM {_P}) WHERE bin IS NOT NULL GROUP BY bin)"


@plan(f"SELECT bin::INT AS bin, n AS count, round(conf, 6) AS avg_confidence, round(acc, 6) AS avg_accuracy, round(abs(acc - conf), 6) AS gap FROM {_BINS}")
def reliability_table(spark: SparkSession, d: str) -> DataFrame:
    return m.reliability(predictions(spark, d).withColumn("ok", F.col("t") == F.col("p")), "c", "ok")


@plan(f"SELECT round(sum(abs(acc - conf) * n) / sum(n), 6) AS ece FROM {_BINS}")
def ece(spark: SparkSession, d: str) -> DataFrame:
    return m.ece(predictions(spark, d).withColumn("ok", F.col("t") == F.col("p")), "c", "ok")


@plan(f"SELECT k.label, round(avg(pow((CASE WHEN p = k.label THEN c ELSE (1 - c) / 3 END) - (t = k.label)::INT, 2)), 6) AS brier FROM {_P}, (VALUES ('anamnesis'), ('booking'), ('faq'), ('unsupported')) k(label) GROUP BY 1")
def brier_ovr(spark: SparkSession, d: str) -> DataFrame:
    proba = F.array(*[F.when(F.col("p") == c, F.col("c")).otherwise((1 - F.col("c")) / 3) for c in CLASSES])
    return m.brier(predictions(spark, d).withColumn("proba", proba), "t", "proba", CLASSES)


_SWEEP = f"""(SELECT th AS threshold, round(count(*) FILTER (WHERE c >= th) / count(*), 6) AS coverage, round(coalesce(count(*) FILTER (WHERE c >= th AND t = p) / nullif(count(*) FILTER (WHERE c >= th), 0), 0), 6) AS accuracy,
round(count(*) FILTER (WHERE c >= th AND t = 'anamnesis' AND p = 'anamnesis') / count(*) FILTER (WHERE t = 'anamnesis'), 6) AS recall,
round(count(*) FILTER (WHERE c >= th AND t = 'anamnesis' AND p = 'faq') / count(*) FILTER (WHERE t = 'anamnesis'), 6) AS false_harmless
FROM {_P}, (SELECT unnest([{', '.join(f'{g}::DOUBLE' for g in GRID)}]) AS th) GROUP BY th)"""


@plan(f"SELECT * FROM {_SWEEP}")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return m.thresholds(predictions(spark, d), "c", "t", "p", GRID)


@plan(f"SELECT * FROM {_SWEEP} a WHERE NOT EXISTS (SELECT 1 FROM {_SWEEP} b WHERE b.recall >= a.recall AND b.false_harmless <= a.false_harmless AND (b.recall > a.recall OR b.false_harmless < a.false_harmless))")
def pareto_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return m.pareto(threshold_sweep(spark, d), "recall", "false_harmless", top=len(GRID))


# Subtypes that tell what an error is about.
_AFTER, _SPECIAL = ("faq_borderline", "procedure_info"), ("booking_with_spec", "booking_with_doctor", "doctor_info")
_RULES = (
    ("anamnesis_to_faq", "t = 'anamnesis' AND p = 'faq'"),
    ("anamnesis_to_booking", "t = 'anamnesis' AND p = 'booking'"),
    ("faq_to_anamnesis", "t = 'faq' AND p = 'anamnesis'"),
    ("mixed_intent_error", "subtype LIKE '%mixed_intent%'"),
    ("post_treatment_ambiguity", f"subtype IN {_AFTER}"),
    ("specialization_confusion", f"subtype IN {_SPECIAL}"),
    ("vague_short_error", "words <= 3"),
    ("both_wrong", "p <> t AND p2 <> t"),
    ("models_disagree_both_wrong", "p <> t AND p2 <> t AND p <> p2"),
)
_WORDS = "len(regexp_extract_all(lower(coalesce(text, '')), '[a-zа-яё0-9]+'))"
_TAGS = " UNION ALL ".join(f"SELECT row_no, '{n}' AS error_type FROM w WHERE {c}" for n, c in _RULES)
_TAX = f"(WITH w AS (SELECT *, {_WORDS} AS words FROM {_P} WHERE t <> p OR t <> p2), g AS ({_TAGS}) SELECT * FROM g UNION ALL SELECT row_no, 'generic_error' FROM w WHERE row_no NOT IN (SELECT row_no FROM g))"


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d).withColumn("words", F.size(tx.tokens(F.col("text"))))
    return m.taxonomy(p, [(n, F.expr(c)) for n, c in _RULES], F.expr("t <> p OR t <> p2"))


@plan(f"SELECT row_no, error_type FROM {_TAX}")
def error_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).select("row_no", "error_type")


@plan(f"SELECT error_type, count(*) AS count, round(100 * count(*) / (SELECT count(DISTINCT row_no) FROM {_TAX}), 4) AS pct, min(row_no) AS example FROM {_TAX} GROUP BY 1")
def taxonomy_summary(spark: SparkSession, d: str) -> DataFrame:
    return m.taxonomy_summary(_tagged(spark, d), "row_no")


_SYS = "(SELECT user_id, count(*) AS n, round(coalesce(quantile_cont(value, 0.5) FILTER (WHERE event_type <> 'error'), 0), 6) AS p50, round(coalesce(quantile_cont(value, 0.95) FILTER (WHERE event_type <> 'error'), 0), 6) AS p95, round(avg((event_type = 'error')::INT), 6) AS fail_rate FROM events GROUP BY user_id)"


@plan(f"SELECT * FROM {_SYS}")
def system_latency(spark: SparkSession, d: str) -> DataFrame:
    return m.system(t(spark, d, "events"), "user_id", "value", F.col("event_type") == "error")


@plan(f"""WITH a AS {_SYS}, b AS (SELECT user_id, round(sum(value), 4) AS spent FROM events WHERE event_type = 'purchase' GROUP BY 1), c AS (SELECT user_id, min(event_id) AS first_signup FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT user_id, n, p50, p95, fail_rate, spent, first_signup FROM a FULL JOIN b USING (user_id) LEFT JOIN c USING (user_id)""")
def summary_full_outer(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    b = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("spent"))
    c = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("first_signup"))
    return m.outer_summary("user_id", [system_latency(spark, d), b], [c])


_LONG = "(SELECT source AS mode, t AS strategy, unnest(['accuracy', 'confidence', 'error']) AS metric, unnest([round(avg((t = p)::INT), 6), round(avg(c), 6), round(avg((t <> p)::INT), 6)]) AS value FROM " + _P + " GROUP BY source, t)"


def long_metrics(spark: SparkSession, d: str) -> DataFrame:
    g = predictions(spark, d).groupBy(F.col("source").alias("mode"), F.col("t").alias("strategy"))
    ok = (F.col("t") == F.col("p")).cast("int")
    w = g.agg(F.round(F.avg(ok), 6).alias("accuracy"), F.round(F.avg("c"), 6).alias("confidence"), F.round(F.avg(1 - ok), 6).alias("error"))
    return w.unpivot(["mode", "strategy"], ["accuracy", "confidence", "error"], "metric", "value")


@plan(f"SELECT *, round(value - max(CASE WHEN mode = 'seed' THEN value END) OVER (PARTITION BY strategy, metric), 6) AS delta FROM {_LONG}")
def metric_deltas(spark: SparkSession, d: str) -> DataFrame:
    return report.deltas(long_metrics(spark, d), "seed")


@plan(f"SELECT mode, first(value) FILTER (WHERE strategy = 'anamnesis') AS anamnesis, first(value) FILTER (WHERE strategy = 'booking') AS booking, first(value) FILTER (WHERE strategy = 'faq') AS faq, first(value) FILTER (WHERE strategy = 'unsupported') AS unsupported FROM {_LONG} WHERE metric = 'accuracy' GROUP BY mode")
def metric_pivot(spark: SparkSession, d: str) -> DataFrame:
    return report.wide(long_metrics(spark, d).where("metric = 'accuracy'"), "mode", "strategy", "value", CLASSES)


_RANKS = f"(SELECT *, rank() OVER (PARTITION BY metric, mode ORDER BY CASE WHEN metric = 'error' THEN value ELSE -value END)::INT AS rank FROM {_LONG})"


@plan(f"SELECT * FROM {_RANKS}")
def metric_ranks(spark: SparkSession, d: str) -> DataFrame:
    return report.ranks(long_metrics(spark, d), ("error",), ("metric", "mode"))


@plan(f"SELECT strategy, count(*) FILTER (WHERE rank = 1) AS firsts, round(avg(rank), 6) AS mean_rank FROM {_RANKS} GROUP BY 1")
def metric_leaders(spark: SparkSession, d: str) -> DataFrame:
    return report.leaders(metric_ranks(spark, d))


@plan(f"SELECT mode, score, rank() OVER (ORDER BY score DESC)::INT AS rank FROM (SELECT mode, round(sum(value * CASE metric WHEN 'accuracy' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END), 4) AS score FROM {_LONG} WHERE strategy = 'anamnesis' AND metric <> 'error' GROUP BY mode)")
def composite_rank(spark: SparkSession, d: str) -> DataFrame:
    return report.composite(long_metrics(spark, d).where("strategy = 'anamnesis'"), {"accuracy": 0.7, "confidence": 0.3})


_GATE = f"""(SELECT *, CASE metric WHEN 'accuracy' THEN 'hit_rate' WHEN 'confidence' THEN 'mrr' ELSE 'avg_fmr' END AS m, round(value - max(CASE WHEN mode = 'seed' THEN value END) OVER (PARTITION BY strategy, metric), 6) AS dl FROM {_LONG})"""


@plan(f"""WITH g AS (SELECT mode, coalesce(bool_or((m = 'hit_rate' AND dl >= 0.02) OR (m = 'mrr' AND dl >= 0.01)), false) AS retrieval_gain, coalesce(bool_or((m = 'hit_rate' AND dl <= -0.02) OR (m = 'mrr' AND dl <= -0.01)), false) AS retrieval_drop,
coalesce(bool_or(m = 'avg_fmr' AND dl >= 0.01), false) AS answer_gain, coalesce(bool_or(m = 'avg_fmr' AND dl < -0.03), false) AS answer_drop FROM (SELECT mode, m, CASE WHEN strategy = 'anamnesis' THEN dl END AS dl FROM {_GATE}) GROUP BY mode)
SELECT mode, CASE WHEN retrieval_drop THEN CASE WHEN answer_gain THEN 'neutral' ELSE 'stop' END WHEN answer_drop THEN CASE WHEN retrieval_gain THEN 'neutral' ELSE 'stop' END WHEN retrieval_gain OR answer_gain THEN 'proceed' ELSE 'neutral' END AS verdict,
retrieval_gain, retrieval_drop, answer_gain, answer_drop FROM g""")
def decision_gate(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, confidence and error of one class stand in for hit rate, MRR and fact match."""
    name = F.when(F.col("metric") == "accuracy", "hit_rate").when(F.col("metric") == "confidence", "mrr").otherwise("avg_fmr")
    return report.gate(metric_deltas(spark, d).withColumn("metric", name), "anamnesis", "mode")


@plan(f"SELECT l.*, round(avg(value) OVER w, 6) AS group_mean, round(stddev_samp(value) OVER w, 6) AS group_std, count(*) OVER w AS n_runs FROM {_LONG} l WINDOW w AS (PARTITION BY strategy, metric)")
def learning_curve_stats(spark: SparkSession, d: str) -> DataFrame:
    return report.group_stats(long_metrics(spark, d), "value", "strategy", "metric").select("mode", "strategy", "metric", "value", "group_mean", "group_std", "n_runs")


@plan(f"SELECT DISTINCT a.source AS a, b.source AS b FROM {_P} a JOIN {_P} b ON a.source < b.source")
def baseline_pairs(spark: SparkSession, d: str) -> DataFrame:
    return report.pairs_of(predictions(spark, d), "source")


@plan("SELECT sample_id, category FROM eval_sample WHERE category NOT IN (SELECT category FROM eval_sample GROUP BY 1 HAVING count(*) < 35)")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "eval_sample").select("sample_id", "category")
    return report.undone(e, e.groupBy("category").count().where("count < 35"), "category")


_FAM = "coalesce(nullif(trim(seed_id), ''), 'row_' || row_no)"
_SEED = "(('0x' || substr(md5({0} || '|42'), 1, 15))::BIGINT % 2147483646 + 1)"
_DRAWS = "a(rep, av) AS (SELECT 1, 48271::BIGINT UNION ALL SELECT rep + 1, av * 48271 % 2147483647 FROM a WHERE rep < 2000)"
_WEIGHT = "CASE " + " ".join(f"WHEN x0 * av % 2147483647 / 2147483647.0::DOUBLE < {c!r}::DOUBLE THEN {k}" for k, c in enumerate(resampling.POISSON)) + " ELSE 8 END"


def _boot_sql(pred: str, name: str) -> str:
    """Values of every metric at every replicate (0: all rows as they are)."""
    return f"""{name}_n AS (SELECT {_SEED.format(_FAM)} AS x0, urgency IN ('urgent', 'emergency', 'high') AS u, t, {pred} AS p, count(*) AS n FROM {_P} GROUP BY ALL),
{name}_w AS (SELECT rep, u, t, p, sum(n * ({_WEIGHT})) AS n FROM {name}_n, a GROUP BY ALL UNION ALL SELECT 0, u, t, p, sum(n) FROM {name}_n GROUP BY ALL),
{name}_l AS (SELECT rep, label, sum(n) FILTER (WHERE t = label AND p = label) AS tp, sum(n) FILTER (WHERE t = label) AS s, sum(n) FILTER (WHERE p = label) AS r FROM {name}_w, (VALUES ('anamnesis'), ('faq'), ('booking'), ('unsupported')) k(label) GROUP BY ALL),
{name}_f AS (SELECT rep, avg(2 * coalesce(tp, 0) / (coalesce(s, 0) + coalesce(r, 0))) AS v FROM {name}_l WHERE coalesce(s, 0) + coalesce(r, 0) > 0 GROUP BY rep),
{name} AS (SELECT rep, 'macro_f1' AS metric, v FROM {name}_f UNION ALL SELECT rep, unnest(['accuracy', 'recall_anamnesis', 'recall_urgent']), unnest([sum(n) FILTER (WHERE t = p) / sum(n), coalesce(sum(n) FILTER (WHERE t = 'anamnesis' AND p = t) / nullif(sum(n) FILTER (WHERE t = 'anamnesis'), 0), 0),
coalesce(sum(n) FILTER (WHERE u AND p = 'anamnesis') / nullif(sum(n) FILTER (WHERE u), 0), 0)]) FROM {name}_w GROUP BY rep)"""


def _family():
    return F.coalesce(F.nullif(F.trim("seed_id"), F.lit("")), F.concat(F.lit("row_"), F.col("row_no").cast("string")))


_CI = "round(max(v) FILTER (WHERE rep = 0), 6) AS point, round(quantile_cont(v, 0.025) FILTER (WHERE rep > 0), 6) AS low, round(quantile_cont(v, 0.975) FILTER (WHERE rep > 0), 6) AS high"


@plan(f"WITH RECURSIVE {_DRAWS}, {_boot_sql('p', 'b')} SELECT metric, {_CI} FROM b GROUP BY metric")
def family_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Percentile intervals of every metric from 2,000 replicates."""
    return resampling.family_bootstrap(predictions(spark, d), _family(), "t", "p", "urgency", bca=False).select("metric", "point", "low", "high")


@plan()
def family_bootstrap_bca(spark: SparkSession, d: str) -> DataFrame:
    return resampling.family_bootstrap(predictions(spark, d), _family(), "t", "p", "urgency")


@plan(f"""WITH RECURSIVE {_DRAWS}, {_boot_sql('p', 'b')}, {_boot_sql('p2', 'e')}, x AS (SELECT rep, metric, b.v - e.v AS v FROM b JOIN e USING (rep, metric)), y AS (SELECT metric, max(v) FILTER (WHERE rep = 0) AS delta, avg(v) FILTER (WHERE rep > 0) AS m,
quantile_cont(v, 0.025) FILTER (WHERE rep > 0) AS low, quantile_cont(v, 0.975) FILTER (WHERE rep > 0) AS high, avg((v <= 0)::INT) FILTER (WHERE rep > 0) AS p FROM x GROUP BY metric)
SELECT metric, round(delta, 6) AS delta, round(m, 6) AS delta_mean, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p_value, low > 0 OR high < 0 AS significant FROM y""")
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return resampling.paired_bootstrap(predictions(spark, d), _family(), "t", "p", "p2", "urgency")


@plan(f"SELECT count(*) FILTER (WHERE t = p AND t <> p2) AS b, count(*) FILTER (WHERE t <> p AND t = p2) AS c FROM {_P}")
def mcnemar_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.discordant(predictions(spark, d), "t", "p", "p2")


@plan("""WITH x AS (SELECT l_quantity - avg_q AS df FROM (SELECT l_quantity, round(avg(l_quantity) OVER (PARTITION BY l_orderkey), 2) AS avg_q FROM lineitem)),
r AS (SELECT df, rank() OVER (ORDER BY abs(df)) + (count(*) OVER (PARTITION BY abs(df)) - 1) / 2.0 AS r FROM x WHERE df <> 0),
s AS (SELECT count(*) AS n, sum(r) FILTER (WHERE df > 0) AS wp, sum(r) FILTER (WHERE df < 0) AS wm FROM r), g AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*) AS c FROM r GROUP BY abs(df)))
SELECT n, round(coalesce(wp, 0), 1)::DOUBLE AS w_plus, round(coalesce(wm, 0), 1)::DOUBLE AS w_minus, ties::BIGINT AS ties,
round((least(wp, wm) - n * (n + 1) / 4.0) / sqrt((n::DOUBLE * (n + 1) * (2 * n + 1) - ties / 2.0) / 24), 5)::DOUBLE AS z FROM s, g""")
def wilcoxon_ranks(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem")
    a = li.groupBy("l_orderkey").agg(F.round(F.avg("l_quantity"), 2).alias("a"))
    s = stats.signed_ranks(li.join(a, "l_orderkey").select((F.col("l_quantity") - F.col("a")).alias("df")), "df")
    z = stats.wilcoxon_z(F.col("n").cast("double"), F.col("w_plus"), F.col("w_minus"), F.col("ties"))
    return s.select("n", F.round("w_plus", 1).alias("w_plus"), F.round("w_minus", 1).alias("w_minus"), "ties", F.round(z, 5).alias("z"))


@plan("""WITH v AS (SELECT user_id, event_type, round(avg(value), 0) AS v FROM events GROUP BY ALL), f AS (SELECT * FROM v WHERE user_id IN (SELECT user_id FROM v GROUP BY 1 HAVING count(*) = 5)),
r AS (SELECT event_type, rank() OVER (PARTITION BY user_id ORDER BY v) + (count(*) OVER (PARTITION BY user_id, v) - 1) / 2.0 AS r FROM f), s AS (SELECT event_type, sum(r) AS s, count(*) AS n FROM r GROUP BY 1),
g AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*) AS c FROM f GROUP BY user_id, v)), x AS (SELECT max(n) AS n, count(*) AS k, sum(s * s) AS s2 FROM s),
c AS (SELECT n, k, round(((12.0 / (n * k * (k + 1)) * s2 - 3 * n * (k + 1)) / (1 - ties / (k * (k * k - 1) * n)::DOUBLE))::DOUBLE, 6) AS chi2 FROM x, g)
SELECT n AS blocks, k AS treatments, chi2, round(exp(-chi2 / 2) * (1 + chi2 / 2), 9) AS p_value FROM c""")
def friedman_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Five treatments, so the tail of four degrees of freedom has a closed form for the oracle."""
    v = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 0).alias("v"))
    full = v.groupBy("user_id").count().where("count = 5").select("user_id")
    return stats.friedman(v.join(full, "user_id"), "user_id", "event_type", "v")


@plan("""SELECT round((avg(value) FILTER (WHERE event_type = 'click') - avg(value) FILTER (WHERE event_type = 'view')) / sqrt(((count(*) FILTER (WHERE event_type = 'click') - 1) * var_samp(value) FILTER (WHERE event_type = 'click')
+ (count(*) FILTER (WHERE event_type = 'view') - 1) * var_samp(value) FILTER (WHERE event_type = 'view')) / (count(*) FILTER (WHERE event_type IN ('click', 'view')) - 2)), 6) AS d FROM events""")
def cohens_d(spark: SparkSession, d: str) -> DataFrame:
    return stats.cohens_d(t(spark, d, "events"), "event_type", "value", "click", "view")


@plan("""WITH p AS (SELECT c_mktsegment, least(1, round(avg(c_acctbal) / 200000, 9)) AS p FROM customer GROUP BY 1), x AS (SELECT *, least(1, p * (count(*) OVER () - row_number() OVER (ORDER BY p, c_mktsegment) + 1)) AS x FROM p)
SELECT c_mktsegment, p, round(max(x) OVER (ORDER BY p, c_mktsegment ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM x""")
def holm_adjusted(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "customer").groupBy("c_mktsegment").agg(F.least(F.lit(1.0), F.round(F.avg("c_acctbal") / 200000, 9)).alias("p"))
    return stats.holm(p, "p", "c_mktsegment")


_SIG = """(SELECT user_id AS k, event_type AS mode, unnest(['mean', 'bought']) AS metric, unnest([round(avg(value), 6), (max(value) > 150)::INT]) AS v FROM events GROUP BY user_id, event_type)"""
_MODES = ["view", "click", "purchase"]


def _marks(spark: SparkSession, d: str) -> DataFrame:
    g = t(spark, d, "events").groupBy(F.col("user_id").alias("k"), F.col("event_type").alias("mode")).agg(F.round(F.avg("value"), 6).alias("mean"), (F.max("value") > 150).cast("double").alias("bought"))
    return g.unpivot(["k", "mode"], ["mean", "bought"], "metric", "v")


_SIG_N = f"(SELECT * FROM {_SIG} WHERE mode IN ('view', 'click', 'purchase') QUALIFY count(*) OVER (PARTITION BY k, metric) = 3)"


@plan(f"""WITH RECURSIVE {_DRAWS}, s AS (SELECT *, {_SEED.format('k::VARCHAR')} AS x0 FROM {_SIG_N}), w AS (SELECT metric, mode, rep, sum(v * ({_WEIGHT})) / sum({_WEIGHT}) AS v FROM s, a GROUP BY ALL UNION ALL SELECT metric, mode, 0, avg(v) FROM s GROUP BY ALL),
x AS (SELECT w.metric, w.mode, w.rep, w.v, w.v - b.v AS dv FROM w JOIN w b ON b.mode = 'view' AND b.metric = w.metric AND b.rep = w.rep)
SELECT metric, mode, (SELECT count(*) FROM s WHERE s.metric = x.metric AND s.mode = x.mode) AS n, round(max(v) FILTER (WHERE rep = 0), 6) AS mean, round(quantile_cont(v, 0.025) FILTER (WHERE rep > 0), 6) AS low, round(quantile_cont(v, 0.975) FILTER (WHERE rep > 0), 6) AS high,
round(max(dv) FILTER (WHERE rep = 0), 6) AS diff, round(quantile_cont(dv, 0.025) FILTER (WHERE rep > 0), 6) AS diff_low, round(quantile_cont(dv, 0.975) FILTER (WHERE rep > 0), 6) AS diff_high,
mode <> 'view' AND (quantile_cont(dv, 0.025) FILTER (WHERE rep > 0) > 0 OR quantile_cont(dv, 0.975) FILTER (WHERE rep > 0) < 0) AS significant FROM x GROUP BY metric, mode""")
def significance_table(spark: SparkSession, d: str) -> DataFrame:
    """Means, intervals and differences to a base mode over keys that all modes have, from 2,000 replicates."""
    return stats.significance(_marks(spark, d), "k", "mode", "metric", "v", _MODES, "view", ("bought",)).drop("p_value", "test")


@plan(f"""WITH s AS (SELECT k, mode, v FROM {_SIG} WHERE metric = 'mean'), p AS (SELECT a.mode AS a, b.mode AS b, a.v AS x, b.v AS y FROM s a JOIN s b USING (k) WHERE (a.mode, b.mode) IN (('click', 'view'), ('purchase', 'view')))
SELECT a, b, count(*) AS n, round(avg(x), 6) AS mean_a, round(avg(y), 6) AS mean_b, round(avg(x) - avg(y), 6) AS diff, round((avg(x) - avg(y)) / sqrt((var_samp(x) + var_samp(y)) / 2), 6) AS effect_d FROM p GROUP BY a, b""")
def paired_analysis(spark: SparkSession, d: str) -> DataFrame:
    """The test's p values are checked by hand-worked tests; here the figures SQL can say."""
    r = stats.paired_analysis(_marks(spark, d).where("metric = 'mean'"), "k", "mode", "v", [("click", "view"), ("purchase", "view")])
    return r.select("a", "b", "n", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "diff", "effect_d")])
