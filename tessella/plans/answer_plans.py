"""Plans of answers: claim support, audits, context order, scale-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import answers, evaluation
from tessella.operators import metrics as m
from tessella.operators import text as tx
from tessella.plans.registry import plan, t
from tessella.plans.text_plans import _CLAIMS

_E = _CLAIMS.replace("doc_id", "sample_id").replace("coalesce(text, '')", "coalesce(expected_answer, '')").replace("FROM documents", "FROM eval_sample")
_B = r"[\s\p{Z}]"
_SQ = "trim(regexp_replace(lower(coalesce({0}, '')), '[\\s\\p{{Z}}]+', ' ', 'g'))"
_D = "regexp_replace({0}, '[^0-9]', '', 'g')"
_J = "regexp_replace({0}, '([0-9])[\\s\\p{{Z}}]+([0-9])', '\\1\\2', 'g')"
# what a claim (claim, c squeezed) is looked for by, and whether a text (k squeezed, kd its digits, kj closed up) holds it
_FORMS = rf"""claim, {_SQ.format('claim')} AS c, {_D.format('claim')} AS d, regexp_extract({_SQ.format('claim')}, '^([0-9]+){_B}*(?:лет|год|мес|час)', 1) AS num, substr(regexp_extract({_SQ.format('claim')}, '([а-яё]{{4,}})', 1), 1, 4) AS st,
regexp_replace(regexp_replace({_SQ.format('claim')}, '^https?://', ''), '/+$', '') AS url, CASE WHEN regexp_matches(claim, '[0-9\s\p{{Z}}]+₽') THEN regexp_replace(claim, '{_B}|от|₽', '', 'g') ELSE '' END AS pr"""
_HOLDS = "(c = '' OR contains(k, c) OR (length(d) >= 7 AND contains(kd, d)) OR (num <> '' AND contains(k, num)) OR (st <> '' AND contains(k, st)) OR (c LIKE 'http%' AND contains(regexp_replace(k, 'https?://', '', 'g'), url)) OR (pr <> '' AND contains(kj, pr)))"


@plan(f"""WITH c AS ({_E}), j AS (SELECT sample_id, {_FORMS}, {_SQ.format('query')} AS k, {_D.format("coalesce(query, '')")} AS kd, {_J.format("coalesce(query, '')")} AS kj FROM c JOIN eval_sample USING (sample_id))
SELECT sample_id, count(*) AS claims, round(avg({_HOLDS}::INT), 6) AS supported FROM j GROUP BY 1""")
def claim_support(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "eval_sample")
    c = tx.claims(e.select("sample_id", "expected_answer"), "expected_answer").select("sample_id", "claim")
    return answers.support_rate(c, e, "sample_id", "sample_id", "query")


# Three strategies made from the eval set: its own answers, its queries echoed, and the first half of each answer.
_RESULTS = """(SELECT sample_id, s.strategy_id, CASE s.strategy_id WHEN 'S1' THEN coalesce(expected_answer, '') WHEN 'S2' THEN coalesce(query, '') ELSE substr(coalesce(expected_answer, ''), 1, (length(coalesce(expected_answer, '')) // 2)::INT) END AS answer,
CASE s.strategy_id WHEN 'S2' THEN NOT answerable ELSE answerable END AS answerable, CASE s.strategy_id WHEN 'S1' THEN expected_doctor WHEN 'S2' THEN ' ' || upper(expected_doctor) END AS doctor,
CASE s.strategy_id WHEN 'S3' THEN NULL ELSE expected_specialization END AS specialization, expected_branch AS branch, CASE s.strategy_id WHEN 'S1' THEN expected_service END AS service, difficulty * 10 + length(query) AS latency_ms,
length(query) AS tokens_prompt, length(coalesce(expected_answer, '')) AS tokens_completion, length(coalesce(notes, '')) AS context_length, CASE difficulty WHEN 1 THEN 'direct' WHEN 2 THEN 'fallback' END AS route_taken,
CASE WHEN s.strategy_id = 'S3' AND difficulty = 3 THEN 'timeout' END AS error FROM eval_sample, (VALUES ('S1'), ('S2'), ('S3')) s(strategy_id))"""


def results(spark: SparkSession, d: str) -> DataFrame:
    e = evaluation.task_grid(t(spark, d, "eval_sample").select("sample_id"), ["S1", "S2", "S3"]).join(t(spark, d, "eval_sample"), "sample_id")
    s, own = F.col("strategy_id"), F.coalesce("expected_answer", F.lit(""))
    half = F.substring(own, F.lit(1), F.floor(F.length(own) / 2).cast("int"))
    doctor = F.when(s == "S1", F.col("expected_doctor")).when(s == "S2", F.concat(F.lit(" "), F.upper("expected_doctor")))
    return e.select(
        "sample_id", "strategy_id", F.when(s == "S1", own).when(s == "S2", F.coalesce("query", F.lit(""))).otherwise(half).alias("answer"), F.when(s == "S2", ~F.col("answerable")).otherwise(F.col("answerable")).alias("answerable"),
        doctor.alias("doctor"), F.when(s != "S3", F.col("expected_specialization")).alias("specialization"), F.col("expected_branch").alias("branch"), F.when(s == "S1", F.col("expected_service")).alias("service"),
        (F.col("difficulty") * 10 + F.length("query")).alias("latency_ms"), F.length("query").alias("tokens_prompt"), F.length(own).alias("tokens_completion"), F.length(F.coalesce("notes", F.lit(""))).alias("context_length"),
        F.when(F.col("difficulty") == 1, "direct").when(F.col("difficulty") == 2, "fallback").alias("route_taken"), F.when((s == "S3") & (F.col("difficulty") == 3), "timeout").alias("error"),
    )


_AW = "trim(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
_STREET = "(^|[^\\p{{L}}\\p{{N}}_])(?:" + "|".join(tx.STREET_WORDS) + ")[.][\\s\\p{{Z}}]*"
_ADDR = "lower({0})"
for _ in range(3):  # a street word may begin where the last one ends
    _ADDR = f"regexp_replace({_ADDR}, '{_STREET}', '\\1', 'g')"
_ADDR = f"trim(regexp_replace({_ADDR}, '[,.\\s\\p{{{{Z}}}}]+', ' ', 'g'))"
_DAYS = "{{" + ", ".join(f"'{k}': {list(v)}" for k, v in tx.DAYS.items()) + "}}"
_HOUR = "'(^|[^\\p{{L}}\\p{{N}}_])([0-9]{{1,2}}):00([^\\p{{L}}\\p{{N}}_]|$)', '\\1\\2\\3', 'g'"
_LOW = f"regexp_replace(regexp_replace(lower({{0}}), {_HOUR}), {_HOUR})"
_SCHED = f"list_concat(flatten(list_transform(list_filter(regexp_extract_all(lower({{0}}), '[\\p{{{{L}}}}\\p{{{{N}}}}_]+'), lambda w: w IN ({', '.join(repr(k) for k in tx.DAYS)})), lambda w: CASE w {' '.join(f'WHEN {k!r} THEN {list(v)}' for k, v in tx.DAYS.items())} END)), list_transform(list_filter(regexp_extract_all({_LOW}, '[\\p{{{{L}}}}\\p{{{{N}}}}_]+'), lambda w: regexp_full_match(w, '[0-9]{{{{1,2}}}}')), lambda w: CASE WHEN ltrim(w, '0') = '' THEN '0' ELSE ltrim(w, '0') END))"
_PHONE = "(CASE WHEN length({0}) = 11 AND {0} LIKE '8%' THEN '7' || substr({0}, 2, 10) ELSE {0} END)"
_SUR = "coalesce(nullif(regexp_extract(lower(trim({0})), '([а-яёa-z]{{3,}})', 1), ''), lower(trim({0})))"


def _fact_sql(rows: str, keys: str) -> str:
    """Facts of ``rows(keys, answer, gold_facts)`` and the share of them held."""
    dg = _D.format("v")
    da = _D.format("a")
    return f"""(WITH f AS (SELECT {keys}, coalesce(answer, '') AS a, unnest(gold_facts) AS f FROM {rows}), v AS (SELECT *, f.fact_type AS k, coalesce(f.canonical_value, '') AS v FROM f),
h AS (SELECT {keys}, CASE k WHEN 'phone' THEN {dg} <> '' AND contains({_PHONE.format(da)}, {_PHONE.format(dg)}) WHEN 'price' THEN {dg} <> '' AND contains({da}, {dg}) WHEN 'schedule' THEN len({_SCHED.format('v')}) > 0 AND list_has_all({_SCHED.format('a')}, {_SCHED.format('v')})
WHEN 'fio' THEN {_SUR.format('v')} <> '' AND contains({_AW.format('a')}, {_SUR.format('v')}) WHEN 'address' THEN {_ADDR.format('v')} <> '' AND contains({_AW.format('a')}, {_ADDR.format('v')}) ELSE {_AW.format('v')} <> '' AND contains({_AW.format('a')}, {_AW.format('v')}) END AS hit FROM v)
SELECT {keys}, count(h.hit) AS facts, round(avg(h.hit::INT), 6) AS fact_match FROM {rows} LEFT JOIN h USING ({keys}) GROUP BY {keys})"""


_OWN = "(SELECT sample_id, expected_answer AS answer, gold_facts FROM eval_sample)"


@plan(f"SELECT * FROM {_fact_sql(_OWN, 'sample_id')}")
def fact_match_rate(spark: SparkSession, d: str) -> DataFrame:
    return m.fact_match(t(spark, d, "eval_sample"), "expected_answer", "gold_facts", "sample_id")


@plan(f"SELECT category, count(*) AS n, round(avg(fact_match), 6) AS fact_match, count(fact_match) AS with_facts FROM {_fact_sql(_OWN, 'sample_id')} JOIN eval_sample USING (sample_id) GROUP BY category")
def answer_checks_by_category(spark: SparkSession, d: str) -> DataFrame:
    f = fact_match_rate(spark, d).join(t(spark, d, "eval_sample").select("sample_id", "category"), "sample_id")
    return f.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("fact_match"), 6).alias("fact_match"), F.count("fact_match").alias("with_facts"))


_CLAIMED = " UNION ALL ".join(f"SELECT sample_id, strategy_id, trim(unnest(regexp_extract_all(answer, '({rx})', 1))) AS claim FROM r" for _, rx in tx.CLAIMS)
_MATCH = ", ".join(f"(coalesce(e.expected_{x}, '') = '' OR coalesce({_SQ.format(f'r.{x}')} = {_SQ.format(f'e.expected_{x}')}, false)) AS {x}_match" for x in evaluation.ENTITIES)
_ROWS = "(SELECT r.sample_id, r.strategy_id, r.answer, e.gold_facts FROM r JOIN eval_sample e USING (sample_id))"
_CHECKS = f"""(WITH r AS (SELECT * FROM {_RESULTS} WHERE error IS NULL), c AS ({_CLAIMED}), kb AS (SELECT {_SQ.format('text')} AS k, {_D.format("coalesce(text, '')")} AS kd, {_J.format("coalesce(text, '')")} AS kj FROM documents),
u AS (SELECT {_FORMS} FROM (SELECT DISTINCT claim FROM c)), s AS (SELECT claim, bool_or({_HOLDS}) AS ok FROM u, kb GROUP BY claim), n AS (SELECT sample_id, strategy_id, count(*) AS total_claims, count(*) FILTER (WHERE NOT ok) AS unsupported_claims FROM c JOIN s USING (claim) GROUP BY ALL),
f AS (SELECT * FROM {_fact_sql(_ROWS, 'sample_id, strategy_id')})
SELECT r.sample_id, r.strategy_id, r.answerable = e.answerable AS answerability_correct, {_MATCH}, f.facts, f.fact_match, coalesce(n.total_claims, 0) AS total_claims, coalesce(n.unsupported_claims, 0) AS unsupported_claims
FROM r JOIN eval_sample e USING (sample_id) JOIN f ON f.sample_id = r.sample_id AND f.strategy_id = r.strategy_id LEFT JOIN n ON n.sample_id = r.sample_id AND n.strategy_id = r.strategy_id)"""


@plan(f"SELECT * FROM {_CHECKS}")
def answer_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every result against its sample, claims against all documents."""
    return evaluation.answer_scores(results(spark, d), t(spark, d, "eval_sample"), t(spark, d, "documents"), "text")


_MEAN = "round(coalesce(avg({0}), 0), 6)"
_RATE = "round(coalesce(avg(({0})::INT), 0), 6)"


@plan(f"""SELECT strategy_id, count(*) AS n_samples, {_RATE.format('answerability_correct')} AS answerability_accuracy, {_MEAN.format('fact_match')} AS fact_match_rate, {', '.join(f"{_RATE.format(f'{x}_match')} AS {x}_match_rate" for x in evaluation.ENTITIES)},
{_MEAN.format('unsupported_claims / nullif(total_claims, 0)')} AS unsupported_claim_rate, sum(total_claims)::BIGINT AS total_claims, sum(unsupported_claims)::BIGINT AS unsupported_claims FROM {_CHECKS} GROUP BY strategy_id""")
def det_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.det_aggregate(answer_checks(spark, d))


_MARK = "least(greatest(coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0)::INT, 0), 10)"


@plan(f"SELECT event_type AS strategy_id, count(*) AS n_samples, {_MEAN.format(_MARK)} AS mean_factual_accuracy, {_MEAN.format('least(value, 10)')} AS mean_completeness, {_RATE.format('user_id % 7 = 0')} AS hallucination_rate FROM events GROUP BY 1")
def judge_aggregate(spark: SparkSession, d: str) -> DataFrame:
    mark = tx.clamped(F.get_json_object("props", "$.k"))
    e = t(spark, d, "events").select(F.col("event_type").alias("strategy_id"), mark.alias("factual_accuracy"), F.least(F.col("value"), F.lit(10.0)).alias("completeness"), (F.col("user_id") % 7 == 0).alias("hallucination"))
    return evaluation.judge_aggregate(e)


@plan(f"""SELECT strategy_id, count(*) AS n_samples, round(coalesce(quantile_cont(latency_ms, 0.5) FILTER (WHERE error IS NULL), 0), 6)::DOUBLE AS latency_p50, round(coalesce(quantile_cont(latency_ms, 0.95) FILTER (WHERE error IS NULL), 0), 6)::DOUBLE AS latency_p95,
round(coalesce(avg(tokens_prompt) FILTER (WHERE error IS NULL), 0), 6) AS mean_tokens_prompt, round(coalesce(avg(tokens_completion) FILTER (WHERE error IS NULL), 0), 6) AS mean_tokens_completion, {_MEAN.format('context_length')} AS mean_context_length, {_RATE.format('error IS NOT NULL')} AS fail_rate FROM {_RESULTS} GROUP BY 1""")
def system_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.system_aggregate(results(spark, d))


_ON = ", ".join(f"round(coalesce(avg({c}) FILTER (WHERE route_taken = '{x}'), 0), 6) AS {n}_{x}" for n, c in (("mean_latency", "latency_ms"), ("mean_tokens", "tokens_prompt + tokens_completion"), ("fmr", "fact_match")) for x in ("direct", "fallback"))
_SHARE = ", ".join(_RATE.format(f"route_taken = '{x}'") + f" AS share_{x}" for x in ("direct", "fallback"))


@plan(f"SELECT strategy_id, count(*) AS n_samples, {_SHARE}, {_ON} FROM {_RESULTS} LEFT JOIN (SELECT sample_id, strategy_id, fact_match FROM {_CHECKS}) USING (sample_id, strategy_id) WHERE coalesce(route_taken, '') <> '' GROUP BY 1")
def route_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.route_metrics(results(spark, d), answer_checks(spark, d))


@plan(f"SELECT e.sample_id, s.strategy_id FROM eval_sample e, (VALUES ('S1'), ('S2'), ('S3')) s(strategy_id) WHERE (e.sample_id, s.strategy_id) NOT IN (SELECT (sample_id, strategy_id) FROM {_RESULTS} WHERE error IS NULL)")
def task_grid(spark: SparkSession, d: str) -> DataFrame:
    """What is left to run: every sample with every strategy, less results without error."""
    return evaluation.task_grid(t(spark, d, "eval_sample"), ["S1", "S2", "S3"], results(spark, d).where("error is null"))


@plan("""WITH p AS (SELECT event_id, event_type, value % 1 AS a, (value * 7) % 1 AS b FROM events), m AS (SELECT event_id, event_type, [round(0.5 * a, 9) + round(0.5 * b, 9), round(0.5 * (1 - a), 9) + round(0.5 * (1 - b), 9)] AS m FROM p),
x AS (SELECT event_id, event_type, CASE WHEN m[1] >= m[2] THEN 'yes' ELSE 'no' END AS pred, greatest(m[1], m[2]) AS top, m[1] AS own FROM m),
y AS (SELECT *, CASE WHEN pred = 'yes' THEN 'ml_agrees' WHEN top < 0.7 THEN 'ml_weak_can_learn' WHEN event_type IN ('click', 'view') THEN 'hard_ml_disagree' WHEN top >= 0.85 THEN 'ml_strong_disagree' ELSE 'ml_borderline' END AS reason FROM x)
SELECT event_id, pred, round(top, 4) AS conf, round(own, 4) AS gold_conf, CASE reason WHEN 'ml_strong_disagree' THEN 'reject' WHEN 'ml_borderline' THEN 'flag' ELSE 'accept' END AS decision, reason FROM y""")
def auto_audit(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("event_id", "event_type", (F.col("value") % 1).alias("a"), (F.col("value") * 7 % 1).alias("b"))
    two = lambda c: F.array(2 * F.round(0.5 * F.col(c), 9), 2 * F.round(0.5 * (1 - F.col(c)), 9))
    scenario = F.when(F.col("event_type") == "click", "hard").when(F.col("event_type") == "view", "short").otherwise("clean")
    return e.select("event_id", answers.audited(two("a"), two("b"), ["yes", "no"], F.lit("yes"), scenario).alias("x")).select("event_id", "x.*")


@plan("WITH g AS (SELECT user_id, event_type, round(avg(value), 6) AS v FROM events GROUP BY user_id, event_type) SELECT user_id, event_type AS best FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_type) = 1")
def best_schema(spark: SparkSession, d: str) -> DataFrame:
    g = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("v"))
    return answers.best_of(g, "user_id", "event_type", "v")


@plan("""SELECT doc_id AS chunk_id, 1.0::DOUBLE AS score, row_number() OVER (ORDER BY CASE source_type WHEN 'clinic_info' THEN 1 WHEN 'doctors' THEN 2 ELSE 99 END, coalesce(entity_id, ''), doc_id) AS place FROM documents""")
def full_context(spark: SparkSession, d: str) -> DataFrame:
    doc = t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source_type").alias("kind"), "entity_id")
    return answers.full_context(doc, ["clinic_info", "doctors"])


@plan()
def scaled_corpus(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), tx.word_count(F.col("p_name")).alias("tokens"))
    return answers.scaled(p, "tokens", 2 * p.count() * 2 + 7)


@plan("SELECT sample_id, md5(lower(trim(query))) AS query_md5 FROM eval_sample")
def json_repair(spark: SparkSession, d: str) -> DataFrame:
    """Queries wrapped in broken JSON and got back."""
    e = t(spark, d, "eval_sample").select("sample_id", F.concat(F.lit("so: "), F.regexp_replace(F.to_json(F.struct("query")), r"\}$", "")).alias("raw"))
    r = answers.repaired(e, "raw")
    return r.select("sample_id", F.md5(F.lower(F.trim(F.get_json_object("json", "$.query"))).cast("binary")).alias("query_md5"))
