"""Evaluation of answers: one row a result, then aggregates by strategy. Results are ``(sample_id, strategy_id,
answer, answerable, doctor, specialization, branch, service, error, ...)``, samples the eval set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.answers import support
from tessella.operators.metrics import fact_match, zero
from tessella.operators.text import claims, squeezed

ENTITIES = ("doctor", "specialization", "branch", "service")
_KEY = ["sample_id", "strategy_id"]


def mean(c: Column) -> Column:
    """NULL-safe mean: what is NULL doesn't count, no value gives 0."""
    return F.round(zero(F.avg(c)), 6)


def rate(c: Column) -> Column:
    return mean(c.cast("int"))


def answer_scores(results: DataFrame, samples: DataFrame, kb: DataFrame, kb_text: str) -> DataFrame:
    """Scores of every result without error whose sample is known: answerability, entities (one that isn't expected
    always matches), facts held, and claims that no row of ``kb`` supports."""
    want = samples.select("sample_id", F.col("answerable").alias("_ok"), "gold_facts", *[F.col(f"expected_{e}").alias(f"_{e}") for e in ENTITIES])
    r = results.where("error is null").join(want, "sample_id")
    match = [(F.coalesce(F.col(f"_{e}"), F.lit("")).isin("") | (squeezed(F.col(e)) == squeezed(F.col(f"_{e}")))).alias(f"{e}_match") for e in ENTITIES]
    base = r.select(*_KEY, (F.col("answerable") == F.col("_ok")).alias("answerability_correct"), *match)
    facts = fact_match(r, "answer", "gold_facts", *_KEY)
    said = claims(r.select(*_KEY, "answer"), "answer").select(*_KEY, "claim")
    n = said.join(support(said, kb, kb_text), "claim").groupBy(*_KEY)
    n = n.agg(F.count(F.lit(1)).alias("total_claims"), F.count_if(~F.col("ok")).alias("unsupported_claims"))
    out = base.join(facts, _KEY).join(n, _KEY, "left")
    return out.select(*base.columns, "facts", "fact_match", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_claims", "unsupported_claims")])


def det_aggregate(scores: DataFrame) -> DataFrame:
    """Per strategy: rates of what matched, mean fact match of results with facts, claims and the mean share of unsupported ones among results with any."""
    ucr = F.when(F.col("total_claims") > 0, F.col("unsupported_claims") / F.col("total_claims"))
    return scores.groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("n_samples"),
        rate(F.col("answerability_correct")).alias("answerability_accuracy"),
        mean(F.col("fact_match")).alias("fact_match_rate"),
        *[rate(F.col(f"{e}_match")).alias(f"{e}_match_rate") for e in ENTITIES],
        mean(ucr).alias("unsupported_claim_rate"),
        F.sum("total_claims").alias("total_claims"),
        F.sum("unsupported_claims").alias("unsupported_claims"),
    )


def judge_aggregate(scores: DataFrame) -> DataFrame:
    """Per strategy: mean marks and the share of answers with invented content."""
    return scores.groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("n_samples"),
        mean(F.col("factual_accuracy")).alias("mean_factual_accuracy"),
        mean(F.col("completeness")).alias("mean_completeness"),
        rate(F.col("hallucination")).alias("hallucination_rate"),
    )


def system_aggregate(results: DataFrame) -> DataFrame:
    """Per strategy: latency and tokens of results without error, context of all, share of errors."""
    ok = lambda c: F.when(F.col("error").isNull(), F.col(c).cast("double"))
    at = lambda q: F.round(zero(F.percentile(ok("latency_ms"), F.lit(q))), 6)
    return results.groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("n_samples"),
        at(0.5).alias("latency_p50"),
        at(0.95).alias("latency_p95"),
        mean(ok("tokens_prompt")).alias("mean_tokens_prompt"),
        mean(ok("tokens_completion")).alias("mean_tokens_completion"),
        mean(F.col("context_length")).alias("mean_context_length"),
        rate(F.col("error").isNotNull()).alias("fail_rate"),
    )


def route_metrics(results: DataFrame, scores: DataFrame) -> DataFrame:
    """Per strategy, of results that took a route: shares, latency, tokens and fact match of direct answers and of fallbacks."""
    r = results.where("coalesce(route_taken, '') <> ''").join(scores.select(*_KEY, "fact_match"), _KEY, "left")
    on = lambda route, c: mean(F.when(F.col("route_taken") == route, c))
    tokens = F.col("tokens_prompt") + F.col("tokens_completion")
    each = [("share_{}", lambda x: rate(F.col("route_taken") == x))]
    each += [(n, lambda x, c=c: on(x, c)) for n, c in (("mean_latency_{}", F.col("latency_ms")), ("mean_tokens_{}", tokens), ("fmr_{}", F.col("fact_match")))]
    return r.groupBy("strategy_id").agg(F.count(F.lit(1)).alias("n_samples"), *[f(x).alias(n.format(x)) for n, f in each for x in ("direct", "fallback")])


def task_grid(samples: DataFrame, strategies: list[str], done: DataFrame | None = None) -> DataFrame:
    """Every sample with every strategy of a stated list, less those done."""
    grid = samples.select("sample_id", F.explode(F.array(*[F.lit(s) for s in strategies])).alias("strategy_id"))
    return grid if done is None else grid.join(done.select(*_KEY).distinct(), _KEY, "left_anti")


def quality_block(results: DataFrame) -> DataFrame:
    """Per strategy, results without error: how many, how many called answerable, and mean latency, in which 0 and NULL add nothing but count."""
    r = results.where("error is null").groupBy("strategy_id")
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("answerable")).alias("answerable_true"), F.round(F.coalesce(F.sum("latency_ms"), F.lit(0)) / F.count(F.lit(1)), 0).alias("avg_latency_ms"))


def det_block(scores: DataFrame, samples: DataFrame) -> DataFrame:
    """Per strategy as counts; doctors only among samples that expect one, facts only among those that have some."""
    s = scores.join(samples.select("sample_id", (F.coalesce(F.col("expected_doctor"), F.lit("")) != "").alias("_doctor")), "sample_id")
    return s.groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("answerability_correct").alias("answerability_correct"),
        F.count_if(F.col("_doctor") & F.col("doctor_match")).alias("doctor_match"),
        F.count_if("_doctor").alias("doctor_total"),
        F.round(F.avg("fact_match"), 4).alias("avg_fmr"),
        F.count("fact_match").alias("fmr_annotated"),
        F.sum("unsupported_claims").alias("unsupported_claims"),
        F.sum("total_claims").alias("total_claims"),
    )


def retrieval_aggregate(scores: DataFrame, before: DataFrame) -> DataFrame:
    """Per strategy: means of ``scores`` after reranking, of ``before`` it, and the lift; both ``(strategy_id, query_id, hit, recall, rr, in_context)``."""
    b = before.select("strategy_id", "query_id", F.col("hit").alias("_h"), F.col("recall").alias("_r"))
    g = scores.join(b, ["strategy_id", "query_id"], "left").groupBy("strategy_id")
    pre_hit, pre_recall = mean(F.coalesce(F.col("_h"), F.lit(False)).cast("int")), mean(F.coalesce(F.col("_r"), F.lit(0.0)))
    out = g.agg(F.count(F.lit(1)).alias("n_samples"), rate(F.col("hit")).alias("hit_rate"), mean(F.col("recall")).alias("mean_recall"), mean(F.col("rr")).alias("mrr"), rate(F.col("in_context")).alias("gold_in_context_rate"), pre_hit.alias("pre_rerank_hit_rate"), pre_recall.alias("pre_rerank_recall"))
    return out.withColumn("rerank_hit_lift", F.round(F.col("hit_rate") - F.col("pre_rerank_hit_rate"), 6)).withColumn("rerank_recall_lift", F.round(F.col("mean_recall") - F.col("pre_rerank_recall"), 6))


def gold_coverage(samples: DataFrame, chunks: DataFrame, gold: str = "gold_chunk_ids") -> tuple[DataFrame, DataFrame]:
    """Per category, samples and how many have gold chunks; and gold ids that no chunk has, with the samples that name them."""
    has = F.size(F.flatten(gold)) > 0
    cover = samples.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(has).alias("with_gold"), F.sum(F.coalesce(F.size(gold), F.lit(0))).alias("alternatives"))
    ids = samples.select("sample_id", F.explode(F.flatten(gold)).alias("chunk_id")).distinct()
    return cover, ids.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("samples"))


def upper_bound(scores: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """One row: the best and the weakest name by mean, and the mean of each key's best value, which no choice among names can pass."""
    by = scores.groupBy(name).agg(F.round(F.avg(value), 6).alias("m")).where("m is not null")
    first = lambda d: F.min_by(name, F.struct((d * F.col("m")).alias("m"), F.col(name).alias("n")))
    top = scores.groupBy(key).agg(F.max(value).alias("v")).agg(F.round(F.avg("v"), 6).alias("upper_bound"))
    return by.agg(first(-1).alias("leader"), first(1).alias("weakest")).join(top)


def judged(c: Column, axes: tuple[str, ...]) -> Column:
    """A judge's JSON as marks ``struct<axis: int>``, 0 to 10; if any axis is missing, or it is no JSON, all are 0."""
    from tessella.operators.text import clamped

    raw = {a: F.get_json_object(c, f"$.{a}") for a in axes}
    whole = raw[axes[0]].isNotNull()
    for a in axes[1:]:
        whole = whole & raw[a].isNotNull()
    return F.struct(*[F.when(whole, clamped(raw[a])).otherwise(0).alias(a) for a in axes])
