"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _m(name: str):
    return importlib.import_module(f"tessella.llm.{name}")


def _overlap(spark: SparkSession, d: str):
    evals = [_t(spark, d, n).select("row_no", "text", "source", F.lit(n).alias("eval_table")) for n in ("d1_v6_hard_test", "d1_v6_blind_test")]
    return _m("overlap").Overlap(_t(spark, d, "d1_v6_train"), evals[0].unionByName(evals[1]), extra=("source", "eval_table"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(spark, d).rows()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlap and coverage per eval table and source."""
    return _overlap(spark, d).report(("eval_table", "source"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _m("groups").shared_groups(_t(spark, d, "d1_v6_hard_test"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every row."""
    targets = _t(spark, d, "sample_targets").select("route_domain").where("route_domain is not null").distinct()
    labels = sorted(r[0] for r in targets.limit(10_001).collect())
    if len(labels) > 10_000:
        raise ValueError("more than 10000 strata")
    return _m("groups").assigned(_t(spark, d, "d1_v6_hard_test"), _t(spark, d, "split_targets"), labels=labels)


def p2_kept(spark: SparkSession, d: str) -> DataFrame:
    """What every assignment must keep: all rows have one split, and no group is parted."""
    a = p2_splits(spark, d)
    whole = a.where("group_seed is not null").groupBy("group_seed").agg(F.countDistinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("parted"))
    return a.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("row_no").alias("different"), F.count_if(F.col("split").isNull()).alias("without")).join(whole)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    s = _m("quota").shortfalls(_t(spark, d, "d1_v6_hard_test"), _t(spark, d, "sample_targets"))
    return s.where("short").select("route_domain", "subtype")


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return _m("quota").drawn(_t(spark, d, "d1_v6_hard_test"), _t(spark, d, "sample_targets"))


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    """What every sample must keep: its size (a fifth, or what the categories' minimums come to if that is more), no row
    twice, and per category no more rows than there are and no fewer than asked for where there are enough."""
    df = _t(spark, d, "d1_v6_hard_test")
    q = _m("quota").shortfalls(_t(spark, d, "d1_v6_hard_test"), _t(spark, d, "sample_targets"))
    got = p3_sample(spark, d).groupBy("route_domain", "subtype").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_no").alias("u"))
    n, least = F.coalesce("n", F.lit(0)), F.least("min_rows", "rows")
    j = q.join(got, ["route_domain", "subtype"], "full")
    fifth = df.agg(F.floor(F.count(F.lit(1)) * 0.2 + 1e-9).alias("_fifth"))  # one row
    size = (F.sum(n) == F.least(F.sum("rows"), F.greatest(F.max("_fifth"), F.sum(least)))).alias("size_kept")
    return j.join(F.broadcast(fifth)).agg(size, F.sum(n - F.coalesce("u", F.lit(0))).alias("repeats"), F.count_if((n > F.coalesce("rows", F.lit(0))) | (n < least) | (n != F.coalesce("quota", F.lit(0)))).alias("broken"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _m("history").turned_away(_t(spark, d, "d1_v6_hard_test"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _m("formatting").copies(_t(spark, d, "d1_v6_hard_test"))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """Each record once, with its number of copies."""
    return _m("formatting").collapsed(_t(spark, d, "d1_v6_hard_test"))


def _packing(spark: SparkSession, d: str) -> DataFrame:
    return _m("packing").containers(_t(spark, d, "documents"), _t(spark, d, "packs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _m("packing").oversize(_packing(spark, d))


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    return _packing(spark, d)


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """What every packing must keep: all tokens of all documents, no container overfull, nothing split that fits."""
    p, packs = _packing(spark, d), _t(spark, d, "packs").select("pack_id", "capacity_tokens")
    fill = p.groupBy("pack_id", "container").agg(F.sum("tokens").alias("n")).join(packs, "pack_id").groupBy("pack_id").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("overfull"))
    doc = p.groupBy("pack_id", "doc_id").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("parts")).join(packs, "pack_id")
    doc = doc.groupBy("pack_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"), F.count_if((F.col("n") <= F.col("capacity_tokens")) & (F.col("parts") > 1)).alias("torn"))
    return doc.join(fill, "pack_id")


def p6_waste(spark: SparkSession, d: str) -> DataFrame:
    """Containers and unused room of each kind."""
    return _m("packing").waste(_packing(spark, d), _t(spark, d, "packs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _m("leaks").leaks(_t(spark, d, "documents"), _t(spark, d, "eval_sample")).select("doc_id", "sample_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _m("sentences").sentences(_t(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_report, p2_found, p2_splits, p2_kept, p3_found, p3_sample, p3_kept, p4_found, p5_found, p5_records, p6_found, p6_packing, p6_kept, p6_waste, p7_found, p8_found)
}
ORACLES: dict[str, str] = {
    "p2_found": r"""
WITH RECURSIVE r AS (SELECT row_no, regexp_extract_all(lower(coalesce(seed_id, '')), '(?:seed[\s_\-№#]*|#\s*|№\s*|^[\s"'']*|[;|+/,]\s*)0*([1-9][0-9]{0,6})', 1) AS s FROM d1_v6_hard_test),
n AS (SELECT row_no, unnest(s)::BIGINT AS v FROM r WHERE len(s) > 0),
e AS (SELECT DISTINCT a.v AS u, b.v AS v FROM n a JOIN n b USING (row_no) WHERE a.v <> b.v),
c(u, v) AS (SELECT u, v FROM e UNION SELECT c.u, e.v FROM c JOIN e ON c.v = e.u),
l AS (SELECT u, least(u, min(v)) AS g FROM c GROUP BY u),
g AS (SELECT DISTINCT row_no, coalesce(g, n.v) AS g FROM n LEFT JOIN l ON l.u = n.v),
k AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1)
SELECT row_no, 'seed_' || lpad(g::VARCHAR, 7, '0') AS group_seed FROM g WHERE g IN (SELECT g FROM k)""",
    "p2_kept": "SELECT count(*) AS rows, count(DISTINCT row_no) AS different, 0::BIGINT AS without, 0::BIGINT AS parted FROM d1_v6_hard_test",
    "p3_found": r"""
WITH v AS (SELECT DISTINCT 'd' AS kind, route_domain AS w FROM sample_targets UNION SELECT DISTINCT 's', subtype FROM sample_targets),
k AS (SELECT kind, w, regexp_replace(lower(w), '[^\p{L}\p{N}]+', '', 'g') AS k FROM v),
l AS (SELECT DISTINCT 'd' AS kind, route_domain AS raw FROM d1_v6_hard_test UNION SELECT DISTINCT 's', subtype FROM d1_v6_hard_test),
x AS (SELECT kind, raw, regexp_replace(lower(coalesce(raw, '')), '[^\p{L}\p{N}]+', '', 'g') AS x FROM l WHERE raw IS NOT NULL),
f AS (SELECT x.kind, raw, w, x = k AS same FROM x JOIN k ON k.kind = x.kind AND x <> '' AND (x = k OR (length(k) >= 4 AND levenshtein(x, k) <= 1)
  OR (length(x) = length(k) AND list_sort(string_split(x, '')) = list_sort(string_split(k, '')) AND levenshtein(x, k) <= 2))),
m AS (SELECT kind, raw, CASE WHEN bool_or(same) THEN min(w) FILTER (WHERE same) WHEN count(*) = 1 THEN min(w) END AS w FROM f GROUP BY kind, raw),
c AS (SELECT a.w AS d, b.w AS s, count(*) AS n FROM d1_v6_hard_test h JOIN m a ON a.kind = 'd' AND a.raw = h.route_domain JOIN m b ON b.kind = 's' AND b.raw = h.subtype GROUP BY ALL),
z AS (SELECT floor(count(*) * 0.2 + 1e-9) AS size FROM d1_v6_hard_test)
SELECT route_domain, subtype FROM sample_targets LEFT JOIN c ON d = route_domain AND s = subtype, z WHERE coalesce(n, 0) < target_share * size - 1e-9 OR coalesce(n, 0) < min_rows""",
    "p3_kept": "SELECT true AS size_kept, 0::BIGINT AS repeats, 0::BIGINT AS broken",
    "p6_kept": "SELECT pack_id, count(*) AS documents, sum(strlen(text) + 1)::BIGINT AS tokens, 0::BIGINT AS torn, 0::BIGINT AS overfull FROM documents, packs WHERE text <> '' GROUP BY 1",
    "p6_found": "SELECT pack_id, doc_id FROM documents JOIN packs ON strlen(text) + 1 > capacity_tokens WHERE text <> ''",
}
