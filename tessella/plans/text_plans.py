"""Plans over texts: normalisation, claims, rules, sections, chunks, dialogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import chunking, dedup, dialogue, report, rules
from tessella.operators import text as tx
from tessella.plans.registry import plan, t

NORM = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
HEADERS = {"visit": "Как подготовиться к визиту", "doctor": "О враче", "faq": "Частые вопросы", "patient": "Памятка пациенту", "hours": "Режим работы", "prices": "Цены на услуги"}


@plan(f"SELECT doc_id, md5({NORM.format('text')}) AS norm_md5 FROM documents")
def text_normalize_dedup(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.md5(tx.dedup_norm(F.col("text")).cast("binary")).alias("norm_md5"))


@plan(rf"""
WITH n AS (SELECT 'normalised' AS equality, {NORM.format('text')} AS v FROM d1_v6_hard_test
 UNION ALL SELECT 'trimmed', lower(trim(coalesce(text, ''))) FROM d1_v6_hard_test
 UNION ALL SELECT 'lower', lower(coalesce(text, '')) FROM d1_v6_hard_test),
g AS (SELECT equality, v, count(*) AS c FROM n GROUP BY ALL HAVING count(*) > 1)
SELECT e.equality, count(g.c) AS texts, coalesce(sum(g.c), 0)::BIGINT AS "rows" FROM (VALUES ('normalised'), ('trimmed'), ('lower')) e(equality) LEFT JOIN g USING (equality) GROUP BY ALL""")
def three_equalities_audit(spark: SparkSession, d: str) -> DataFrame:
    h = t(spark, d, "d1_v6_hard_test")
    c = F.col("text")
    out = None
    for name, norm in (("normalised", tx.dedup_norm(c)), ("trimmed", tx.strip_lower(c)), ("lower", tx.just_lower(c))):
        r = dedup.repeated(h, norm).select(F.lit(name).alias("equality"), "texts", "rows")
        out = r if out is None else out.union(r)
    return out


_CLAIMS = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS family, trim(unnest(regexp_extract_all(coalesce(text, ''), '({rx})', 1))) AS claim FROM documents" for n, rx in tx.CLAIMS)


@plan(f"SELECT doc_id, family, claim, count(*) AS n FROM ({_CLAIMS}) GROUP BY ALL")
def claims_extract(spark: SparkSession, d: str) -> DataFrame:
    return tx.claims(t(spark, d, "documents").select("doc_id", "text")).groupBy("doc_id", "family", "claim").agg(F.count(F.lit(1)).alias("n"))


@plan(f"""WITH c AS ({_CLAIMS}), p AS (SELECT family, claim, regexp_replace(claim, '[^0-9]', '', 'g') AS dg FROM c WHERE family IN ('phone', 'price'))
SELECT family, CASE WHEN family = 'phone' AND length(dg) = 11 AND dg LIKE '8%' THEN '7' || substr(dg, 2, 10) ELSE dg END AS value, count(*) AS n FROM p GROUP BY ALL""")
def phone_price_norm(spark: SparkSession, d: str) -> DataFrame:
    c = tx.claims(t(spark, d, "documents").select("doc_id", "text")).where(F.col("family").isin("phone", "price"))
    return c.groupBy("family", F.when(F.col("family") == "phone", tx.phone(F.col("claim"))).otherwise(tx.digits(F.col("claim"))).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@plan(r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9а-яё]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part""")
def slug_names(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", tx.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@plan(r"""WITH h AS (SELECT p_brand, sha256(concat_ws('|', p_partkey::VARCHAR, p_name, p_type)) AS h FROM part),
p AS (SELECT p_brand, substr(h, 1, 3) AS p, sum(('0x' || substr(h, 1, 12))::BIGINT)::HUGEINT AS s, count(*) AS n FROM h GROUP BY ALL)
SELECT p_brand, sum(n)::BIGINT AS "rows", substr(sha256(string_agg(p || ':' || s || ':' || n, ',' ORDER BY p || ':' || s || ':' || n)), 1, 12) AS fingerprint FROM p GROUP BY p_brand""")
def manifest_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return report.manifest(t(spark, d, "part"), "p_brand", "p_partkey", "p_name", "p_type")


def _route_sql(text: str) -> str:
    hits = {c: " + ".join(f"(CASE WHEN regexp_matches(lower(coalesce({text}, '')), '{p}') THEN 1 ELSE 0 END)" for p in ps) for c, ps in rules.ROUTES.items()}
    return "SELECT *, " + ", ".join(f"({h}) AS h_{c}" for c, h in hits.items())


_ORDER = [c for c in rules.ROUTES if c != "unsupported"] + ["unsupported"]
ROUTED = (
    "CASE " + " ".join(f"WHEN h_{c} > 0 THEN '{c}'" for c in _ORDER) + " ELSE 'unsupported' END",
    "CASE " + " ".join(f"WHEN h_{c} > 0 THEN round(least(0.5 + 0.1 * h_{c}, 0.95), 6)" for c in _ORDER) + " ELSE 0.3 END",
    "CASE " + " ".join(f"WHEN h_{c} > 0 THEN h_{c} || '_patterns'" for c in _ORDER) + " ELSE 'no_match' END",
)
ROUTES_SQL = f"(SELECT *, {ROUTED[0]} AS route, ({ROUTED[1]})::DOUBLE AS confidence, {ROUTED[2]} AS rule FROM ({_route_sql('text')} FROM d1_v6_hard_test))"


@plan(f"SELECT row_no, route, confidence, rule FROM {ROUTES_SQL}")
def rule_router(spark: SparkSession, d: str) -> DataFrame:
    # one file may be one input partition: the patterns want every core
    h = t(spark, d, "d1_v6_hard_test").select("row_no", "text").repartition(spark.sparkContext.defaultParallelism)
    return h.select("row_no", rules.routed(F.col("text")).alias("r")).select("row_no", "r.*")


@plan(r"""WITH hit AS (SELECT DISTINCT p_brand FROM part WHERE lower(p_name) LIKE '%red%')
SELECT p_brand, p_brand IN (SELECT p_brand FROM hit) AS held, count(*) AS n FROM part GROUP BY ALL""")
def entity_holdout(spark: SparkSession, d: str) -> DataFrame:
    from tessella.operators.splits import holdout

    mark = rules.first_marker(F.col("p_name"), {"colour": ("red",)}).isNotNull()
    return holdout(t(spark, d, "part"), "p_brand", mark).groupBy("p_brand", "held").agg(F.count(F.lit(1)).alias("n"))


_LABEL = "lower(trim(coalesce(route_domain, '')))"
_OTHER = " OR ".join(f"({_LABEL} <> '{c}' AND regexp_matches(lower(coalesce(text, '')), '{'|'.join(f'(?:{p})' for p in ps)}'))" for c, ps in rules.ROUTES.items())


@plan(f"SELECT {_LABEL} AS label, count(*) AS n FROM d1_v6_hard_test WHERE NOT ({_OTHER}) GROUP BY ALL")
def domain_consistency(spark: SparkSession, d: str) -> DataFrame:
    h = t(spark, d, "d1_v6_hard_test").withColumn("label", F.lower(F.trim(F.coalesce("route_domain", F.lit("")))))
    return rules.consistent(h, "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@plan("SELECT source, count(*) AS n FROM d1_v6_train WHERE NOT regexp_matches(coalesce(text, ''), '[іїєґІЇЄҐ]') AND regexp_matches(coalesce(text, ''), '^[\\p{Cyrillic}a-zA-Z0-9\\p{P}\\p{S}\\s]*$') GROUP BY ALL".replace("\\\\", "\\"))
def alphabet_filter(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "d1_v6_train").where(rules.only_alphabet(F.col("text"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


_AT = " UNION ALL ".join(f"SELECT doc_id, text, '{n}' AS section, instr(text, '{h}') AS pos, length('{h}') AS size FROM documents WHERE instr(text, '{h}') > 0" for n, h in HEADERS.items())


@plan(f"""WITH h AS ({_AT}), n AS (SELECT *, row_number() OVER w - 1 AS section_no, lead(pos) OVER w AS nxt FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos, section))
SELECT doc_id, section_no::INT AS section_no, section, md5(trim(substr(text, pos + size, greatest(coalesce(nxt, length(text) + 1) - pos - size, 0)))) AS body FROM n""")
def section_split(spark: SparkSession, d: str) -> DataFrame:
    return tx.sections(t(spark, d, "documents").select("doc_id", "text"), HEADERS, ["doc_id"]).withColumn("body", F.md5(F.col("body").cast("binary")))


_CHUNKS = """(WITH l AS (SELECT p_brand, p_partkey, p_name || ': ' || p_size AS line, len(string_split(p_name || ': ' || p_size, ' ')) AS z FROM part),
w AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n, sum(z) OVER (PARTITION BY p_brand) AS total, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM l)
SELECT p_brand, k // (CASE WHEN total > 60 THEN n // (total::BIGINT // 60 + 1) + 1 ELSE n END) AS part, count(*) AS items, string_agg(line, chr(10) ORDER BY k) AS content FROM w GROUP BY ALL)"""


@plan(f"SELECT p_brand, part, items, content FROM {_CHUNKS}")
def price_list_chunks(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.col("p_name"), F.lit(": "), F.col("p_size").cast("string"))
    return chunking.list_chunks(t(spark, d, "part"), "p_brand", "p_partkey", line, F.size(F.split(line, " ")), 60)


@plan(f"SELECT p_brand, md5(string_agg('[' || part || '] ' || p_brand || chr(10) || content, chr(10) || '---' || chr(10) ORDER BY part)) AS context FROM {_CHUNKS} GROUP BY p_brand")
def context_format(spark: SparkSession, d: str) -> DataFrame:
    c = price_list_chunks(spark, d).withColumn("title", F.col("p_brand"))
    return c.groupBy("p_brand").agg(F.md5(tx.context("part", "title", "content", "part").cast("binary")).alias("context"))


@plan("""SELECT 'chunk_' || lpad(row_number() OVER (ORDER BY p_brand, p_partkey)::VARCHAR, greatest(4, length(row_number() OVER (ORDER BY p_brand, p_partkey)::VARCHAR))::INT, '0') AS id, p_partkey,
'Kind: ' || CASE p_type WHEN 'ECONOMY' THEN 'Plain' ELSE p_type END || chr(10) || 'Title: ' || p_name || chr(10) || 'Source: ' || p_brand || chr(10) || chr(10) || p_name || chr(10) || p_size AS embedding_text FROM part""")
def chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    prefix = chunking.context_prefix(F.col("p_type"), F.col("p_name"), F.col("p_brand"), {"ECONOMY": "Plain"})
    p = chunking.numbered(t(spark, d, "part"), ["p_brand", "p_partkey"], "chunk_")
    return p.select("id", "p_partkey", chunking.embedding_text([prefix], F.col("p_name"), F.col("p_size").cast("string")).alias("embedding_text"))


@plan(r"""SELECT sample_id, coalesce(nullif(trim(seed_family_id), ''), nullif(regexp_extract(coalesce(notes, ''), '(sf_[0-9]+)', 1), ''), sample_id) AS family,
coalesce(nullif(regexp_extract(lower(trim(expected_doctor)), '([а-яёa-z]{3,})', 1), ''), lower(trim(expected_doctor))) AS surname FROM eval_sample""")
def family_and_surname(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "eval_sample")
    return e.select("sample_id", tx.family(F.col("seed_family_id"), F.col("notes"), F.col("sample_id")).alias("family"), tx.surname(F.col("expected_doctor")).alias("surname"))


_FOLD = "list_reduce(list(event_type ORDER BY event_id), lambda o, n: CASE WHEN n = '' THEN o WHEN o = '' THEN n WHEN contains(lower(o), lower(n)) THEN o WHEN contains(lower(n), lower(o)) THEN n ELSE o || '; ' || n END)"


@plan(f"SELECT user_id, (json_extract_string(props, '$.k')::INT % 4)::VARCHAR AS field, {_FOLD} AS value, count(*)::INT AS turns FROM events GROUP BY ALL")
def dialogue_fold(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").withColumn("field", (F.get_json_object("props", "$.k").cast("int") % 4).cast("string"))
    return dialogue.folded(e, "user_id", "event_id", "field", "event_type")


@plan("SELECT user_id, ((count(*) + 1) // 2)::BIGINT AS turns, count(*) AS messages, count(DISTINCT event_type) AS roles, sum(length(props))::BIGINT AS tokens FROM events GROUP BY user_id")
def dialogue_stats(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.figures(t(spark, d, "events"), "user_id", "event_type", F.length("props"))


@plan("""SELECT event_id, least(greatest(coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0)::INT, 0), 10) AS mark,
(least(greatest(coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0)::INT, 0), 10) >= 5) AS matched FROM events""")
def judge_clamp(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("event_id", tx.clamped(F.get_json_object("props", "$.k")).alias("mark"))
    return e.withColumn("matched", dialogue.routing_match([F.col("mark")]))


@plan("""SELECT user_id, 's' AS section, event_type AS strategy, 'mean' AS metric, round(avg(value), 6) AS value FROM events GROUP BY user_id, event_type""")
def json_report_unnest(spark: SparkSession, d: str) -> DataFrame:
    m = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("v"))
    inner = F.map_from_entries(F.collect_list(F.struct("event_type", F.create_map(F.lit("mean"), F.col("v")))))
    j = m.groupBy("user_id").agg(F.to_json(F.create_map(F.lit("s"), inner)).alias("payload"))
    return report.unnested(j, "payload", "user_id")
