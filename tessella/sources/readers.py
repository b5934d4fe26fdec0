"""Readers and writers of the engine's files. Schemas are stated, never inferred."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns and fields of the engine's files.
MESSAGE = ["id", "text", "route_domain", "subtype", "explicit_booking", "urgency", "is_offtopic", "specialization_hint", "feedback_flag", "faq_category", "style", "source", "seed_id"]
STRATEGY_RESULT = (
    "sample_id string, strategy_id string, retrieval struct<chunk_ids:array<string>,scores:array<double>,context_text:string,context_token_count:int,pre_rerank_chunk_ids:array<string>>, "
    "answer struct<answer:string,answerable:boolean,doctor:string,specialization:string,branch:string,service:string,suggest_booking:boolean,confidence:double,source_ids:array<string>>, "
    "latency_ms double, tokens_prompt int, tokens_completion int, context_length int, route_taken string, error string"
)
DIALOGUE = "case_id int, case_type string, patient_prompt_summary string, runs map<string,struct<schema_name:string,dialog:array<struct<role:string,text:string>>,extracted:map<string,string>,turns:int,tokens_doctor:int,tokens_patient:int,duration_s:double>>"


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A Parquet table of a folder; columns and filters reach the scan."""
    return spark.read.parquet(f"{path}/{name}.parquet")


def messages_csv(spark: SparkSession, path: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """All columns strings, nothing missing: NULL is ''. A header without a required column is an error."""
    header = spark.read.option("header", True).option("multiLine", True).csv(path).columns
    lost = [c for c in [*MESSAGE, *extra] if c not in header]
    if lost:
        raise ValueError(f"columns missing in {path}: {', '.join(lost)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill("")


# Fields of a knowledge chunk, and the order in which kinds of chunks are read.
CHUNK = "id string, title string, content string, source string, source_type string, entity_type string, entity_id string, token_count int, raw_data string, context_prefix string, enrichment_prefix string"
KINDS = ("clinic_info", "price_list", "aftercare", "doctors")


def there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def blind_set(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a CSV that may be missing: then an empty frame of the same columns."""
    if there(spark, path):
        return messages_csv(spark, path)
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in MESSAGE]))


def train_rows(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """``(text, label)`` of a training CSV, and the sha256 of its files by which caches know it."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("h"))
    prints = ",".join(r["h"] for r in files.orderBy("path").collect())  # one a file
    return messages_csv(spark, path).select("text", F.col("route_domain").alias("label")), hashlib.sha256(prints.encode()).hexdigest()


def chunks_json(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON files that hold an array each; nested raw data stays JSON text."""
    return spark.read.schema(CHUNK).option("multiLine", True).json(path)


def knowledge(parts: dict[str, DataFrame | None]) -> DataFrame:
    """Chunks of several kinds as one table with their place ``ord``, kind by kind; kinds without a source are left out."""
    out = None
    for k, kind in enumerate(KINDS):
        df = parts.get(kind)
        if df is not None:
            df = df.where(F.trim(F.coalesce("content", F.lit(""))) != "").withColumn("source_type", F.lit(kind)).withColumn("ord", F.lit(k))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no kind of chunks has a source")
    return out


def gold(df: DataFrame) -> DataFrame:
    """``(sample_id, answerable_gold, doctor_gold)``: doctors trimmed, in small letters, NULL for none."""
    return df.select("sample_id", F.col("answerable").alias("answerable_gold"), F.nullif(F.lower(F.trim("expected_doctor")), F.lit("")).alias("doctor_gold"))


def sample_predictions(results: DataFrame, strategy: str) -> DataFrame:
    """``(sample_id, answerable_pred, doctor_pred)`` of one strategy's results."""
    r = results.where(F.col("strategy_id") == strategy)
    return r.select("sample_id", F.col("answer.answerable").alias("answerable_pred"), F.nullif(F.lower(F.trim("answer.doctor")), F.lit("")).alias("doctor_pred"))


def reports(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Nested report files of several modes as ``(mode, section, strategy, metric, value)``; modes whose file is missing are left out, none at all is an error."""
    from tessella.operators.report import unnested

    out = None
    for mode, path in paths.items():
        if there(spark, path):
            raw = spark.read.text(path, wholetext=True).select(F.lit(mode).alias("mode"), F.to_json(F.map_filter(F.from_json("value", "map<string,string>"), lambda k, v: k.isin("quality", "retrieval", "deterministic"))).alias("p"))
            # sections are JSON text in the outer map: set them back as objects
            raw = raw.withColumn("p", F.regexp_replace(F.regexp_replace(F.regexp_replace("p", r'\\"', '"'), r'"\{', "{"), r'\}"', "}"))
            part = unnested(raw, "p", "mode")
            out = part if out is None else out.union(part)
    if out is None:
        raise FileNotFoundError(", ".join(paths.values()))
    return out


def rank_analysis(spark: SparkSession, path: str, mode: str, strategies: list[str]) -> DataFrame:
    """``(sample, <mode>_<strategy>_rr, ...)`` of a report's rank analysis."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json(F.get_json_object("value", "$.rank_analysis"), "map<string,map<string,double>>").alias("m"))
    long = raw.select(F.explode("m").alias("sample", "r"))
    return long.select("sample", *[F.try_element_at("r", F.lit(s)).alias(f"{mode}_{s}_rr") for s in strategies])


def checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A checkpoint table, empty where there is none yet."""
    return spark.read.schema(schema).parquet(path) if there(spark, path) else spark.createDataFrame([], schema)


def config(text: str, fields: dict[str, tuple[type, object]]) -> dict:
    """A YAML configuration held to ``{name: (type, default)}``: unknown names and wrong types are errors; a default of ... is required."""
    import yaml

    got = yaml.safe_load(text) or {}
    if unknown := sorted(set(got) - set(fields)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    out = {}
    for name, (kind, default) in fields.items():
        if name not in got and default is ...:
            raise ValueError(f"setting missing: {name}")
        value = got.get(name, default)
        if value is not None and (not isinstance(value, kind) or (isinstance(value, bool) and kind is not bool)):
            raise ValueError(f"{name} should be {kind.__name__}, is {type(value).__name__}")
        out[name] = value
    return out


def documents_of(spark: SparkSession, path: str, kinds: dict[str, str]) -> DataFrame:
    """``(kind, path, text)``: the first .docx of each kind of a folder, by name; ``kinds`` maps a kind to a pattern of file names.
    Hidden files, copies and converted ones are skipped, empty texts give no row."""
    from tessella.operators.text import cleaned

    name = F.lower(F.element_at(F.split("path", "/"), -1))
    p = paragraphs(spark, path).where(~name.startswith(".") & ~name.contains("copy") & ~name.contains("converted"))
    kind = F.coalesce(*[F.when(name.rlike(rx), k) for k, rx in kinds.items()])
    lines = F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: x["text"])  # one file's paragraphs
    t = p.withColumn("kind", kind).where("kind is not null").groupBy("kind", "path").agg(cleaned(F.array_join(lines, "\n")).alias("text"))
    return first_per(t.where("text <> ''"), "kind", "path")


def results_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Strategy results, a line each; blank lines and a missing file give no row."""
    if not there(spark, path):
        return spark.createDataFrame([], STRATEGY_RESULT)
    return spark.read.schema(STRATEGY_RESULT).json(path)


def dialogues(spark: SparkSession, path: str) -> DataFrame:
    """One row a case and schema of dialogue files."""
    d = spark.read.schema(DIALOGUE).option("multiLine", True).json(path)
    return d.select("case_id", "case_type", F.explode("runs").alias("schema", "run")).select("case_id", "case_type", "schema", "run.*")


def rows_yaml(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The list under ``key`` of YAML files, each file parsed by one task."""
    kind = spark.createDataFrame([], schema).schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for p in parts:
            rows = [r for t in p["value"] for r in (yaml.safe_load(t) or {}).get(key, [])]
            yield pd.DataFrame([{f.name: r.get(f.name) for f in kind.fields} for r in rows], columns=kind.names)

    return spark.read.text(path, wholetext=True).mapInPandas(run, kind)


def eval_set(df: DataFrame, gold: str = "gold_chunk_ids", facts: str = "gold_facts") -> DataFrame:
    """Eval items of older files: a flat list of gold ids is one alternative, a bare fact is a text fact."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if kinds[gold] == "array<string>":
        df = df.withColumn(gold, F.when(F.size(gold) > 0, F.array(gold)).otherwise(F.array().cast("array<array<string>>")))
    if kinds[facts] == "array<string>":
        df = df.withColumn(facts, F.transform(facts, lambda f: F.struct(F.lit("text").alias("fact_type"), f.alias("canonical_value"), F.lit("").alias("label"))))
    return df


def paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """``(path, no, text)``: non-empty paragraphs of .docx files."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        for p in parts:
            out = []
            for name, content in zip(p["path"], p["content"], strict=True):
                root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
                texts = ("".join(t.text or "" for t in q.iter(f"{w}t")).strip() for q in root.iter(f"{w}p"))
                out += [(name, n, t) for n, t in enumerate(x for x in texts if x)]
            yield pd.DataFrame(out, columns=["path", "no", "text"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content").mapInPandas(run, "path string, no int, text string")


def switch_rows(df: DataFrame, prefix: str = "switch_") -> tuple[DataFrame, DataFrame]:
    """Hard cases with defaults set, apart: ordinary ones and context switches, told by their id."""
    df = df.withColumn("source", F.coalesce(F.nullif("source", F.lit("")), F.lit("manual_hard"))).withColumn("seed_id", F.coalesce("seed_id", F.lit("")))
    return df.where(~F.col("id").startswith(prefix)), df.where(F.col("id").startswith(prefix))


def split_counts(df: DataFrame, split: str, label: str, labels: list[str]) -> DataFrame:
    """Rows of a split, in all and per label."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(label) == x).alias(x) for x in labels])


def first_per(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")
