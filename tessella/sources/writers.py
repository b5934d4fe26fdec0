"""Sinks: reports, splits, checkpoints and run manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import remove


def report_csv(df: DataFrame, path: str) -> None:
    """A report with nested columns flattened to JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def report_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder a split: readers of one split scan that alone."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Written beside, then the old table is set aside and the new one takes its name; the old one goes last. A stop
    between leaves it beside as ``.old``, from where the next call, or :func:`restored`, brings it back."""
    spark, side, aside = df.sparkSession, f"{path}.new", f"{path}.old"
    restored(spark, path)
    df.write.mode("overwrite").parquet(side)
    fs, old, new, kept = _fs(spark, path, side, aside)
    if fs.exists(old) and not fs.rename(old, kept):
        raise OSError(f"{path} can't be set aside")
    if not fs.rename(new, old):
        raise OSError(f"{side} can't be renamed")
    remove(spark, aside)


def restored(spark: SparkSession, path: str) -> bool:
    """Brings back a table that a broken off :func:`replace` had set aside; tells whether there was one."""
    fs, old, kept = _fs(spark, path, f"{path}.old")
    if not fs.exists(kept):
        return False
    if fs.exists(old):
        return bool(fs.delete(kept, True)) and False
    return bool(fs.rename(kept, old))


def _fs(spark: SparkSession, *paths: str) -> tuple:
    jvm = spark.sparkContext._jvm
    p = [jvm.org.apache.hadoop.fs.Path(x) for x in paths]
    return p[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), *p


def chunks(df: DataFrame, path: str) -> None:
    """Chunks as JSON lines of the reader's fields."""
    df.select(*[F.col(c) for c in ("id", "title", "content", "source", "source_type", "entity_type", "entity_id", "token_count", "raw_data", "context_prefix", "enrichment_prefix") if c in df.columns]).write.mode("overwrite").json(path)


def metrics_report(spark: SparkSession, path: str, meta: dict, **sections: DataFrame) -> None:
    """One JSON object ``{meta, section: {strategy: {metric: value}}}``; ``sections`` are tables with one row a strategy (``strategy_id`` and figures)."""
    out = {"meta": meta}
    for name, df in sections.items():  # one row a strategy
        out[name] = {r["strategy_id"]: {k: v for k, v in r.asDict().items() if k != "strategy_id"} for r in df.collect()}
    spark.createDataFrame([(json.dumps(out, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def run_manifest(spark: SparkSession, path: str, run_id: str, inputs: dict[str, DataFrame], settings: dict) -> None:
    """A run's inputs by rows and fingerprint, and its settings, as one JSON row."""
    prints = {}
    for name, df in sorted(inputs.items()):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s")).first()
        prints[name] = {"rows": r["n"], "fingerprint": str(r["s"])}
    spark.createDataFrame([(run_id, json.dumps(prints), json.dumps(settings, sort_keys=True))], "run_id string, inputs string, settings string").coalesce(1).write.mode("append").partitionBy("run_id").json(path)


def latest_run(spark: SparkSession, path: str) -> str | None:
    return spark.read.schema("run_id string").json(path).agg(F.max("run_id")).first()[0]
