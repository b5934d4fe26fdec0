"""Learners: character n-gram TF-IDF with logistic regression or a calibrated SVM, hashed
bags of words, centroids, and the bundle that trains and stores them."""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, SQLTransformer, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessella.session import scratch


def char_grams(text: Column, low: int = 2, high: int = 5) -> Column:
    """Character n-grams inside words padded by blanks, as ``array<string>``."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pad = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(n: int):
        return lambda w: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.concat(*[F.transform(pad, of(n)) for n in range(low, high + 1)]))


class TfIdf:
    """Character n-grams inside padded words, weighted (1 + log tf) * (log((1 + n) / (1 + df)) + 1), unit length.

    The vocabulary is what at least ``least`` texts and at most a share ``most`` of them hold, its ``features`` most
    frequent grams (a parameter of the model, not of the data); counts cover all texts. Vectors are made batch by batch and
    written, as the fits that follow read them many times."""

    def __init__(self, low: int = 2, high: int = 5, features: int = 50_000, least: int = 2, most: float = 0.95):
        self.low, self.high, self.features, self.least, self.most = low, high, features, least, most
        self.index: dict[str, int] = {}
        self.idf = np.empty(0)

    def fit(self, df: DataFrame, text: str) -> TfIdf:
        grams = df.select(char_grams(F.col(text), self.low, self.high).alias("g"))
        n = df.count()
        # a text's own grams are counted before they are shuffled
        per = grams.select(F.explode("g").alias("g"), F.monotonically_increasing_id().alias("i")).groupBy("i", "g").agg(F.count(F.lit(1)).alias("tf"))
        t = per.groupBy("g").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")).where((F.col("df") >= self.least) & (F.col("df") <= self.most * n))
        rows = sorted(t.orderBy(F.desc("tf"), "g").limit(self.features).collect(), key=lambda r: r["g"])
        self.index = {r["g"]: k for k, r in enumerate(rows)}
        self.idf = np.array([math.log((1 + n) / (1 + r["df"])) + 1 for r in rows])
        return self

    def vectors(self, df: DataFrame, text: str, features: str = "features") -> DataFrame:
        """``df`` with its vectors."""
        index, idf, low, high = self.index, self.idf, self.low, self.high
        keep = [c for c in df.columns if c != features]
        size = len(index)

        def grams(t: str | None) -> Counter:
            out: Counter = Counter()
            for w in re.split(r"[\W_]+", (t or "").lower()):
                if w:
                    w = f" {w} "
                    for n in range(low, high + 1):
                        out.update(w[i : i + n] for i in range(len(w) - n + 1))
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for t in b.column(text).to_pylist():
                    hit = sorted((index[g], n) for g, n in grams(t).items() if g in index)
                    v = np.array([(1 + math.log(n)) * idf[k] for k, n in hit])
                    norm = float(np.sqrt((v * v).sum())) or 1.0
                    rows.append({"type": 0, "size": size, "indices": [k for k, _ in hit], "values": (v / norm).tolist()})
                kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(rows, kind)], [*keep, features])

        kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
        out = df.select(*keep).mapInArrow(run, f"{kinds}, `{features}` struct<type:tinyint,size:int,indices:array<int>,values:array<double>>")
        path = scratch(df.sparkSession, "vectors")
        out.write.option("compression", "zstd").parquet(path)
        # a vector is stored as just this struct
        return df.sparkSession.read.schema(StructType([*(df.schema[c] for c in keep), StructField(features, VectorUDT())])).parquet(path)


def logistic(label: str, rows: int, c: float = 1.0) -> Pipeline:
    """Multinomial logistic regression over ``features``."""
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="y", handleInvalid="skip", stringOrderType="alphabetAsc"),
        LogisticRegression(labelCol="y", featuresCol="features", regParam=1.0 / (c * max(rows, 1)), standardization=False, maxIter=50, family="multinomial"),
    ])


class PlattSVM:
    """One linear SVM a class, its margins turned into probabilities by a logistic curve (Platt) that is fitted on
    rows the SVM has not seen, a fifth by hash of ``key``; probabilities are scaled to sum 1."""

    def __init__(self, classes: list[str], c: float = 1.0):
        self.classes, self.c = sorted(classes), c
        self.heads: list[tuple] = []

    def fit(self, df: DataFrame, label: str, key: str) -> PlattSVM:
        fold = F.pmod(F.xxhash64(F.col(key)), F.lit(5))
        n = df.count()
        for x in self.classes:
            d = df.withColumn("y", (F.col(label) == x).cast("double"))
            svm = LinearSVC(labelCol="y", maxIter=30, regParam=1.0 / (self.c * max(n, 1)), standardization=False).fit(d.where(fold != 0))
            margin = svm.transform(d.where(fold == 0)).select("y", F.array(F.element_at(vector_to_array("rawPrediction"), 2)).alias("m"))
            slope, at = 1.0, 0.0  # of a fifth that holds one side alone, or none, nothing can be learned
            if margin.select("y").distinct().count() == 2:
                curve = LogisticRegression(labelCol="y", featuresCol="v", regParam=0.0, standardization=False).fit(margin.select("y", array_to_vector("m").alias("v")))
                slope, at = float(curve.coefficients[0]), float(curve.intercept)
            self.heads.append((svm, slope, at))
        return self

    def predicted(self, df: DataFrame) -> DataFrame:
        """``df`` with ``pred`` and ``confidence``."""
        out = df
        for k, (svm, s, o) in enumerate(self.heads):
            out = svm.setRawPredictionCol(f"_r{k}").setPredictionCol(f"_q{k}").transform(out)
            margin = F.element_at(vector_to_array(f"_r{k}"), 2)
            out = out.withColumn(f"_p{k}", 1 / (1 + F.exp(-(F.lit(s) * margin + F.lit(o)))))
        p = F.array(*[F.col(f"_p{k}") for k in range(len(self.heads))])
        top = F.array_max(p)
        name = F.element_at(F.array(*[F.lit(x) for x in self.classes]), F.array_position(p, top).cast("int"))
        total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
        return out.select(*df.columns, name.alias("pred"), F.when(total > 0, top / total).otherwise(1.0 / len(self.heads)).alias("confidence"))


def learning_curve(train: DataFrame, test: DataFrame, label: str, family: str, fractions: list[float], seeds: list[int], fit: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``(fraction, seed, train_rows, train_families, n, accuracy)``: a fit for every fraction of the training families
    and seed. A family is drawn by a hash of seed and family, so larger fractions hold smaller ones. ``fit(train, test)`` gives ``test`` with ``pred``;
    the grid is stated, and the driver loops over it alone."""
    rows = []
    for s in seeds:
        draw = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(family), F.lit("")), F.lit(f"|{s}"))), 1, 8), 16, 10).cast("double") / 4294967296.0
        for f in sorted(fractions):
            part = train if f >= 1 else train.where(draw < f)
            size, families = part.agg(F.count(F.lit(1)), F.countDistinct(family)).first()
            n, ok = fit(part, test).agg(F.count(F.lit(1)), F.count_if(F.col("pred") == F.col(label))).first() if size else (0, 0)
            rows.append((float(f), int(s), size, families, n, ok / n if n else 0.0))
    return train.sparkSession.createDataFrame(rows, "fraction double, seed int, train_rows bigint, train_families bigint, n bigint, accuracy double")


def latency(run: Callable[[DataFrame], DataFrame], texts: DataFrame, repeats: int = 5) -> dict[str, float]:
    """Milliseconds a text, median and 95th percentile over ``repeats`` runs after one to warm up; the result is computed and dropped."""
    n, took = max(1, texts.count()), []
    for _ in range(repeats + 1):
        began = time.perf_counter()
        run(texts).write.format("noop").mode("overwrite").save()
        took.append((time.perf_counter() - began) * 1000)
    took = took[1:]
    return {"ms_per_text": float(np.median(took)) / n, "batch_p95_ms": float(np.percentile(took, 95)), "n": float(n)}


def hashed_lr(label: str, buckets: int = 1 << 16) -> Pipeline:
    """Hashed words and word pairs under a softmax: a bag-of-n-grams classifier."""
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="y", handleInvalid="skip", stringOrderType="alphabetAsc"),
            NGram(n=2, inputCol="words", outputCol="pairs"),
            SQLTransformer(statement="SELECT *, concat(words, pairs) AS bag FROM __THIS__"),
            HashingTF(inputCol="bag", outputCol="features", numFeatures=buckets),
            LogisticRegression(labelCol="y", maxIter=30, regParam=0.001),
        ]
    )


def predicted(model: PipelineModel, df: DataFrame, labels: list[str]) -> DataFrame:
    """``df`` with ``pred`` and ``confidence`` (1 for heads without probabilities)."""
    out = model.transform(df)
    name = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1)
    conf = F.array_max(vector_to_array("probability")) if "probability" in out.columns else F.lit(1.0)
    return out.select(*df.columns, name.alias("pred"), conf.alias("confidence"))


def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """``(label, centroid)``: mean of each dimension."""
    rows = df.select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    mean = rows.groupBy(label, "i").agg(F.avg("x").alias("m"))
    return mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def nearest_centroid(df: DataFrame, cents: DataFrame, vector: str, label: str, key: str) -> DataFrame:
    """``(key, pred)``: label of the nearest centroid, ties to the smaller. One centroid a class: broadcast."""
    d = F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    bag = cents.agg(F.collect_list(F.struct(F.col(label).alias("l"), "centroid")).alias("bag"))
    rows = df.select(key, vector).join(F.broadcast(bag)).select(key, vector, F.explode("bag").alias("c")).select(key, vector, "c.l", "c.centroid")
    best = rows.groupBy(key).agg(F.min(F.struct(F.round(d, 9).alias("d"), F.col("l"))).alias("m"))
    return best.select(key, F.col("m.l").alias("pred"))


class Bundle:
    """Models by name at a path. A stored model is used only if every hash of its key
    (code version, data, parameters, name, columns) is the same."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def key(df: DataFrame, name: str, params: dict, version: str = "1") -> dict[str, str]:
        h = lambda x: hashlib.sha256(x.encode()).hexdigest()[:16]
        data = df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).first()
        return {"name": h(name), "params": h(json.dumps(params, sort_keys=True)), "data": h(f"{data['s']}/{data['n']}"), "columns": h(",".join(df.columns)), "version": h(version)}

    def differs(self, name: str, key: dict[str, str]) -> list[str]:
        """Parts of the key that differ from the stored one; all of them if there is none."""
        try:
            held = json.loads(self.spark.read.text(f"{self.path}/{name}/key").first()[0])
        except Exception:
            return sorted(key)
        return sorted(k for k in key if held.get(k) != key[k])

    def fit(self, name: str, pipeline: Pipeline, df: DataFrame, params: dict, use_cache: bool = True) -> PipelineModel:
        key = self.key(df, name, params)
        if use_cache and not self.differs(name, key):
            return PipelineModel.load(f"{self.path}/{name}/model")
        model = pipeline.fit(df)
        model.write().overwrite().save(f"{self.path}/{name}/model")
        self.spark.createDataFrame([(json.dumps(key),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{name}/key")
        return model
