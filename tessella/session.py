"""Session building and the shared folder that cuts lineage."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", partitions: int = 8, memory: str = "8g", app: str = "tessella") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. Only a session on one
    machine (``local`` masters, as in tests) may leave it unset and gets a temporary
    folder of its own; on a cluster that would be another folder on each machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set: {master} needs a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tessella_")
        atexit.register(shutil.rmtree, own, True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_SCRATCH: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, remembered for :func:`sweep`."""
    path = f"{shared_dir(spark)}/{name}-{os.getpid()}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as a written table: cuts lineage, survives lost executors and is
    smaller than a row checkpoint, being columnar and compressed."""
    path = scratch(df.sparkSession, name)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> int:
    """Deletes every scratch table of this process and tells how many there were.
    For the caller to use once results are stored: frames built before it are void after it."""
    n = len(_SCRATCH)
    while _SCRATCH:
        remove(spark, _SCRATCH.pop())
    return n


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished jobs now, instead of when the driver runs short of memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path on whatever file system holds it."""
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder, sorted; none if there is no such folder."""
    p, fs = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def get_text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small new file under its name in one step; raises if there is one of that name."""
    p, fs = _fs(spark, path)
    draft, _ = _fs(spark, f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}")
    stream = fs.create(draft)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(p) or not fs.rename(draft, p):
        fs.delete(draft, False)
        raise FileExistsError(path)
