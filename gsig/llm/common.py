"""What the operators of this subpackage share: words, staging, copies of vectors."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: A word is a run of anything but the space and the ASCII control white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: spark.checkpoint.dir; a local one only where it is unset and all runs on one machine."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return told or f"file://{os.path.join(tempfile.gettempdir(), 'gsig-checkpoints')}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and cut from its lineage; its files survive the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Actions started inside remove their shuffle files when they end, as what they have made is on disk and nothing reads those again.

    A task that writes up to 8 buckets needn't sort them. The driver keeps the first part of their plans' text only; literals of bounded size would fill megabytes of it.
    """
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "100000", "spark.sql.maxConcurrentOutputFileWriters": "8"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame) -> DataFrame:
    """Like checkpointed, as compressed Parquet, without the shuffle files that it took; for rows that are read more than once."""
    path = f"{shared_dir(df.sparkSession)}/gsig-{uuid.uuid4().hex}"
    with lean(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def bucketed(df: DataFrame, key: str, dictionary: bool = True) -> tuple[DataFrame, str]:
    """Like written, dealt to as many buckets of `key` as shuffles have partitions, and the folder; joins on the key meet the rows where they lie.

    Hashes that hardly repeat cost less without a dictionary.
    """
    spark, name = df.sparkSession, f"gsig_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    with lean(spark):
        df.write.option("compression", "zstd").option("parquet.enable.dictionary", dictionary).option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(name)
    return spark.table(name), path


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def vector_classes(df: DataFrame, keep: int, allow_zero: bool) -> tuple[DataFrame, DataFrame]:
    """Equal vectors as one class: (class_id, vector, ids: its `keep` smallest ids in order), and (vec_id, class_id).

    No vector of a class has more than `keep` - 1 better-placed twins that can matter to a list of that
    length, so the shortened ids lose nothing. row_number() <= keep is applied before the shuffle too
    (WindowGroupLimit), so a class with a third of all rows sends `keep` rows per task.
    Vectors that are null or hold null, NaN or infinite components are left out, all-zero ones if
    `allow_zero` is false. A repeated vec_id counts once per distinct row.
    """
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter((F.size("vector") > 0) & ~bad)
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))  # -0.0 counts as 0.0
    if not allow_zero:
        rows = rows.filter(F.exists("vector", lambda x: x != 0))
    rows = rows.withColumn("class_id", F.xxhash64("vector"))
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("class_id").orderBy("vec_id"))).filter(F.col("n") <= keep)
    classes = first.groupBy("class_id").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_set("vec_id")).alias("ids"))
    return classes, rows.select("vec_id", "class_id")
