"""Physical idioms: blocks with halo for frames, running sums over blocks, and range joins by bucket."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

BLOCK = 65_536


def shared_dir(spark: SparkSession) -> str:
    """A folder that all executors can read: spark.checkpoint.dir; a local one only where it is unset and all runs on one machine."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return told or f"file://{os.path.join(tempfile.gettempdir(), 'gsig-files')}"


def shared(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder; for results that a plan reads several times, whatever executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/shared-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_blocks(rows: DataFrame, order: list[str], size: int | None = None) -> tuple[DataFrame, bool]:
    """rows, written, with _block: numbers that rise with the order, of about `size` (BLOCK) rows each; and whether there are several.

    Spark samples the rows for the borders, so a block's size doesn't depend on how values are spread, and it is read back from
    what was written, so it doesn't change. Orders have to tell rows apart; rows that don't differ share a block.
    """
    size = size or BLOCK
    rows = shared(rows)
    n = rows.count()
    if n <= size:
        return rows.withColumn("_block", F.lit(0)), False
    # Samples make some ranges larger than the mean, so ranges are cut at half the size.
    return shared(rows.repartitionByRange(-(-2 * n // size), *order).withColumn("_block", F.spark_partition_id())), True


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str = "_r") -> DataFrame:
    """rows with their rank (from 0) in an order inside keys, and _all, the rows of their key.

    Blocks cut from the data are counted, and rows are ranked inside them, so a key may hold any share of the rows.
    """
    rows, several = in_blocks(rows, [*keys, *order])
    inside = F.row_number().over(W.partitionBy(*keys, "_block").orderBy(*order)) - 1
    if not several:
        return rows.withColumn(name, inside.cast("long")).withColumn("_all", F.count("*").over(W.partitionBy(*keys, "_block"))).drop("_block")
    n = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    n = n.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"), F.sum("_n").over(W.partitionBy(*keys)).alias("_all"))
    return rows.withColumn("_in", inside).join(n, [*keys, "_block"]).withColumn(name, F.col("_s") + F.col("_in")).drop("_block", "_in", "_s")


def with_halo(rows: DataFrame, before: int, after: int, block: int = BLOCK, pos: str = "pos") -> DataFrame:
    """rows with _block and _own: each row in its block of positions, and copies in the blocks whose frames reach it.

    A frame over (keys, _block) then sees all it needs in one task, and a long contig is spread over many tasks. Only rows
    with _own are results. `before` and `after` are how far frames reach below and above a position.
    """
    p = F.col(pos)
    blocks = F.sequence(F.floor((p - after) / block), F.floor((p + before) / block))
    return rows.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == F.floor(p / block))


def frame(rows: DataFrame, keys: list[str], before: int, after: int, columns: dict, block: int = BLOCK, pos: str = "pos") -> DataFrame:
    """rows with columns computed over positions pos-before .. pos+after of the same keys; columns: name -> f(window)."""
    w = W.partitionBy(*keys, "_block").orderBy(pos).rangeBetween(-before, after)
    spread = with_halo(rows, before, after, block, pos)
    return spread.withColumns({k: f(w) for k, f in columns.items()}).filter("_own").drop("_own", "_block")


def running_sum(rows: DataFrame, keys: list[str], value: Column, name: str, block: int = BLOCK, pos: str = "pos") -> DataFrame:
    """rows with the sum of value over positions up to their own: sums inside blocks plus the total of earlier blocks."""
    rows = rows.withColumn("_block", F.floor(F.col(pos) / block)).withColumn("_v", value)
    totals = rows.groupBy(*keys, "_block").agg(F.sum("_v").alias("_t"))
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*keys, "_block", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*keys, "_block").orderBy(pos).rangeBetween(W.unboundedPreceding, 0)
    return rows.join(totals, [*keys, "_block"]).withColumn(name, F.col("_before") + F.sum("_v").over(inside)).drop("_block", "_v", "_before")


def beside(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, ahead: bool = False, block: int = BLOCK) -> DataFrame:
    """rows with the value of the row before them in an order (or after), whose first column holds positions.

    Blocks of positions are ordered apart; of each, one row at the edge is carried to the next block that has rows.
    """
    step = F.lead if ahead else F.lag
    held = F.struct(F.col(value).alias("v"))
    rows = rows.withColumn("_block", F.floor(F.col(order[0]) / block))
    edges = rows.groupBy(*keys, "_block").agg((F.min_by if ahead else F.max_by)(held, F.struct(*order)).alias("_e"))
    edges = edges.select(*keys, "_block", step("_e").over(W.partitionBy(*keys).orderBy("_block")).alias("_e"))
    inside = step(held).over(W.partitionBy(*keys, "_block").orderBy(*order))
    return rows.withColumn("_v", inside).join(edges, [*keys, "_block"]).withColumn(name, F.coalesce("_v", "_e")["v"]).drop("_block", "_v", "_e")


def run_starts(rows: DataFrame, keys: list[str], gap: int, start: str = "start", end: str = "end", block: int = BLOCK) -> DataFrame:
    """rows with _run, the (start, end) of the interval that begins their run: one that starts `gap` or more after all earlier ends.

    Blocks of starts are ordered apart; of each, the largest end and the last beginning are carried to the blocks after it.
    """
    rows = rows.withColumn("_block", F.floor(F.col(start) / block))
    inside = W.partitionBy(*keys, "_block").orderBy(start, end)
    ahead = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = lambda df, c, name: df.groupBy(*keys, "_block").agg(F.max(c).alias("_t")).select(*keys, "_block", F.max("_t").over(ahead).alias(name))
    rows = rows.join(carried(rows, end, "_reach"), [*keys, "_block"])
    reach = F.greatest("_reach", F.max(end).over(inside.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("_run", F.when(F.coalesce(F.col(start) - reach >= gap, F.lit(True)), F.struct(F.col(start).alias("start"), F.col(end).alias("end"))))
    last = carried(rows, "_run", "_last")
    rows = rows.withColumn("_run", F.max("_run").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    return rows.join(last, [*keys, "_block"]).withColumn("_run", F.coalesce("_run", "_last")).drop("_block", "_reach", "_last")


def ranked_counts(counts: DataFrame, keys: list[str], value: str = "value", n: str = "_n") -> tuple[DataFrame, bool]:
    """counts (one row per different value) with _block, _upto: how many are not larger, and _all; and whether there are several blocks.

    Blocks of values are cut from the data (`in_blocks`); only one row per block is ordered as a whole.
    """
    counts, several = in_blocks(counts, [*keys, value])
    inside = W.partitionBy(*keys, "_block").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    counts = counts.withColumn("_upto", F.sum(n).over(inside))
    if not several:
        return counts.withColumn("_all", F.sum(n).over(W.partitionBy(*keys, "_block"))), False
    blocks = counts.groupBy(*keys, "_block").agg(F.sum(n).alias("_t"))
    before = F.coalesce(F.sum("_t").over(W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(*keys, "_block", before.alias("_s"), F.sum("_t").over(W.partitionBy(*keys)).alias("_all"))
    return counts.join(blocks, [*keys, "_block"]).withColumn("_upto", F.col("_s") + F.col("_upto")).drop("_s"), True


def range_join(a: DataFrame, b: DataFrame, width: int, keys: tuple[str, ...] = ("contig",), tolerance: int = 0) -> DataFrame:
    """Pairs of half-open intervals [start, end) of a and b that overlap, or come within `tolerance` of it; b's columns get the prefix b_.

    Each interval goes to the buckets of `width` positions that it touches, so the join is an equi-join; a pair counts in the
    bucket of the larger start only, so it comes out once.
    """
    buckets = lambda s, e: F.explode(F.sequence(F.floor(s / width), F.floor(F.greatest(s, e - 1) / width)))
    b = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    b = b.withColumn("_s", F.col("b_start") - tolerance).withColumn("_e", F.col("b_end") + tolerance)
    left, right = a.withColumn("_bucket", buckets(F.col("start"), F.col("end"))), b.withColumn("_b_bucket", buckets(F.col("_s"), F.col("_e")))
    on = F.col("_bucket") == F.col("_b_bucket")
    for k in keys:
        on = on & (F.col(k) == F.col(f"b_{k}"))
    hit = (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")) & (F.col("_bucket") == F.floor(F.greatest("start", "_s") / width))
    return left.join(right, on & hit).drop("_bucket", "_b_bucket", "_s", "_e")
