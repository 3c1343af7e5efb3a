"""Session helpers that every operator shares: lineage cuts, shared folders and distributed running totals."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spansense.errors import ConfigError

#: Rows from which on a join looks for hot keys, and how many times an even share of a task's rows makes a key hot.
HOT_ROWS, HOT_SHARE = 2_000_000, 2


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's ``spark.checkpoint.dir``. Only in local mode, for tests, one is made where that is unset; on a cluster it is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ConfigError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spansense-checkpoint-"))
    return sc.getCheckpointDir() or named or ""


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a lost executor costs a read and not a recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_total(
    df: DataFrame, groups: list[str], order_hash: str, ties: list[str], value: str, before: str, *, bucket_bits: int = 12, first: Column | None = None
) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows of the same ``groups`` that come earlier in the order ``(order_hash, *ties)``.

    No group is ever sorted in one task. The order column is a 64-bit hash, so its top ``bucket_bits`` bits cut each group into
    equal buckets; the bucket totals (at most ``2**bucket_bits`` rows a group) are summed up in a small window and every bucket is then
    ordered on its own. Rows for which ``first`` holds come before all buckets, in the same inner order; the caller bounds their number.
    """
    bucket = F.shiftrightunsigned(F.col(order_hash).bitwiseXOR(F.lit(-(2**63))), 64 - bucket_bits)
    if first is not None:
        bucket = F.when(first, F.lit(-1).cast("bigint")).otherwise(bucket)
    rows = df.withColumn("_bucket", bucket)
    keys = [*groups, "_bucket"]
    totals = rows.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*[F.col(g) for g in groups] or [F.lit(0)]).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    left, right = rows.alias("l"), totals.alias("r")
    match = F.col("l._bucket") == F.col("r._bucket")
    for g in groups:
        match = match & F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
    inner = Window.partitionBy(*keys).orderBy(order_hash, *ties).rowsBetween(Window.unboundedPreceding, -1)
    joined = left.join(right, match).select("l.*", F.col("r._base").alias("_base"))
    return joined.withColumn(before, F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_bucket", "_base")


def skew_join(big: DataFrame, small: DataFrame, on: list[str], *, how: str = "inner", rows: int | None = None) -> DataFrame:
    """``big`` joined (``inner`` or ``left``) to ``small``, which has at most one row per key of ``on``, without moving the rows of hot keys.

    A key is hot if it has more than ``HOT_SHARE`` times an even share of a task's rows; there can be fewer of these than tasks, which bounds what is broadcast:
    the rows of ``small`` with hot keys. All others are joined by shuffling. Below ``HOT_ROWS`` rows of ``big`` no key can be much for a task and one plain join does;
    the result is the same. ``big`` is read twice, so it should be a stored table. Null keys match nothing.
    """
    n = big.count() if rows is None else rows
    if n < HOT_ROWS:
        return big.join(small, on, how)
    share = HOT_SHARE * n / wide(big.sparkSession)
    hot = checkpointed(big.groupBy(*on).agg(F.count(F.lit(1)).alias("_hot")).where(F.col("_hot") > share).select(*on, F.lit(True).alias("_hot")))
    marked = big.join(F.broadcast(hot), on, "left")
    matches = F.broadcast(small.join(F.broadcast(hot.drop("_hot")), on, "left_semi"))
    few = marked.where("_hot").drop("_hot").join(matches, on, how)
    return marked.where("_hot is null").drop("_hot").join(small, on, how).unionByName(few)


def wide(spark: SparkSession) -> int:
    """Partitions for work that is heavy for its bytes: the session's shuffle partitions, but three tasks a core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, order: str | None = None) -> DataFrame:
    """``df`` in :func:`wide` partitions if it has fewer than there are cores. Input that is read in more, as large input is, isn't moved.

    ``order`` names a unique column to sort moved partitions by, for work that must come out alike whenever a task is run again.
    """
    if df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    moved = df.repartition(wide(df.sparkSession))
    return moved.sortWithinPartitions(order) if order else moved
