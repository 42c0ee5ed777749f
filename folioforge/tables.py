"""The tables of a data folder, and the removal of repeated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    For expensive functions over a table of few files: where a scan has fewer tasks than cores, rows are dealt
    out anew. Large tables have more tasks than that and stay as they lie, as does what comes out of a shuffle
    (which isn't run to find out). The rows are the same.
    """
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName().startswith("AdaptiveSparkPlan"):  # it has a shuffle or a broadcast
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if plan.execute().getNumPartitions() >= cores else df.repartition(cores)


def unique_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Repeated rows count once: one row for each key.

    For rows that are copies of each other in the columns read; of differing rows any one stays,
    so callers select the columns they need first. Partial aggregation precedes the shuffle.
    """
    return df.dropDuplicates(list(keys))


#: Keys, as text, that are broadcast to tell rows that stand more than once from the others.
KEY_BYTES = 32 << 20


def unique_in_place(df: DataFrame, key: str) -> DataFrame:
    """Repeated rows count once, as in ``unique_rows``, for wide rows of which few are repeated.

    Keys alone are counted first. Rows whose key stands once stay where they lie; only those of repeated keys
    are shuffled, a row a partition for a key at most. Where more keys are repeated than may be broadcast, all are.
    """
    repeated = df.groupBy(key).count().where("count > 1").select(key)
    n, size = repeated.agg(F.count("*"), F.sum(F.octet_length(F.col(key).cast("string")))).first()
    if not n:
        return df
    if (size or 0) > KEY_BYTES:
        return df.dropDuplicates([key])
    repeated = F.broadcast(repeated.withColumnRenamed(key, "__key"))
    same = df[key].eqNullSafe(F.col("__key"))
    return df.join(repeated, same, "left_anti").unionByName(df.join(repeated, same, "left_semi").dropDuplicates([key]))


def latest_rows(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """For each key the row that comes first in ``order``; ties need a total order from the caller."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
