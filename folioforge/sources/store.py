"""Tables kept as Parquet, JSON lines for exchange, and a database where a driver for it is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The part of a day or an owner that a table is laid out by, for pruning.
PARTITIONS = {"usage_records": "created_day", "jobs": "created_day"}


def save(df: DataFrame, folder: str, name: str, mode: str = "overwrite") -> None:
    """Writes a table; those with a time are laid out by day, so a range of days reads only its own."""
    if name in PARTITIONS:
        df = df.withColumn(PARTITIONS[name], F.to_date("created_at")).repartition(PARTITIONS[name])
        df.write.mode(mode).partitionBy(PARTITIONS[name]).parquet(f"{folder}/{name}.parquet")
    else:
        df.write.mode(mode).parquet(f"{folder}/{name}.parquet")


def load(spark: SparkSession, folder: str, name: str, schema: StructType | None = None) -> DataFrame:
    """A table; with a schema one without any rows, which has no files, can be read too."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def bucketed(df: DataFrame, name: str, buckets: int, key: str = "document_id") -> None:
    """A table bucketed by document, so that joins between such tables need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


#: Times in JSON keep their microseconds.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def import_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a given schema; broken lines come out in the column ``broken``.

    Lines are read as texts, so that any columns may be asked for, ``broken`` alone included.
    """
    options = {"columnNameOfCorruptRecord": "broken", "timestampFormat": TIME_FORMAT}
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.from_json("value", f"{schema}, broken string", options).alias("j")).select("j.*")


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("timestampFormat", TIME_FORMAT).json(path)


def database(spark: SparkSession, url: str, name: str, user: str, password: str, key: str | None = None, parts: int = 16,
             low: int = 0, high: int = 1_000_000) -> DataFrame:
    """A table of a database by JDBC, read in ranges of a numeric key if one is named."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, user=user, password=password)
    if key:
        reader = reader.options(partitionColumn=key, numPartitions=parts, lowerBound=low, upperBound=high)
    return reader.load()


def to_database(df: DataFrame, url: str, name: str, user: str, password: str, mode: str = "append", parts: int = 16) -> None:
    """Writes a table of a database by JDBC, over so many connections at most."""
    n = min(parts, max(1, df.rdd.getNumPartitions()))
    options = {"url": url, "dbtable": name, "user": user, "password": password, "isolationLevel": "READ_COMMITTED"}
    df.coalesce(n).write.format("jdbc").mode(mode).options(**options).save()
