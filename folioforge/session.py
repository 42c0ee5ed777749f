"""Session settings and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, name: str = "folioforge") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FOLIOFORGE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the session names none (tests on one machine) a local folder is made and set. The
    checkpoint folder of the context is set as well, so ``DataFrame.checkpoint`` works.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = getattr(shared_dir, "_own", None)
        if named is None:
            named = shared_dir._own = tempfile.mkdtemp(prefix="folioforge-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def written(df: DataFrame, label: str, *by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, lost executors don't matter, and
    columns can be pruned when it is read, as can folders of the values of columns named. The table is removed by ``remove_written``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    kept_until_end(spark, path)
    return spark.read.parquet(path)


def kept_until_end(spark: SparkSession, path: str) -> None:
    """Has a path removed by ``remove_written``, or when the driver ends."""
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    _WRITTEN.append(path)


_WRITTEN: list[str] = []


def _file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def file_state(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and time of the last change of a file or folder, to tell whether a table is still the same."""
    fs, at = _file_system(spark, path)
    return fs.getContentSummary(at).getLength(), fs.getFileStatus(at).getModificationTime()


def remove_written(spark: SparkSession) -> int:
    """Removes the tables that ``written`` has made so far; for use between jobs, when no result of theirs is
    still to be read. Gives their number."""
    n = len(_WRITTEN)
    while _WRITTEN:
        fs, at = _file_system(spark, _WRITTEN.pop())
        fs.delete(at, True)
        fs.cancelDeleteOnExit(at)
    return n


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the session's Python workers, once a context.

    Functions that run on executors are pickled by reference, so the workers must be able to import
    the package wherever the driver's working directory is.
    """
    sc = spark.sparkContext
    if getattr(ship, "_context", None) != sc.applicationId:
        here = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="folioforge-"), "folioforge-code.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for folder, _, names in os.walk(here):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        archive.write(full, os.path.relpath(full, os.path.dirname(here)))
        sc.addPyFile(path)
        ship._context = sc.applicationId
    return spark
