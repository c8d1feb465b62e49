"""Where intermediate tables live, and how this package reaches the executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Limits of an Arrow batch, for every operator, as a batch is what a worker holds: rows, and bytes, as texts may be long.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4096", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def _local_folder(prefix: str) -> str:
    """A folder of this machine that goes with the process."""
    path = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder all executors share; a folder of our own in local mode only."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if (own := spark.conf.get("quarry.work.dir", None)) is None:
        own = f"file://{_local_folder('quarry-')}"
        spark.conf.set("quarry.work.dir", own)
    return own


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the work folder that nothing has."""
    return f"{work_dir(spark)}/quarry-{uuid.uuid4().hex}-{re.sub('[^A-Za-z0-9]+', '_', label)}"


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it was read as fewer partitions than there are: one small file is one task otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, label: str, sort: tuple[str, ...] = ()) -> DataFrame:
    """df as Parquet in the work folder, reread; sorted within files by `sort`, so scans can skip row groups."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    (df.sortWithinPartitions(*sort) if sort else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a Parquet scan makes at once where texts are read: it holds them on the heap, in arrays that are doubled as they fill.
TEXTS_AT_ONCE = "256"


@contextmanager
def reading_texts(spark: SparkSession) -> Iterator[None]:
    """What runs here scans Parquet by few rows at once."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    was = spark.conf.get(name)
    spark.conf.set(name, TEXTS_AT_ONCE)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def python_ready(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, and bound their Arrow batches."""
    sc = spark.sparkContext
    for name, value in BATCH_LIMITS.items():
        spark.conf.set(name, value)
    if spark.conf.get("quarry.shipped", None) != sc.applicationId:
        spark.conf.set("quarry.shipped", sc.applicationId)
        root = Path(__file__).parents[1]
        archive = Path(_local_folder("quarry-code-")) / "quarry.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        sc.addPyFile(str(archive))
