"""Shared plumbing: table access, shared-folder tables and their removal, Arrow mapping."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.work import fresh_path, python_ready, spread

#: Raw text that one task is meant to hold; only sets how many partitions there are.
PARTITION_BYTES = 16 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a function over Arrow batches gets at once.
BATCH = 128

#: Tables written and not yet deleted, a list for each open `scratch`.
_open: list[list[DataFrame]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; one that is read as fewer partitions than there are cores is dealt out over them."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def materialize(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and reread it: lineage ends there.

    A lost executor then costs only the tasks it ran; the written files stay until the
    `scratch` around the call ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # what was shuffled to make the files is not needed once they are written
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    if _open:
        _open[-1].append(out)
    return out


def released(*frames: DataFrame) -> None:
    """Delete what `materialize` wrote for these frames."""
    for df in frames:
        path = getattr(df, "_quarry_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what was materialized inside, but for frames given to what it yields."""
    _open.append([])
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        made = _open.pop()
        released(*[df for df in made if not any(df is k for k in kept)])
        if _open:
            _open[-1] += kept


def map_arrow(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """One Arrow batch in, one out, of BATCH rows at most; rows stream, so memory is a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                if (out := make(batch.slice(start, BATCH))) is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small_batches(spark: SparkSession) -> None:
    """Make executors ready for Python and cap Arrow batches, at the same size for all operators, as frames run later."""
    python_ready(spark)


def parts_for(spark: SparkSession, rows: int, per_part: int) -> int:
    """Partitions so that each gets about per_part rows, at least the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns under names of ours, so extra or clashing ones do no harm."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()])


def as_row(df: DataFrame) -> Column:
    """All columns of df in one struct, so that no name of theirs meets one of ours."""
    return F.struct(*[F.col(f"`{name}`") for name in df.columns])


def text_digest(text: str = "text") -> Column:
    """Tells a row's text from others; empty for a null text."""
    return F.coalesce(F.md5(F.col(text).cast("string").cast("binary")), F.lit(""))


def vocabulary_path(path: str | None, default: str = "byte_bpe_50k.json") -> str:
    if path:
        return path
    import public_tokenizers

    return os.fspath(public_tokenizers.path(default))
