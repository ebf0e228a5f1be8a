"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycell.session import checkpoint_folder

SLICE_BYTES = 4 << 20
SALTS = 16

#: A-Z to a-z, every other byte unchanged.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece holds about ``limit`` bytes of ``column`` (one longer text stays whole)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(lengths):
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


_open = threading.local()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/tallycell-{name}-{uuid.uuid4().hex}"
    if scopes := getattr(_open, "scopes", None):
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Remove what ``written`` writes inside the block when it ends. The block gets a function to use in place of ``written`` for what
    is read after it; nothing else that was made inside may be."""
    scopes = _open.scopes = getattr(_open, "scopes", [])
    made: list[str] = []
    scopes.append(made)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        path = made.pop()
        if len(scopes) > 1:
            scopes[-2].append(path)
        return out

    try:
        yield keep
    finally:
        scopes.pop()
        for name in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def attach(left: DataFrame, right: DataFrame, keys: list[str], spread: list[Column], how: str = "left") -> DataFrame:
    """Join ``left`` to ``right`` (one row per key) where a key may hold a large share of ``left``.

    Every key is dealt over SALTS partitions: left rows by the hash of ``spread``, right rows in SALTS copies. Spark takes the copies
    for as large as the rows they are made of and would broadcast up to SALTS times its threshold, so they are merged instead.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
