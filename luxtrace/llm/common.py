"""What the document operators share: batch sizes, the shared folder and row plumbing."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luxtrace.shared import shared_dir

#: Arrow batches handed to Python hold at most so many rows and bytes, whatever the length of the texts.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the memory of Arrow exchanges for this session; very long texts would else make huge batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*done: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``done``; an empty table has no file to find its folder by and stays."""
    for df in done:
        spark = df.sparkSession
        for f in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession, *done: DataFrame) -> None:
    """``drop``, and let Spark delete shuffle files that no live plan refers to."""
    drop(*done)
    gc.collect()
    spark._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; where its files make fewer partitions than there are cores, its rows are dealt to all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name can do no harm."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def map_rows(df: DataFrame, rows: Callable[[Iterable[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``rows`` turns an iterator of row tuples into an iterator of result tuples, in Arrow batches of bounded size.

    It is called once per task, so it can keep state such as a cache.
    """
    out = df.sparkSession.createDataFrame([], schema).schema
    arrow = _arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        held: list[tuple] = []
        size = 0
        for r in rows(given()):
            held.append(r)
            size += sum(len(v) if isinstance(v, (bytes, str, list)) else 8 for v in r)
            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield _batch(held, arrow)
                held, size = [], 0
        if held:
            yield _batch(held, arrow)

    return df.mapInArrow(run, out)


def keep_rows(df: DataFrame, keeper: Callable[[], Callable[[tuple], bool]]) -> DataFrame:
    """The rows of ``df`` for which the function that ``keeper`` makes (once a task) is true; columns of any name."""
    names = df.columns
    plain = df.toDF(*[f"c{k}" for k in range(len(names))])

    def rows(it: Iterable[tuple]) -> Iterator[tuple]:
        return filter(keeper(), it)

    return map_rows(plain, rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)).toDF(*names)


def map_columns(df: DataFrame, columns_of: Callable[[tuple], Iterable[tuple]], schema: str) -> DataFrame:
    """``columns_of`` takes a row and yields tuples of numpy arrays of equal length, which become rows of the result."""
    out = df.sparkSession.createDataFrame([], schema).schema
    arrow = _arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [p for r in zip(*(c.to_pylist() for c in b.columns), strict=True) for p in columns_of(r)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), type=f.type) for c, f in zip(zip(*parts, strict=True), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, out)


def _arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file: below ``LUXTRACE_TOKENIZERS`` if set, else in the installed package."""
    base = os.environ.get("LUXTRACE_TOKENIZERS")
    if base:
        return os.path.join(base, name)
    import public_tokenizers

    return public_tokenizers.path(name)
