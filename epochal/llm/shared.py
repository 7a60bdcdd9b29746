"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialize, shared_dir  # noqa: F401  for the operators beside this module


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """Runs a function over the Arrow batches of each partition; ``make`` builds it once per task."""

    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            out = f(batch.rename_columns(names))
            if out is not None and out.num_rows:
                yield out

    # Columns go under plain names, as mapInArrow takes a dot in a name for a field.
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, schema)


def unused(name: str, columns: Iterable[str]) -> str:
    """A column name like ``name`` that isn't among the columns, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def own(df: DataFrame) -> list:
    """A table's columns as they are named, whatever characters the names have."""
    return [F.col(f"`{c}`") for c in df.columns]


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def chunked(df: DataFrame, key: Iterable[str], text: str, size: int) -> DataFrame:
    """One row per piece of ``size`` code points: the key columns, chunk (from 0), piece."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(text), i * size + 1, F.lit(size)))
    return df.select(*key, F.posexplode(pieces).alias("chunk", "piece"))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies: a path is taken as it is, a bare name is looked up."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
