"""Readers for sampling and weather tables, and stage tables as the only sink."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import as_number
from .schemas import SOURCES, Source


def read_delimited(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, na: str = "NA"
) -> DataFrame:
    """CSV files with a header row and a declared schema; ``na`` marks a missing cell."""
    return (
        spark.read.option("header", True)
        .option("nullValue", na)
        .option("enforceSchema", True)
        .schema(schema)
        .csv(paths if isinstance(paths, str) else list(paths))
    )


def _parse_date(col: Column) -> Column:
    stamp = F.try_to_timestamp(col, F.lit("yyyy/MM/dd HH:mm:ss"))
    return F.coalesce(stamp.cast("date"), F.try_to_date(col, "yyyy-MM-dd"))


def _convert(col: Column, kind: str) -> Column:
    if kind == "date":
        return _parse_date(col)
    if kind == "double":
        return as_number(col)
    if kind == "flag":  # TRUE counts as one; numbers pass through
        return F.coalesce(as_number(col), col.try_cast("boolean").cast("double"))
    return col


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names in the first line of a file or folder of files."""
    return [c.lstrip("\ufeff") for c in spark.read.option("header", True).csv(path).columns]


def load_observations(spark: SparkSession, path: str | Sequence[str], source: str | Source) -> DataFrame:
    """Sampling file with canonical names and types; unreadable cells become NULL.

    Columns are found by their headers, in any order; a header may be spelled with other signs between its
    words, as in ``Total Phyto`` for ``Total.Phyto``. A header that is missing or not known is an error. Files of
    different layouts are matched each by its own headers.
    """
    spec = SOURCES[source] if isinstance(source, str) else source
    paths = [path] if isinstance(path, str) else list(path)
    frames = []
    for one in paths:
        found = [spec.canonical(h) for h in _header(spark, one)]
        names = {name for _, name, _ in spec.columns}
        if len(found) != len(set(found)) or set(found) != names:
            raise ValueError(f"{one}: headers for {sorted(names - set(found))} are missing, not known: {[h for h, f in zip(_header(spark, one), found) if f not in names]}")
        frames.append(found)
    if any(f != frames[0] for f in frames):
        # Files of several layouts are read each by its own.
        return reduce(DataFrame.unionByName, [load_observations(spark, one, spec) for one in paths])
    kinds = {name: kind for _, name, kind in spec.columns}
    raw = read_delimited(spark, paths, T.StructType([T.StructField(name, T.StringType()) for name in frames[0]]))
    return raw.select(*[_convert(F.col(name), kinds[name]).alias(name) for _, name, _ in spec.columns])


def read_yearly(spark: SparkSession, paths: Sequence[str], schema: T.StructType, na: str = "NA") -> DataFrame:
    """Yearly files of one layout as a single scan."""
    return read_delimited(spark, paths, schema, na)


def drop_embedded_headers(df: DataFrame, *numeric_keys: str) -> DataFrame:
    """Drop heading and metadata rows: rows whose key columns hold no number."""
    for key in numeric_keys:
        df = df.filter(F.col(key).try_cast("int").isNotNull())
    return df


def rename_positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Replace all column names in order; the count must match."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Feature or summary table as Parquet, the boundary between two jobs."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
