"""Stage tables laid out for what reads them: clustered by a join key, or in folders by date."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_clustered(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """``df`` as table ``name`` at ``path``, hashed by ``keys`` into ``buckets`` sorted files (one per bucket), and read back.

    Two such tables with equal keys and numbers of buckets are joined, and one is grouped by its keys, without a shuffle. Keys are meant to be (nearly)
    unique, such as an observation: a key with a large share of the rows fills one file. ``buckets`` is the session's number of shuffle
    partitions unless given. The name lasts as long as the session's catalog, the files stay: :func:`open_clustered` names them anew.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt by the hash that names the buckets, so that a task writes one file.
    rows = df.repartition(n, *keys)
    rows.write.format("parquet").mode("overwrite").bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def open_clustered(spark: SparkSession, name: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """The files of :func:`write_clustered` as a table again, in a session whose catalog does not know it. Keys and buckets must be those written."""
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    by = ", ".join(map(quoted, keys))
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {int(buckets)} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def write_dated(df: DataFrame, path: str, date: str) -> None:
    """``df`` in a folder per day of column ``date``; days that ``df`` holds are replaced, all others stay as they are.

    Rows are rebalanced by day before they are written: days of few rows share a task and have one file, a day of many is split into files of a
    fair size. Rows without a day have a folder of their own. Other columns stay as they are.
    """
    if not isinstance(df.schema[date].dataType, T.DateType):
        raise ValueError(f"{date!r} is no date")
    df.hint("rebalance", F.col(date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def read_dated(spark: SparkSession, path: str, date: str, start: str | dt.date | None = None, end: str | dt.date | None = None) -> DataFrame:
    """The table of :func:`write_dated`, or its days from ``start`` to ``end``: folders of other days are not opened."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(date) <= F.lit(end).cast("date"))
    return df
