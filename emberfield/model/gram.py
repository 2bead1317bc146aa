"""Sums of products over all rows, the only thing a fit needs from the data.

Each task multiplies its Arrow batches in numpy and emits one small vector; Spark adds the
vectors by position. The data are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The driver holds a p x p matrix and solves it.
MAX_TERMS = 2_000
SQL_TERMS = 12
# Vectors of more numbers than this are added in a few groups before they go to the driver.
SHORT_VECTOR, GROUPS = 2_048, 32


# Rows are packed into blocks of about this many bytes for repeated passes.
BLOCK_BYTES = 1024 * 1024
TOTALS = "pos bigint, value double"


def _totals(statistics: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sum of a task's vectors as rows (pos, value); position -1 marks the task."""
    total = None
    for v in statistics:
        total = v if total is None else total + v
    if total is not None:
        pos = np.arange(-1, len(total), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(np.concatenate([[1.0], total]))], names=["pos", "value"])


def _joined(batch: pa.RecordBatch) -> np.ndarray:
    """[X y] of a batch with an array column and a number column."""
    flat = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    y = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=np.float64)
    return np.column_stack([flat.reshape(batch.num_rows, -1), y])


def sum_statistics(df: DataFrame, x: str, y: str, statistic: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Sum of ``statistic([X y])``, a flat vector, over all rows: rows (pos, value).

    Position -1 holds the number of tasks that had rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _totals(statistic(_joined(b)) for b in batches if b.num_rows)

    rows = df.select(x, F.col(y).cast("double").alias(y))
    return rows.mapInArrow(work, TOTALS).groupBy("pos").agg(F.sum("value").alias("value"))


def pack_blocks(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Rows of [X y] as binary blocks, so that later passes read them without conversion."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            Z = _joined(batch)
            step = max(1, BLOCK_BYTES // (8 * Z.shape[1]))
            pieces = [Z[i:i + step].tobytes() for i in range(0, len(Z), step)]
            widths = pa.array([Z.shape[1]] * len(pieces), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary()), widths], names=["block", "width"])

    return df.select(x, F.col(y).cast("double").alias(y)).mapInArrow(work, "block binary, width int")


def _summed(vectors: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sum of a task's vectors as one binary row; the last number counts the tasks that had rows."""
    total = None
    for v in vectors:
        total = v if total is None else total + v
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["vector"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _summed(np.frombuffer(v.as_buffer(), dtype=np.float64) for b in batches for v in b.column(0))


def collect_sum(df: DataFrame, statistics: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], length: int) -> tuple[np.ndarray, int]:
    """Sum over all rows of the vectors ``statistics`` gives, on the driver, and the number of tasks that had rows.

    Each task sends one vector of ``length`` numbers; long ones are added in groups before they reach the driver.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> Iterator[np.ndarray]:
            one = 1.0
            for v in statistics(batches):
                yield np.append(v, one)
                one = 0.0

        return _summed(counted())

    sums = df.mapInArrow(work, "vector binary")
    if length > SHORT_VECTOR:
        sums = sums.repartition(GROUPS).mapInArrow(_add, "vector binary")
    rows = [np.frombuffer(r[0], dtype=np.float64) for r in sums.collect()]
    if not rows:
        raise ValueError("no complete rows to fit")
    total = np.sum(rows, axis=0)
    return total[:-1], int(round(total[-1]))


def sum_blocks(blocks: DataFrame, statistic: Callable[[np.ndarray], np.ndarray], length: int) -> tuple[np.ndarray, int]:
    """:func:`collect_sum` of ``statistic([X y])`` over packed blocks."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for block, width in zip(batch.column(0), batch.column(1)):
                yield statistic(np.frombuffer(block.as_buffer(), dtype=np.float64).reshape(-1, width.as_py()))

    return collect_sum(blocks, parts, length)


def sum_rows(df: DataFrame, x: str, y: str, statistic: Callable[[np.ndarray], np.ndarray], length: int = 0) -> tuple[np.ndarray, int]:
    """:func:`collect_sum` of ``statistic([X y])`` over rows."""
    rows = df.select(x, F.col(y).cast("double").alias(y))
    return collect_sum(rows, lambda batches: (statistic(_joined(b)) for b in batches if b.num_rows), length)


def column_sums(Z: np.ndarray) -> np.ndarray:
    return Z.sum(axis=0)


def about(shift: np.ndarray, Z: np.ndarray) -> np.ndarray:
    """[X y] with the columns measured from ``shift``, so that sums of squares keep their digits; the intercept stays one."""
    return Z - shift


def check_terms(p: int) -> None:
    if p > MAX_TERMS:
        raise ValueError(f"{p} terms, at most {MAX_TERMS} are supported")


def joint_products(Z: np.ndarray) -> np.ndarray:
    return (Z.T @ Z).ravel()


def gram(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Upper triangle of [X y]'[X y] as rows (i, j, value); the response has the last index."""
    width = F.size(x) + 1
    size = df.select(width.alias("w")).limit(1).collect()
    if not size:
        return df.sparkSession.createDataFrame([], "i int, j int, value double")
    p = size[0]["w"]
    check_terms(p)
    sums = sum_statistics(df, x, y, joint_products).filter("pos >= 0")
    i, j = F.floor(F.col("pos") / p).cast("int"), (F.col("pos") % p).cast("int")
    return sums.select(i.alias("i"), j.alias("j"), "value").filter("i <= j")


def gram_sql(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same sums for a few plain columns in one JVM aggregation: rows (i, j, value)."""
    if len(columns) > SQL_TERMS:
        raise ValueError(f"more than {SQL_TERMS} columns: use gram()")
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    one = df.agg(*[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"s{i}_{j}") for i, j in pairs])
    cells = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{i}_{j}").alias("value")) for i, j in pairs
    ])
    return one.select(F.inline(cells))


def square(flat: np.ndarray) -> np.ndarray:
    p = int(round(np.sqrt(len(flat))))
    return flat.reshape(p, p)


def gram_matrix(df: DataFrame, x: str = "x", y: str = "y") -> np.ndarray:
    """[X y]'[X y] on the driver."""
    return square(sum_rows(df, x, y, joint_products)[0])
