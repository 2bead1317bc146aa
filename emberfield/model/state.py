"""Fits from sums kept by part of the data: a year is added, replaced or taken back without reading the others.

A state is a table with a row per part (a year, a file): its rows, the means of design and response, and their products about
these means. Two rows are merged by moving both to their common means, where nothing cancels. A part is taken back by leaving out its row,
which is exact; no sum is ever subtracted. The fit reads the state alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .design import is_complete, terms
from .fit import Fit, log_fit_of
from .gram import GROUPS, check_terms

STATE = "part string, names array<string>, rows long, zeros long, dropped long, mean array<double>, scatter array<double>"
# Parts a task holds before it passes on what it has; a part may then have more rows on the way.
HELD = 256
# Tasks' sums of one part are merged in so many groups before they meet.
SALTS = 32


@dataclass
class Sums:
    """Counts, means and products about the means of rows [X y] without the intercept."""

    rows: int = 0
    zeros: int = 0
    dropped: int = 0
    mean: np.ndarray | None = None
    scatter: np.ndarray | None = None

    @classmethod
    def of(cls, Z: np.ndarray, zeros: int = 0, dropped: int = 0) -> Sums:
        if not len(Z):
            return cls(0, zeros, dropped)
        mean = Z.mean(axis=0)
        C = Z - mean
        return cls(len(Z), zeros, dropped, mean, C.T @ C)

    def add(self, other: Sums) -> None:
        self.zeros += other.zeros
        self.dropped += other.dropped
        if not other.rows:
            return
        if not self.rows:
            self.rows, self.mean, self.scatter = other.rows, other.mean, other.scatter
            return
        n = self.rows + other.rows
        gap = other.mean - self.mean
        self.scatter = self.scatter + other.scatter + np.outer(gap, gap) * (self.rows * (other.rows / n))
        self.mean = self.mean + gap * (other.rows / n)
        self.rows = n


def _rows(held: Mapping[tuple, Sums]) -> Iterator[pa.RecordBatch]:
    numbers = pa.list_(pa.float64())
    for (part, names), s in held.items():
        mean = [] if s.mean is None else s.mean
        scatter = [] if s.scatter is None else s.scatter.ravel()
        yield pa.RecordBatch.from_arrays([
            pa.array([part], pa.string()), pa.array([list(names)], pa.list_(pa.string())), pa.array([s.rows], pa.int64()), pa.array([s.zeros], pa.int64()),
            pa.array([s.dropped], pa.int64()), pa.array([mean], numbers), pa.array([scatter], numbers),
        ], names=["part", "names", "rows", "zeros", "dropped", "mean", "scatter"])


def _gathered(found: Iterator[tuple[tuple, Sums]]) -> Iterator[pa.RecordBatch]:
    """Sums added by key. What comes sorted by key leaves as one row per key; what does not may leave as several."""
    held: dict[tuple, Sums] = {}
    for key, sums in found:
        if key not in held and len(held) >= HELD:
            yield from _rows(held)
            held = {}
        held.setdefault(key, Sums()).add(sums)
    yield from _rows(held)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found() -> Iterator[tuple[tuple, Sums]]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, names, rows, zeros, dropped = (batch.column(c)[i].as_py() for c in ("part", "names", "rows", "zeros", "dropped"))
                sums = Sums(rows, zeros, dropped)
                if rows:
                    sums.mean, flat = (batch.column(c)[i].values.to_numpy() for c in ("mean", "scatter"))
                    sums.scatter = flat.reshape(len(sums.mean), -1)
                yield (part, tuple(names)), sums

    return _gathered(found())


def merge_states(state: DataFrame, *more: DataFrame) -> DataFrame:
    """One state of several: rows of equal part and design are added up, in two steps if a part has many. Parts of other designs stay apart."""
    for s in more:
        state = state.unionByName(s)
    keys = ["part", "names"]
    state = state.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).repartition(*keys, "salt").sortWithinPartitions(*keys).drop("salt")
    state = state.mapInArrow(_merged, STATE)
    return state.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merged, STATE)


def fit_state(df: DataFrame, response: str, spec: Mapping, part: str | Column) -> DataFrame:
    """The state of a (hurdle) lognormal fit, a row per value of ``part``; one pass over ``df``.

    A row of ``df`` is used if it is complete and its response is above zero; complete rows at zero are counted as ``zeros``, all others
    as ``dropped``. A missing part is a part of its own. A part without a used row has counts only, and an empty table has no part.
    Tasks add up what they read, so a part may hold any share of the rows.
    """
    names = tuple(t.name for t in terms(spec))
    check_terms(len(names) + 1)
    y = F.col(response).cast("double")
    kind = F.when(is_complete(spec) & (y > 0), 0).when(is_complete(spec) & (y == 0), 1).otherwise(2)
    x = F.array(*[t.expr for t in terms(spec)][1:], F.log(y))
    part = F.col(part) if isinstance(part, str) else part
    width = len(names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[tuple, Sums]]:
            for batch in batches:
                coded = batch.column("part").dictionary_encode(null_encoding="encode")
                values, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                kinds = batch.column("kind").to_numpy()
                Z = batch.column("z").drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                used = code[kinds == 0]
                for i, value in enumerate(values):
                    zeros, dropped = (int(((code == i) & (kinds == k)).sum()) for k in (1, 2))
                    yield (value, names), Sums.of(Z[used == i], zeros, dropped)

        return _gathered(found())

    rows = df.select(part.cast("string").alias("part"), kind.alias("kind"), F.when(kind == 0, x).alias("z"))
    return merge_states(rows.mapInArrow(work, STATE))


def _total(state: DataFrame, names: Sequence[str]) -> Sums:
    """All parts as one, on the driver; a state of another design is refused."""
    found = state.withColumn("part", F.lit(None).cast("string")).mapInArrow(_merged, STATE).repartition(GROUPS).mapInArrow(_merged, STATE).collect()
    total = Sums()
    for r in found:
        if list(r["names"]) != list(names):
            raise ValueError(f"the state is of another design: {list(r['names'])}")
        size = len(r["mean"])
        total.add(Sums(r["rows"], r["zeros"], r["dropped"], np.array(r["mean"]), np.array(r["scatter"]).reshape(size, size)))
    return total


def fit_from_state(state: DataFrame, response: str, spec: Mapping, prior_sd: float = 1.0, hurdle: bool = False, fixed: Mapping[str, float] | None = None) -> Fit:
    """The fit of all parts of ``state``: that of ``fit_lognormal`` or ``fit_hurdle_lognormal`` on their rows, which are not read."""
    total = _total(state, [t.name for t in terms(spec)])
    if not total.rows:
        raise ValueError("no complete rows to fit")
    m, S = total.mean, total.scatter
    apart = (float(total.rows), m[:-1], float(m[-1]), S[:-1, :-1], S[:-1, -1], float(S[-1, -1]))
    every = total.rows + total.zeros + total.dropped
    return log_fit_of(apart, response, spec, prior_sd, "hurdle_lognormal" if hurdle else "lognormal", fixed, total.rows, total.zeros, every)


def save_state(state: DataFrame, path: str) -> None:
    """Write the parts of ``state`` into the table at ``path``: a part that is there already is replaced, the others stay as they are."""
    slot = F.coalesce(F.concat(F.lit("p"), F.col("part")), F.lit("none"))  # a letter before, so that no folder name reads as a number
    state.withColumn("slot", slot).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(path)


def read_state(spark: SparkSession, path: str, without: Sequence[str] = ()) -> DataFrame:
    """The state at ``path`` but for the parts in ``without``, whose files are not opened."""
    state = spark.read.parquet(path)
    for part in without:
        state = state.filter(F.col("slot") != F.lit(f"p{part}"))
    return state.drop("slot")


def moments(state: DataFrame) -> DataFrame:
    """(part, rows, i, j, mean_i, mean_j, product) for i <= j: the products about the means by position in the design, the response last."""
    p = F.size("mean")
    cells = state.filter("rows > 0").select("part", "rows", "mean", p.alias("p"), F.posexplode("scatter").alias("pos", "product"))
    i, j = F.floor(F.col("pos") / F.col("p")).cast("int"), (F.col("pos") % F.col("p")).cast("int")
    return cells.select("part", "rows", i.alias("i"), j.alias("j"), F.get("mean", i).alias("mean_i"), F.get("mean", j).alias("mean_j"), "product").filter("i <= j")
