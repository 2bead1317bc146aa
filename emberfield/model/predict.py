"""Posterior prediction: every row with every draw.

Two forms give the same numbers. The long form stays in the JVM and yields a row per draw. The
packed form multiplies Arrow batches in numpy and yields an array per row, from which intervals,
contrasts and exceedance follow without any shuffle; use it for large tables.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rng import noise_words, standard_normal, standard_normal_np, student_t, student_t_np, uniform, uniform_np
from .fit import Draws

FAMILIES = ("student", "lognormal", "hurdle_lognormal")
# The draws are broadcast up to this size; beyond it they are joined by draw number.
BROADCAST_BYTES = 256 * 1024 * 1024
# Values held at once by one worker of the packed form.
BATCH_VALUES = 2_000_000


def _check(family: str) -> None:
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family!r}")


def _dot(x: Column, beta: Column, p: int) -> Column:
    """Dot product: plain code up to 64 terms, an array fold beyond."""
    if p <= 64:
        return reduce(lambda a, b: a + b, [F.get(x, F.lit(i)) * F.get(beta, F.lit(i)) for i in range(p)])
    return F.aggregate(F.zip_with(x, beta, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def _with_draws(df: DataFrame, draws: Draws) -> DataFrame:
    """Each row once per draw, with the draw's parameters."""
    m, p = draws.beta.shape
    side = draws.table(df.sparkSession)
    if m * (p + 6) * 8 <= BROADCAST_BYTES:
        side = F.broadcast(side)
    rows = df.withColumn("draw_id", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    return rows.join(side, "draw_id")


def _is_new(site: str, known: Sequence) -> Column:
    return ~F.coalesce(F.col(site).isin(list(known)), F.lit(False)) if known else F.lit(True)


def _with_sums(rows: DataFrame, site: str, sums: DataFrame, p: int) -> DataFrame:
    """``rows`` with the sums of their site, zeros for a site that has none. Spark broadcasts a small table of sites, and splits hot sites of a large one."""
    side = sums.select(F.col("site").alias("_site"), F.col("n").alias("_n"), F.col("sx").alias("_sx"), F.col("sy").alias("_sy"))
    zero = F.array(*[F.lit(0.0)] * p)
    out = rows.join(side, F.col(site) == F.col("_site"), "left")
    return out.withColumns({"_n": F.coalesce("_n", F.lit(0)).cast("double"), "_sx": F.coalesce("_sx", zero), "_sy": F.coalesce("_sy", F.lit(0.0))})


def _measured_from(draws: Draws, shift: Sequence[float] | None) -> np.ndarray:
    """Coefficients for columns measured from ``shift`` (that of the response last)."""
    beta = draws.beta.copy()
    if shift is not None:
        shift = np.asarray(shift, dtype=np.float64)
        beta[:, 0] += beta[:, 1:] @ shift[1:-1] - shift[-1]
    return beta


def predict_draws(
    df: DataFrame, draws: Draws, family: str, key: Sequence[str], x: str = "x", seed: int = 0,
    site: str | None = None, known_sites: Sequence = (), value: str = "value", sums: DataFrame | None = None, shift: Sequence[float] | None = None,
) -> DataFrame:
    """Predicted values in long form: the columns of ``df`` but ``x``, then draw_id and value.

    ``key`` names the columns that identify a row (observation and scenario); noise depends on
    them, the draw and ``seed`` only. A site outside ``known_sites`` gets an effect drawn for
    (site, draw) from the site standard deviation.

    With ``sums`` (site, n, sx, sy), the table of a :class:`~emberfield.model.sites.SiteFit` measured from ``shift``, each site's effect is drawn from its
    conditional mean and variance given the draw; a site without rows there is a new one.
    """
    _check(family)
    keep = [c for c in df.columns if c != x]
    rows = df.withColumn("_w", noise_words(*[F.col(k) for k in key], seed=seed))
    if site:
        rows = rows.withColumn("_s", noise_words(F.lit("site"), F.col(site), seed=seed))
        rows = rows.withColumn("_new", _is_new(site, known_sites))
    p = draws.beta.shape[1]
    if sums is not None:
        if not site:
            raise ValueError("sums of sites need the site column")
        rows = _with_sums(rows, site, sums, p)
    rows = _with_draws(rows, draws)
    eta = _dot(F.col(x), F.col("beta"), p)
    draw = F.col("draw_id")
    if sums is not None:
        at = np.zeros(p + 1) if shift is None else np.asarray(shift, dtype=np.float64)
        base = F.get("beta", F.lit(0)) + sum((F.get("beta", F.lit(i)) * F.lit(float(at[i])) for i in range(1, p)), F.lit(0.0)) - F.lit(float(at[-1]))
        rest = sum((F.get("_sx", F.lit(i)) * F.get("beta", F.lit(i)) for i in range(1, p)), F.col("_n") * base)
        w = F.when(F.col("sd_site") > 0, F.lit(1.0) / (F.col("_n") + F.pow(F.col("sigma") / F.col("sd_site"), F.lit(2.0)))).otherwise(0.0)
        # A row without a site has no effect, as in the fit.
        effect = w * (F.col("_sy") - rest) + F.col("sigma") * F.sqrt(w) * standard_normal(F.col("_s"), draw)
        eta = eta + F.when(F.col(site).isNotNull(), effect).otherwise(0.0)
    elif site:
        eta = eta + F.when(F.col("_new"), F.col("sd_site") * standard_normal(F.col("_s"), draw)).otherwise(0.0)
    words = F.col("_w")
    if family == "student":
        out = eta + F.col("sigma") * student_t(words, draw, F.col("nu"))
    else:
        out = F.exp(eta + F.col("sigma") * standard_normal(words, draw))
        if family == "hurdle_lognormal":
            out = F.when(uniform(words["c"], draw) < F.col("hu"), 0.0).otherwise(out)
    return rows.select(*keep, "draw_id", out.alias(value))


def expected_draws(df: DataFrame, draws: Draws, family: str, x: str = "x", value: str = "value") -> DataFrame:
    """Expected response of each row under each draw, without observation noise."""
    _check(family)
    keep = [c for c in df.columns if c != x]
    rows = _with_draws(df, draws)
    eta = _dot(F.col(x), F.col("beta"), draws.beta.shape[1])
    if family == "student":
        out = eta
    else:
        out = F.exp(eta + F.col("sigma") * F.col("sigma") / 2)
        if family == "hurdle_lognormal":
            out = (1 - F.col("hu")) * out
    return rows.select(*keep, "draw_id", out.alias(value))


def predict_packed(
    df: DataFrame, draws: Draws, family: str, key: Sequence[str], x: str = "x", seed: int = 0,
    site: str | None = None, known_sites: Sequence = (), out: str = "draws", sums: DataFrame | None = None, shift: Sequence[float] | None = None,
) -> DataFrame:
    """The same predictions with all draws of a row in one array, in draw order.

    Draws of more than BROADCAST_BYTES are not broadcast: the long form, which joins them by number, is then packed by a shuffle.
    """
    _check(family)
    keep = [c for c in df.columns if c != x]
    if draws.beta.size * 8 > BROADCAST_BYTES:
        long = predict_draws(df, draws, family, key, x, seed, site, known_sites, "_value", sums, shift)
        values = F.array_sort(F.collect_list(F.struct("draw_id", "_value")))
        return long.groupBy(*keep).agg(F.transform(values, lambda v: v["_value"]).alias(out))
    w = noise_words(*[F.col(k) for k in key], seed=seed)
    extra = [F.col("_w.a").alias("_wa"), F.col("_w.b").alias("_wb"), F.col("_w.c").alias("_wc")]
    rows = df.withColumn("_w", w)
    if site:
        s = noise_words(F.lit("site"), F.col(site), seed=seed)
        rows = rows.withColumn("_s", s)
        extra += [F.col("_s.a").alias("_sa"), F.col("_s.b").alias("_sb"), _is_new(site, known_sites).alias("_new")]
    if sums is not None:
        if not site:
            raise ValueError("sums of sites need the site column")
        rows = _with_sums(rows, site, sums, draws.beta.shape[1])
        extra += ["_n", "_sx", "_sy", F.col(site).isNotNull().alias("_sited")]
    rows = rows.select(*keep, x, *extra)
    shared = df.sparkSession.sparkContext.broadcast({
        "beta": draws.beta, "from_shift": _measured_from(draws, shift) if sums is not None else None, **{n: draws.column(n) for n in ("sigma", "nu", "hu", "sd_site")}
    })
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, T.ArrayType(T.DoubleType(), False))])
    m = len(draws)
    step = max(1, BATCH_VALUES // m)
    sums_given = sums is not None

    def values(batch: pa.RecordBatch, d: dict) -> np.ndarray:
        def col(name):
            return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)

        flat = batch.column(batch.schema.get_field_index(x)).flatten().to_numpy(zero_copy_only=False)
        eta = np.asarray(flat, dtype=np.float64).reshape(batch.num_rows, -1) @ d["beta"].T
        ids = np.arange(m)
        if sums_given:
            n, sx = col("_n"), np.asarray(batch.column(batch.schema.get_field_index("_sx")).flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)
            rest = n[:, None] * d["from_shift"][:, 0] + sx[:, 1:] @ d["from_shift"][:, 1:].T
            known = d["sd_site"] > 0
            w = np.where(known, 1.0 / (n[:, None] + (d["sigma"] / np.where(known, d["sd_site"], 1.0)) ** 2), 0.0)
            effect = w * (col("_sy")[:, None] - rest) + d["sigma"] * np.sqrt(w) * standard_normal_np(col("_sa"), col("_sb"), ids)
            eta = eta + np.where(col("_sited").astype(bool)[:, None], effect, 0.0)
        elif site:
            effect = d["sd_site"] * standard_normal_np(col("_sa"), col("_sb"), ids)
            eta = eta + np.where(col("_new").astype(bool)[:, None], effect, 0.0)
        a, b, c = col("_wa"), col("_wb"), col("_wc")
        if family == "student":
            return eta + d["sigma"] * student_t_np(a, b, ids, d["nu"])
        v = np.exp(eta + d["sigma"] * standard_normal_np(a, b, ids))
        if family == "hurdle_lognormal":
            v = np.where(uniform_np(c, ids) < d["hu"], 0.0, v)
        return v

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                v = values(batch, d)
                offsets = pa.array(np.arange(0, v.size + 1, m, dtype=np.int32))
                packed = pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))
                same = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*same, packed], names=[*keep, out])

    return rows.mapInArrow(work, schema)
