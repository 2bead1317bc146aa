"""Lognormal fits with an effect for each of any number of sites.

The normal equations of a fit with site effects have the shape of an arrow: a small block for the fixed terms, one
number on the diagonal for each site, and their products. Spark sums each site's rows by ``groupBy``; a pass
over the table of sites adds up what remains of the fixed block once the sites are eliminated (its Schur complement), the driver solves that
small block, and the effects follow row by row in the table. Neither a column nor a number on the driver belongs to a site, so
sites are bounded by the cluster only.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .accelerate import Anderson
from .design import design, terms
from .fit import Draws, _block_sds, _counts, _inverse, _not_settled, _precision, _provisional_means, _update_sds
from .gram import about, check_terms, collect_sum, column_sums, joint_products, square, sum_rows

# Bounds of a site spread, on the scale of the noise, below which effects are none.
LEAST_SPREAD, MOST_SPREAD = 1e-4, 1e4


def site_sums(df: DataFrame, x: str, y: str, site: str, shift: Sequence[float]) -> DataFrame:
    """(site, n, sx, sy): each site's rows and the sums of ``x`` (an array) and ``y`` measured from ``shift`` (that of ``y`` last).

    Rows without a site, or without a value, belong to none. Sums are taken by task before the shuffle, so a site may hold any share of the rows.
    """
    p = len(shift) - 1
    rows = df.filter(F.col(site).isNotNull() & F.col(y).isNotNull())
    sums = [F.sum(F.get(x, F.lit(i)) - F.lit(float(shift[i]))) for i in range(p)]
    return rows.groupBy(F.col(site).alias("site")).agg(F.count("*").alias("n"), F.array(*sums).alias("sx"), F.sum(F.col(y) - F.lit(float(shift[-1]))).alias("sy"))


def _site_moments(table: DataFrame, ratio: float, p: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Sums over sites of w Z'Z and w^2 Z'Z for Z = [sx sy], of w = 1 / (n + ratio), and the number of sites."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            if batch.num_rows:
                Z = np.column_stack([batch.column("sx").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), batch.column("sy").to_numpy()])
                w = 1.0 / (batch.column("n").to_numpy().astype(np.float64) + ratio)
                Y = Z * w[:, None]
                yield np.concatenate([(Z.T @ Y).ravel(), (Y.T @ Y).ravel(), [w.sum(), float(len(w))]])

    size = (p + 1) ** 2
    flat, _ = collect_sum(table.select("n", "sx", "sy"), parts, 2 * size + 2)
    return square(flat[:size]), square(flat[size: 2 * size]), float(flat[-2]), float(flat[-1])


@dataclass
class SiteFit:
    """A fit with site effects. ``beta`` and ``cov`` belong to the fixed terms, the intercept first.

    ``sums`` is the table of :func:`site_sums` and ``shift`` what it was measured from: the effects of any draw follow from them, see
    :func:`~emberfield.model.predict.predict_draws`. ``rows``, ``zeros``, ``dropped``, ``converged`` and ``moved`` as in ``Fit``.
    """

    family: str
    response: str
    spec: Mapping
    site: str
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    sigma: float
    sd_site: float
    sds: dict[str, float]
    sums: DataFrame
    shift: np.ndarray
    sites: int
    rows: int
    edf: float
    zeros: int = 0
    dropped: int = 0
    rounds: int = 1
    converged: bool = True
    moved: float = 0.0

    def effects(self) -> DataFrame:
        """(site, n, effect, sd): mode of each effect and its deviation given the fixed terms."""
        ratio = (self.sigma / self.sd_site) ** 2
        b, at = self.beta[1:], self.beta[0] + self.shift[1:-1] @ self.beta[1:] - self.shift[-1]
        fixed = sum((F.get("sx", F.lit(i + 1)) * F.lit(float(v)) for i, v in enumerate(b)), F.col("n") * F.lit(float(at)))
        w = F.lit(1.0) / (F.col("n") + F.lit(float(ratio)))
        return self.sums.select("site", "n", (w * (F.col("sy") - fixed)).alias("effect"), (F.lit(float(self.sigma)) * F.sqrt(w)).alias("sd"))

    def draws(self, n_draws: int = 1000, seed: int = 0) -> Draws:
        """Draws of the fixed terms and spreads; effects are made where they are used, from the draw and the site's sums."""
        rng = np.random.default_rng(seed)
        beta = rng.multivariate_normal(self.beta, self.cov, size=n_draws, method="eigh")
        free = max(self.rows - self.edf, 1.0)
        sigma = self.sigma * np.sqrt(free / rng.chisquare(free, n_draws))
        hu = rng.beta(1 + self.zeros, 1 + self.rows, n_draws) if self.family == "hurdle_lognormal" else None
        sd = self.sd_site * np.exp(rng.standard_normal(n_draws) / np.sqrt(2.0 * max(self.sites, 1)))
        return Draws(beta, sigma, hu=hu, sd_site=sd)


def fit_sites(
    df: DataFrame, response: str, spec: Mapping, site: str, prior_sd: float = 1.0, hurdle: bool = False,
    fixed: Mapping[str, float] | None = None, rounds: int = 60, tol: float = 1e-8,
) -> SiteFit:
    """Lognormal (or hurdle-lognormal) fit of ``spec`` with a shrunk effect for each value of column ``site``.

    The same fit as with ``spec["site"]``, without a dense term per site, but for a flat prior on the intercept. ``fixed`` gives ``sigma`` or the spread of a block (``site`` for
    the effects) instead of estimating it; with both given one pass over the sites is enough. Else noise and spreads are
    found by accelerated rounds, a pass over the table of sites each. Values at or below zero, and incomplete rows, are dropped and counted; a row without a
    site takes part without an effect.
    """
    if spec.get("site"):
        raise ValueError("name the site column once: it is eliminated here, not a dense term")
    fixed = dict(fixed or {})
    parts = terms(spec)
    p = len(parts)
    check_terms(p + 1)
    blocks = [t.block for t in parts]
    positive, zeros, every = _counts(df, response, spec)
    rows = design(df, spec).filter(F.col(response) > 0).select("x", F.log(response).alias("y"), F.col(site).alias("site"))
    shift = _provisional_means(sum_rows(rows, "x", "y", column_sums)[0])
    G = square(sum_rows(rows, "x", "y", lambda Z: joint_products(about(shift, Z)), len(shift) ** 2)[0])
    table = durable(site_sums(rows, "x", "y", "site", shift))
    n = G[0, 0]
    some = not table.isEmpty()
    sds = {k: fixed.get(k, v) for k, v in _block_sds(blocks).items()}
    sigma, sd = fixed.get("sigma", float(np.sqrt(max((G[-1, -1] - G[0, -1] ** 2 / n) / n, 1e-12)))), fixed.get("site", 0.5)

    def round_(sigma: float, sd: float, sds: Mapping[str, float]):
        ratio = (sigma / sd) ** 2
        M1, M2, total, k = _site_moments(table, ratio, p) if some else (np.zeros((p + 1, p + 1)), np.zeros((p + 1, p + 1)), 0.0, 0.0)
        P = np.append(0.0, _precision(blocks[1:], sds, prior_sd))
        S = G - M1
        V = _inverse(S[:-1, :-1] / sigma**2 + np.diag(P))
        b = V @ S[:-1, -1] / sigma**2
        r = np.append(-b, 1.0)
        q1, q2 = float(r @ M1 @ r), float(r @ M2 @ r)
        rss = float(r @ G @ r) - q1 - ratio * q2
        # Spread of the effects around zero: their squares and their variances.
        variances = sigma**2 * total + float(np.trace(V @ M2[:-1, :-1]))
        edf = p + k - float(np.diag(V) @ P) - variances / sd**2
        fresh = max(rss / max(n - edf, 1.0), 1e-12)
        size = q2 + variances
        fresh_sd = float(np.sqrt((-k + np.sqrt(k * k + 4.0 * size)) / 2.0)) if k else sd
        blocks_sd = _update_sds(b[1:], V[1:, 1:], blocks[1:], dict(sds))
        return b, V, edf, int(k), fixed.get("sigma", float(np.sqrt(fresh))), fixed.get("site", fresh_sd), {x: fixed.get(x, v) for x, v in blocks_sd.items()}

    free = [x for x in ("sigma", "site", *sds) if x not in fixed]
    mixing, moved = Anderson(), 0.0
    for used in range(1, rounds + 1):
        b, V, edf, k, sigma1, sd1, sds1 = round_(sigma, sd, sds)
        if not free:
            break
        now, then = {"sigma": sigma, "site": sd, **sds}, {"sigma": sigma1, "site": sd1, **sds1}
        moved = max(abs(then[x] - now[x]) / sigma1 for x in free)
        if moved < tol:
            break
        step = mixing.next(np.log([now[x] for x in free]), np.log([then[x] for x in free]))
        top = np.log(sigma1)
        now |= dict(zip(free, np.exp(np.clip(step, top + np.log(LEAST_SPREAD), top + np.log(MOST_SPREAD))).tolist()))
        sigma, sd, sds = now["sigma"], now["site"], {x: now[x] for x in sds}
    if moved >= 1e-6:
        _not_settled("site", moved)
    beta = np.append(b[0] + shift[-1] - shift[1:-1] @ b[1:], b[1:])
    back = np.eye(p)
    back[0, 1:] = -shift[1:-1]
    return SiteFit(
        "hurdle_lognormal" if hurdle else "lognormal", response, spec, site, [t.name for t in parts], beta, back @ V @ back.T, sigma, sd, dict(sds), table, shift, k, positive, edf,
        zeros=zeros if hurdle else 0, dropped=every - positive - (zeros if hurdle else 0), rounds=used, converged=moved < 1e-6, moved=moved,
    )
