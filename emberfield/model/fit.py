"""Penalised fits with Gaussian draws for three families.

Priors are those of the analyses: normal(0, prior_sd) on the coefficients and on the intercept at
the mean of the predictors, half-normal(0, 1) on the standard deviation of each smooth and of the
site effects. Spark supplies the sums; the driver solves a p x p system. Draws come from the
Laplace approximation around the mode, not from a sampler, so tails of strongly skewed
posteriors are not reproduced.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .accelerate import Anderson
from .design import design, is_complete, terms
from .gram import about, check_terms, column_sums, joint_products, pack_blocks, square, sum_blocks, sum_rows

# The degrees of freedom of the Student-t family have a gamma(2, 0.1) prior, start here and stay between these bounds.
NU_START, NU_BOUNDS = 7.0, (1.0, 1000.0)
# Rounds that move by less than this, on the scale of the noise, are mixed.
NEAR = 0.05
# Fewer rows than this are not worth spreading.
SPREAD_ROWS = 100_000
# Driver-side updates of the block spreads between two passes, and the bounds of a spread.
SETTLE, SPREAD_BOUNDS = 500, (1e-4, 1e4)


@dataclass
class Draws:
    """Posterior draws: one row of ``beta`` per draw and the other parameters beside it."""

    beta: np.ndarray
    sigma: np.ndarray
    nu: np.ndarray | None = None
    hu: np.ndarray | None = None
    sd_site: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.beta)

    def column(self, name: str) -> np.ndarray:
        value = getattr(self, name)
        return np.zeros(len(self)) if value is None else np.asarray(value, dtype=np.float64)

    def table(self, spark: SparkSession) -> DataFrame:
        """Rows (draw_id, beta, sigma, nu, hu, sd_site)."""
        rest = [self.column(n).tolist() for n in ("sigma", "nu", "hu", "sd_site")]
        rows = list(zip(range(len(self)), self.beta.tolist(), *rest))
        schema = "draw_id int, beta array<double>, sigma double, nu double, hu double, sd_site double"
        return spark.createDataFrame(rows, schema)


@dataclass
class Fit:
    """A fitted model; it carries the response name and its specification.

    ``dropped`` counts rows not used: incomplete ones and those whose response the family has no place for.
    ``converged`` tells whether the last round still moved by more than the tolerance; ``moved`` is how much.
    """

    family: str
    response: str
    spec: Mapping
    names: list[str]
    blocks: list[str]
    slopes: np.ndarray
    slopes_cov: np.ndarray
    center_intercept: float
    center_var: float
    means: np.ndarray
    sigma: float
    rows: int
    edf: float
    nu: float | None = None
    nu_sd: float = 0.0
    zeros: int = 0
    dropped: int = 0
    rounds: int = 1
    converged: bool = True
    moved: float = 0.0
    sds: dict[str, float] = field(default_factory=dict)

    @property
    def beta(self) -> np.ndarray:
        """Coefficients on the uncentred design, the intercept first."""
        return np.concatenate([[self.center_intercept - self.means @ self.slopes], self.slopes])

    @property
    def sites(self) -> list:
        return list(self.spec["site"]["levels"]) if self.spec.get("site") else []

    def draws(self, n_draws: int = 1000, seed: int = 0) -> Draws:
        rng = np.random.default_rng(seed)
        slopes = rng.multivariate_normal(self.slopes, self.slopes_cov, size=n_draws, method="eigh") if len(
            self.slopes
        ) else np.zeros((n_draws, 0))
        center = self.center_intercept + np.sqrt(self.center_var) * rng.standard_normal(n_draws)
        beta = np.column_stack([center - slopes @ self.means, slopes])
        if self.family == "student":
            spread = np.sqrt((self.nu + 3.0) / (2.0 * self.nu * self.rows))
            sigma = self.sigma * np.exp(spread * rng.standard_normal(n_draws))
        else:
            free = max(self.rows - self.edf, 1.0)
            sigma = self.sigma * np.sqrt(free / rng.chisquare(free, n_draws))
        nu = np.full(n_draws, self.nu) if self.nu else None
        if self.nu_sd:  # its logarithm is about normal
            nu = np.clip(nu * np.exp(self.nu_sd * rng.standard_normal(n_draws)), *NU_BOUNDS)
        hu = rng.beta(1 + self.zeros, 1 + self.rows, n_draws) if self.family == "hurdle_lognormal" else None
        sd_site = None
        if "site" in self.sds:  # the log of a spread known from k effects has a variance of about 1 / 2k
            sd_site = self.sds["site"] * np.exp(rng.standard_normal(n_draws) / np.sqrt(2.0 * len(self.sites)))
        return Draws(beta, sigma, nu, hu, sd_site)


def _pull_apart(G: np.ndarray, shift: np.ndarray):
    """Means and centred sums from [1 X y]'[1 X y], where X and y were measured from ``shift``."""
    n = G[0, 0]
    m, ybar = G[0, 1:-1] / n, G[0, -1] / n
    Sxx = G[1:-1, 1:-1] - n * np.outer(m, m)
    Sxy = G[1:-1, -1] - n * m * ybar
    Syy = G[-1, -1] - n * ybar**2
    return n, shift[1:-1] + m, shift[-1] + ybar, Sxx, Sxy, Syy


def _provisional_means(sums: np.ndarray) -> np.ndarray:
    """Where the columns are measured from: their means; the intercept stays as it is."""
    shift = sums / sums[0]
    shift[0] = 0.0
    return shift


def _not_settled(family: str, moved: float) -> None:
    warnings.warn(f"the {family} fit still moved by {moved:.2g} in its last round", RuntimeWarning, stacklevel=3)


def _block_sds(blocks: list[str]) -> dict[str, float]:
    return {b: 0.5 for b in blocks if b not in ("intercept", "fixed")}


def _precision(blocks: list[str], sds: Mapping[str, float], prior_sd: float) -> np.ndarray:
    fixed = 0.0 if np.isinf(prior_sd) else prior_sd**-2
    return np.array([1.0 / sds[b] ** 2 if b in sds else fixed for b in blocks])


def _update_sds(b: np.ndarray, V: np.ndarray, blocks: list[str], sds: dict[str, float]) -> dict[str, float]:
    """Standard deviation of each block at its mode under a half-normal(0, 1) prior."""
    out = {}
    for name in sds:
        at = [i for i, block in enumerate(blocks) if block == name]
        k, size = len(at), float(np.sum(b[at] ** 2) + np.sum(np.diag(V)[at]))
        out[name] = float(np.sqrt(max((-k + np.sqrt(k * k + 4.0 * size)) / 2.0, 1e-8)))
    return out


def _inverse(A: np.ndarray) -> np.ndarray:
    """Inverse of a positive definite matrix; collinear columns share their weight."""
    scale = np.sqrt(np.diag(A))
    scale = np.where(scale > 0, scale, 1.0)
    R = A / np.outer(scale, scale)
    try:
        L = np.linalg.cholesky(R)
        sound = L.size == 0 or np.diag(L).min() > 1e-6
    except np.linalg.LinAlgError:
        sound = False
    if sound:
        half = np.linalg.inv(L)
        inverse = half.T @ half
    else:
        inverse = np.linalg.pinv(R, rcond=1e-10, hermitian=True)
    return inverse / np.outer(scale, scale)


def _solve(Sxx, Sxy, n, ybar, sigma2, P, prior_sd):
    """Mode and covariance of the slopes, and of the intercept at the predictor means."""
    A = Sxx / sigma2 + np.diag(P)
    V = _inverse(A)
    b = V @ (Sxy / sigma2)
    weight = n / sigma2 + (0.0 if np.isinf(prior_sd) else prior_sd**-2)
    return b, V, (n * ybar / sigma2) / weight, 1.0 / weight


def _gaussian_mode(parts, blocks: list[str], prior_sd: float, fixed: Mapping[str, float], rounds: int = 500):
    """Mode from the output of :func:`_pull_apart`; the last two values are the largest move of the last round and the rounds.

    ``fixed`` holds what is given and not estimated: ``sigma``, or the spread of a block by its name.
    """
    n, m, ybar, Sxx, Sxy, Syy = parts
    sigma2 = fixed["sigma"] ** 2 if "sigma" in fixed else max(Syy / n, 1e-12)
    sds = {k: fixed.get(k, v) for k, v in _block_sds(blocks).items()}
    free, mixing = [k for k in sds if k not in fixed], Anderson()
    for used in range(1, rounds + 1):
        P = _precision(blocks, sds, prior_sd)
        b, V, a, va = _solve(Sxx, Sxy, n, ybar, sigma2, P, prior_sd)
        edf = 1.0 + float(np.trace(V @ Sxx)) / sigma2
        rss = Syy - 2 * b @ Sxy + b @ Sxx @ b + n * (ybar - a) ** 2
        fresh = sigma2 if "sigma" in fixed else max(rss / max(n - edf, 1.0), 1e-12)
        then = {k: fixed.get(k, v) for k, v in _update_sds(b, V, blocks, sds).items()}
        # On the scale of the noise: a spread that sinks towards zero is settled once it no longer matters.
        moved = max([abs(fresh - sigma2) / sigma2, *(abs(then[k] - sds[k]) / np.sqrt(fresh) for k in sds)])
        now, sigma2, sds = np.log([sigma2, *(sds[k] for k in free)]), fresh, then
        if moved < 1e-10:
            break
        if free:  # plain rounds creep where a spread is small
            step = mixing.next(now, np.log([fresh, *(then[k] for k in free)]))
            sigma2 = sigma2 if "sigma" in fixed else float(np.exp(np.clip(step[0], np.log(fresh) - 1.0, np.log(fresh) + 1.0)))
            sds = then | dict(zip(free, np.exp(np.clip(step[1:], *np.log(SPREAD_BOUNDS))).tolist()))
    return b, V, a, va, m, float(np.sqrt(sigma2)), edf, sds, moved, used


def _counts(df: DataFrame, response: str, spec: Mapping) -> tuple[int, int, int]:
    """Complete rows above zero, those at zero, and all rows."""
    whole = is_complete(spec)
    row = df.agg(
        F.count_if(whole & (F.col(response) > 0)).alias("pos"), F.count_if(whole & (F.col(response) == 0)).alias("zero"),
        F.count("*").alias("all"),
    ).first()
    return row["pos"], row["zero"], row["all"]


def _fit_log(df: DataFrame, response: str, spec: Mapping, prior_sd: float, family: str, fixed: Mapping[str, float] | None) -> Fit:
    parts = terms(spec)
    check_terms(len(parts) + 1)
    positive, zeros, every = _counts(df, response, spec)
    logged = design(df, spec).filter(F.col(response) > 0).select("x", F.log(response).alias("y"))
    shift = _provisional_means(sum_rows(logged, "x", "y", column_sums)[0])
    G = square(sum_rows(logged, "x", "y", lambda Z: joint_products(about(shift, Z)), len(shift) ** 2)[0])
    return log_fit_of(_pull_apart(G, shift), response, spec, prior_sd, family, fixed, positive, zeros, every)


def log_fit_of(apart, response: str, spec: Mapping, prior_sd: float, family: str, fixed: Mapping[str, float] | None, positive: int, zeros: int, every: int) -> Fit:
    """The fit of a (hurdle) lognormal family from the rows' means and centred products, as :func:`_pull_apart` gives them."""
    parts = terms(spec)
    blocks = [t.block for t in parts][1:]
    b, V, a, va, m, sigma, edf, sds, moved, used = _gaussian_mode(apart, blocks, prior_sd, fixed or {})
    if moved >= 1e-6:
        _not_settled(family, moved)
    hurdle = family == "hurdle_lognormal"
    return Fit(
        family, response, spec, [t.name for t in parts], blocks, b, V, a, va, m, sigma, positive, edf,
        zeros=zeros if hurdle else 0, dropped=every - positive - (zeros if hurdle else 0), sds=sds, rounds=used,
        converged=moved < 1e-6, moved=moved,
    )


def fit_lognormal(df: DataFrame, response: str, spec: Mapping, prior_sd: float = 1.0, fixed: Mapping[str, float] | None = None) -> Fit:
    """Lognormal regression from two passes of sums. Values at or below zero are dropped and counted.

    ``fixed`` gives ``sigma``, or the spread of a block such as ``site``, instead of estimating it.
    """
    return _fit_log(df, response, spec, prior_sd, "lognormal", fixed)


def fit_hurdle_lognormal(df: DataFrame, response: str, spec: Mapping, prior_sd: float = 1.0, fixed: Mapping[str, float] | None = None) -> Fit:
    """Lognormal regression of the positive values with a constant probability of zero.

    That probability has a uniform prior, so its draws are Beta(1 + zeros, 1 + positives).
    """
    return _fit_log(df, response, spec, prior_sd, "hurdle_lognormal", fixed)


def _student_pass(beta: np.ndarray, sigma: float, nu: float, shift: np.ndarray):
    """Weighted sums about ``shift`` at the current fit (``beta`` belongs to columns so measured), and the sums behind the slopes and curvatures in noise and nu."""

    def statistic(Z: np.ndarray) -> np.ndarray:
        Z = about(shift, Z)
        r = (Z[:, -1] - Z[:, :-1] @ beta) / sigma
        w = (nu + 1.0) / (nu + r * r)
        return np.concatenate([(Z.T @ (Z * w[:, None])).ravel(), _tail_sums(r, nu)])

    return statistic


def _tail_sums(r: np.ndarray, nu: float) -> np.ndarray:
    """Sums over scaled residuals from which :func:`_tail_step` takes slopes and curvatures."""
    r2 = r * r
    d = nu + r2
    part = r2 / (nu * d)
    return np.array([
        np.log1p(r2 / nu).sum(), part.sum(), (part * (nu * nu + 2.0 * nu + r2) / (nu * d)).sum(), (r2 / d**2).sum(),
        (r / d).sum(), (r / d**2).sum(), ((nu - r2) / d**2).sum(),
    ])


def _polygamma(x: float) -> tuple[float, float]:
    """Digamma and trigamma of x > 0: recurrence up to 10, then their asymptotic series."""
    one = two = 0.0
    while x < 10.0:
        one, two, x = one - 1.0 / x, two + 1.0 / (x * x), x + 1.0
    f = 1.0 / (x * x)
    one += np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))
    two += 1.0 / x + 0.5 * f + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))
    return float(one), float(two)


def _tail_step(sigma: float, nu: float, n: float, edf: float, sums: np.ndarray, free: tuple[bool, bool], pull: tuple[float, float] = (0.0, 0.0)):
    """A Newton step for the level, log sigma and log nu together, from :func:`_tail_sums`: (move of the level, sigma, nu, curvature in log nu).

    Skewed residuals tie the three to each other, so that separate steps can circle. ``free`` tells whether sigma and nu move, ``pull`` is slope and curvature of
    the prior of the level. Where the curvature is not that of a mode the level does not move (nan), and sigma and nu take their own steps uphill.
    """
    (a1, a2), (b1, b2) = _polygamma((nu + 1.0) / 2.0), _polygamma(nu / 2.0)
    logs, part, bend, last, odd, odd2, even = sums
    slope = n * (0.5 * (a1 - b1) - 0.5 / nu) - 0.5 * logs + 0.5 * (nu + 1.0) * part + 1.0 / nu - 0.1
    curve = n * (0.25 * (a2 - b2) + 0.5 / nu**2) + 0.5 * part - 0.5 * bend - 1.0 / nu**2
    g = np.array([(nu + 1.0) * odd / sigma + pull[0], (nu + 1.0) * nu * part - (n - edf), nu * slope])
    H = np.zeros((3, 3))
    H[0, 0] = -(nu + 1.0) * even / sigma**2 + pull[1]
    H[1, 1], H[2, 2] = -2.0 * (nu + 1.0) * nu * last, nu * nu * curve + nu * slope
    H[0, 1] = H[1, 0] = -2.0 * nu * (nu + 1.0) * odd2 / sigma
    H[0, 2] = H[2, 0] = nu / sigma * (odd - (nu + 1.0) * odd2)
    H[1, 2] = H[2, 1] = nu * (nu * part - (nu + 1.0) * last)
    some = [0] + [i + 1 for i in range(2) if free[i]]
    step, own = np.full(3, np.nan), H[np.ix_(some, some)]
    scale = np.sqrt(np.abs(np.diag(own)) + 1e-300)
    if np.linalg.eigvalsh(own / np.outer(scale, scale)).max() < -1e-6:
        step[some] = np.linalg.solve(-own, g[some])
    else:
        step[1:] = [-g[i] / H[i, i] if H[i, i] < 0 else 0.5 * np.sign(g[i]) for i in (1, 2)]
    if free[0]:
        sigma = float(sigma * np.exp(np.clip(step[1], -1.0, 1.0)))
    if free[1]:
        nu = float(np.clip(nu * np.exp(np.clip(step[2], -1.0, 1.0)), *NU_BOUNDS))
    return float(step[0]), sigma, nu, float(H[2, 2])


def _settle_spreads(sums, sigma: float, blocks: list[str], sds: Mapping[str, float], fixed: Mapping[str, float], prior_sd: float):
    """Coefficients and block spreads that agree with each other for given weighted sums, by accelerated rounds on the driver."""
    nw, _, ybar, Sxx, Sxy, _ = sums
    free = [k for k in sds if k not in fixed]
    sds, mixing = dict(sds), Anderson()
    for _ in range(SETTLE):
        solved = _solve(Sxx, Sxy, nw, ybar, sigma**2, _precision(blocks, sds, prior_sd), prior_sd)
        if not free:
            break
        then = _update_sds(solved[0], solved[1], blocks, sds)
        if all(abs(then[k] - sds[k]) <= 1e-10 * max(sigma, then[k]) for k in free):
            break
        step = mixing.next(np.log([sds[k] for k in free]), np.log([then[k] for k in free]))
        sds |= dict(zip(free, np.exp(np.clip(step, *np.log(SPREAD_BOUNDS))).tolist()))
    return (*solved, sds)


def fit_student(
    df: DataFrame, response: str, spec: Mapping, prior_sd: float = 1.0, nu: float | None = None,
    rounds: int = 100, tol: float = 1e-5, fixed: Mapping[str, float] | None = None,
) -> Fit:
    """Student-t regression by re-weighted sums: one pass over a cached design per round.

    Coefficients, noise and degrees of freedom move together, the latter two by a Newton step from sums of the same pass, and the
    rounds are accelerated (safeguarded Anderson mixing). ``nu`` is found unless it is given; ``fixed`` gives ``sigma`` or the spread of a block, such as ``site``. A fit that
    is not settled after ``rounds`` says so: see ``converged`` and ``moved``.
    """
    fixed = dict(fixed or {})
    parts = terms(spec)
    check_terms(len(parts) + 1)
    blocks = [t.block for t in parts][1:]
    every = df.count()
    rows = design(df, spec).filter(F.col(response).isNotNull())
    rows = pack_blocks(rows, "x", response).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sums, tasks = sum_blocks(rows, column_sums, 0)
        shift = _provisional_means(sums)
        cores = df.sparkSession.sparkContext.defaultParallelism
        if tasks < cores and sums[0] >= SPREAD_ROWS:
            # Too few pieces for the cores: one shuffle now pays off over the rounds to come.
            wide = rows.repartition(cores).persist(StorageLevel.MEMORY_AND_DISK)
            wide.count()
            rows.unpersist()
            rows = wide
        G0 = square(sum_blocks(rows, lambda Z: joint_products(about(shift, Z)), len(shift) ** 2)[0])
        apart = _pull_apart(G0, shift)
        b, V, a, va, m, sigma, edf, sds, _, _ = _gaussian_mode(apart, blocks, prior_sd, fixed)
        n0, m0, _, Sxx0, _, _ = apart
        spread = np.maximum(np.sqrt(np.diag(Sxx0) / n0), 1e-12)
        dof = float(NU_START if nu is None else nu)
        size = len(parts) + 1
        center = a + (m0 - m) @ b  # the fit at the means of all rows
        mixing, curve = Anderson(), 0.0
        for used in range(1, rounds + 1):
            # Columns are measured from the shift; m0 lies within rounding of it.
            beta = np.concatenate([[center - shift[-1] + (shift[1:-1] - m0) @ b], b])
            flat, _ = sum_blocks(rows, _student_pass(beta, sigma, dof, shift), size * size + 7)
            weighted = _pull_apart(flat[: size * size].reshape(size, size), shift)
            m, Sxx = weighted[1], weighted[3]
            # Block spreads settle on the driver for these sums; a pass over the data costs more.
            before = sds
            then_b, V, a, va, sds = _settle_spreads(weighted, sigma, blocks, sds, fixed, prior_sd)
            edf = 1.0 + float(np.trace(V @ Sxx)) / sigma**2
            weight = 0.0 if np.isinf(prior_sd) else prior_sd**-2
            pull = (-weight * (center + (m - m0) @ b), -weight)
            level, then_sigma, then_dof, curve = _tail_step(sigma, dof, n0, edf, flat[size * size:], ("sigma" not in fixed, nu is None), pull)
            then_center = a + (m0 - m) @ then_b
            if abs(level) < sigma:
                then_center = center + level
            # On the scale of the noise, so that badly scaled columns do not stop it early or late.
            now = np.concatenate([[center / sigma], b * spread / sigma, [np.log(sigma), np.log(dof)]])
            then = np.concatenate([[then_center / sigma], then_b * spread / sigma, [np.log(then_sigma), np.log(then_dof)]])
            moved = max([*np.abs(then - now), *(abs(sds[k] - before[k]) / sigma for k in sds)])
            if moved < tol:
                center, b, sigma, dof = then_center, then_b, then_sigma, then_dof
                break
            # Far from the mode the Newton step leads best, near it the mixing.
            step = mixing.next(now, then) if moved < NEAR else then
            center, b = float(step[0] * sigma), step[1:-2] * sigma / spread
            # Noise and degrees of freedom may leap at most by a factor of e.
            sigma = fixed.get("sigma", float(np.exp(np.clip(step[-2], now[-2] - 1, now[-2] + 1))))
            dof = dof if nu is not None else float(np.clip(np.exp(np.clip(step[-1], now[-1] - 1, now[-1] + 1)), *NU_BOUNDS))
        if moved >= tol:
            _not_settled("student", moved)
    finally:
        rows.unpersist()
    # Curvature at the mode: each row informs (nu + 1) / (nu + 3) as much as a Gaussian one.
    info = (dof + 1.0) / (dof + 3.0)
    V = _inverse(info * Sxx0 / sigma**2 + np.diag(_precision(blocks, sds, prior_sd)))
    va = 1.0 / (info * n0 / sigma**2 + (0.0 if np.isinf(prior_sd) else prior_sd**-2))
    return Fit(
        "student", response, spec, [t.name for t in parts], blocks, b, V, float(center), va, m0, sigma, int(round(n0)), edf,
        nu=dof, nu_sd=float(min(1.0, 1.0 / np.sqrt(-curve))) if nu is None and curve < 0 else 0.0, sds=sds, rounds=used, dropped=every - int(round(n0)),
        converged=bool(moved < tol), moved=float(moved),
    )
