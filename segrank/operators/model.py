"""Negative-binomial safety performance functions and the Empirical-Bayes blend.

The fit is iteratively reweighted least squares: each step is one aggregate of the normal equations
over the cached rows, solved on the driver (a handful of predictors), in turn with a search for the
dispersion that likewise aggregates the likelihood of several values at once.  Up to LOCAL_ROWS rows
the same sums are taken of columns that came to the driver once.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from segrank.config import MIN_DISPERSION, MIN_PREDICTION, PREDICTORS
from segrank.functions.guards import ModelError, require_columns

log = logging.getLogger(__name__)
#: Rows up to which a fit brings its few narrow columns to the driver once; larger ones are aggregated in every step.
LOCAL_ROWS = 250_000


@dataclass(frozen=True)
class Fit:
    unit_type: str
    intercept: float
    coefficients: dict[str, float]
    dispersion: float
    n: int
    log_likelihood: float
    converged: bool = True
    predictors: tuple[str, ...] = field(default=())

    def predict(self, offset: str = "log_exposure") -> Column:
        """exp(X b + offset); NULL where anything is missing."""
        eta = F.lit(self.intercept) + F.col(offset)
        for c, b in self.coefficients.items():
            eta = eta + F.lit(b) * F.col(c).cast("double")
        return F.exp(eta)

    def summary(self) -> str:
        return f"{self.unit_type}: n={self.n}, k={self.dispersion:.4f}, log likelihood {self.log_likelihood:.2f}" + ("" if self.converged else ", not converged")


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        out = np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        out = np.linalg.lstsq(a, b, rcond=None)[0]
    return out


def fit_nb(features: DataFrame, target: str = "casualties_36mo", predictors=PREDICTORS, unit_type: str = "corridor", offset: str = "log_exposure", max_iterations: int = 100, tolerance: float = 1e-7, local_rows: int = LOCAL_ROWS) -> Fit:
    """NB2 regression with a log link and a fixed offset. Rows with missing values are left out, with a warning.

    Raises ModelError for missing columns, infinite offsets, too few rows, predictors that can't be told apart, no
    convergence, or a dispersion that isn't positive.
    """
    require_columns(features, [target, offset, "exposure_valid", *predictors], ModelError, "features")
    rows = features.where("exposure_valid")
    total, bad = rows.agg(F.count(F.lit(1)), F.count_if(F.abs(F.col(offset)) == float("inf"))).first()
    if bad:
        raise ModelError(f"{bad} rows have an infinite offset")
    if not total:
        raise ModelError(f"no {unit_type} has a valid exposure")
    clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    rows = rows.select(clean(target).alias("y"), clean(offset).alias("o"), *(clean(c).alias(f"x{i}") for i, c in enumerate(predictors))).dropna().persist()
    try:
        stats = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.sum(F.exp("o")).alias("so"), *(f(f"x{i}").alias(f"{k}{i}") for i in range(len(predictors)) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        n = stats["n"]
        if n < total:
            log.warning("%d of %d %s rows have missing values and are left out", total - n, total, unit_type)
        use = [i for i in range(len(predictors)) if (stats[f"s{i}"] or 0) > 1e-12]  # a constant is in the intercept already
        p = len(use) + 1
        if n < len(predictors) + 2:
            raise ModelError(f"{unit_type}: {n} rows leave {len(predictors)} predictors unidentified")
        if not stats["sy"]:
            raise ModelError(f"{unit_type}: the target is zero everywhere")
        mean, scale = [stats[f"m{i}"] for i in use], [stats[f"s{i}"] for i in use]
        x = [F.lit(1.0), *((F.col(f"x{i}") - m) / s for i, m, s in zip(use, mean, scale, strict=True))]
        beta = np.zeros(p)
        beta[0] = math.log(stats["sy"] / stats["so"])

        def eta(b: np.ndarray) -> Column:
            e = F.col("o")
            for v, c in zip(b, x, strict=True):
                e = e + F.lit(float(v)) * c
            return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), e))

        here = None
        if n <= local_rows:
            pdf = rows.toPandas()
            here = (pdf["y"].to_numpy(), pdf["o"].to_numpy(), np.column_stack([np.ones(n), *((pdf[f"x{i}"].to_numpy() - m) / s for i, m, s in zip(use, mean, scale, strict=True))]))

        def sums(b: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
            if here is not None:
                y, o, xs = here
                e = np.clip(o + xs @ b, -30, 30)
                mu = np.exp(e)
                w = mu / (1 + alpha * mu)
                return (xs * w[:, None]).T @ xs, xs.T @ (w * (e - o + (y - mu) / mu))
            mu = F.exp(F.col("_e"))
            w = mu / (1 + alpha * mu)
            z = F.col("_e") - F.col("o") + (F.col("y") - mu) / mu
            cells = [(i, j) for i in range(p) for j in range(i, p)]
            r = rows.withColumn("_e", eta(b)).agg(*(F.sum(w * x[i] * x[j]) for i, j in cells), *(F.sum(w * x[i] * z) for i in range(p))).first()
            a = np.zeros((p, p))
            for k, (i, j) in enumerate(cells):
                a[i, j] = a[j, i] = r[k]
            return a, np.array(r[len(cells) :], float)

        def step(b: np.ndarray, alpha: float) -> np.ndarray:
            left, right = sums(b, alpha)
            if np.linalg.cond(left) > 1e12:
                raise ModelError(f"{unit_type}: the predictors are unidentified")
            return _solve(left, right)

        tails = rows.groupBy("y").count().collect()  # as many rows as the target has values
        counts: dict[int, int] = {}
        for r in tails:
            counts[int(r["y"])] = counts.get(int(r["y"]), 0) + r["count"]
        top = max(counts)
        above = np.zeros(top + 1)
        for y, c in counts.items():
            above[:y] += c
        fact = sum(c * math.lgamma(y + 1) for y, c in counts.items())
        j = np.arange(top + 1)

        def likelihood(b: np.ndarray, alphas: np.ndarray) -> np.ndarray:
            if here is not None:
                y, o, xs = here
                e = np.clip(o + xs @ b, -30, 30)
                r = [(y * e - (y + 1 / a) * np.log1p(a * np.exp(e))).sum() for a in alphas]
                return np.array([float((above * np.log1p(a * j)).sum()) + v - fact for a, v in zip(alphas, r, strict=True)])
            mu = F.exp(F.col("_e"))
            r = rows.withColumn("_e", eta(b)).agg(*(F.sum(F.col("y") * F.col("_e") - (F.col("y") + float(1 / a)) * F.log1p(float(a) * mu)) for a in alphas)).first()
            return np.array([float((above * np.log1p(a * j)).sum()) + v - fact for a, v in zip(alphas, r, strict=True)])

        alpha = 1.0
        for _ in range(min(max_iterations, 8)):  # Poisson start
            new = step(beta, 0.0)
            moved, beta = np.abs(new - beta).max(), new
            if moved < 1e-6:
                break
        center, width = 0.0, 12.0  # of ln alpha; the width follows how far the optimum still moves
        for _ in range(max_iterations):
            grid = np.linspace(center - width, center + width, 17)
            found = likelihood(beta, np.exp(grid))
            at = int(np.argmax(found))
            best = grid[at]
            if 0 < at < 16:  # the top of a parabola through the three best
                a, b, c = found[at - 1], found[at], found[at + 1]
                if a - 2 * b + c < 0:
                    best += (grid[1] - grid[0]) * 0.5 * (a - c) / (a - 2 * b + c)
            new = step(beta, math.exp(best))
            change = max(np.abs(new - beta).max(), abs(best - center))
            width = max(1e-4, min(12.0, width / 4 if 0 < at < 16 else width * 2))
            beta, center, alpha = new, best, math.exp(best)
            if best < math.log(1e-9):
                break
            if change < max(tolerance, 1e-6) and width <= 1e-3:
                break
        else:
            raise ModelError(f"{unit_type}: no convergence in {max_iterations} iterations")
        if not alpha > MIN_DISPERSION * 10 or not np.isfinite(beta).all():
            raise ModelError(f"{unit_type}: the dispersion {alpha:g} isn't positive")
        coefficients = dict.fromkeys(predictors, 0.0) | {predictors[i]: float(b / s) for i, b, s in zip(use, beta[1:], scale, strict=True)}
        intercept = float(beta[0] - sum(b * m / s for b, m, s in zip(beta[1:], mean, scale, strict=True)))
        return Fit(unit_type, intercept, coefficients, float(alpha), n, float(likelihood(beta, np.array([alpha]))[0]), True, tuple(predictors))
    finally:
        rows.unpersist()


def poisson_glm(features: DataFrame, target: str, predictors, offset: str = "log_exposure") -> tuple[float, list[float]]:
    """Intercept and coefficients of a Poisson regression with an offset, by Spark's own GLM."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = VectorAssembler(inputCols=list(predictors), outputCol="_x", handleInvalid="skip").transform(features.where("exposure_valid"))
    fit = GeneralizedLinearRegression(family="poisson", link="log", offsetCol=offset, labelCol=target, featuresCol="_x").fit(rows)
    return float(fit.intercept), [float(c) for c in fit.coefficients]


def empirical_bayes(prediction: Column | str, observed: Column | str, k: float, floor: float = MIN_PREDICTION) -> Column:
    """w P + (1 - w) observed with w = 1 / (1 + k P); P is no less than ``floor``, and missing inputs give NULL."""
    if k is None or not math.isfinite(k) or k <= MIN_DISPERSION:
        raise ModelError(f"the dispersion {k} isn't positive")
    p = F.greatest(F.col(prediction) if isinstance(prediction, str) else prediction, F.lit(floor))
    obs = (F.col(observed) if isinstance(observed, str) else observed).cast("double")
    p = F.when((F.col(prediction) if isinstance(prediction, str) else prediction).isNotNull(), p)
    w = 1 / (1 + F.lit(float(k)) * p)
    return w * p + (1 - w) * obs


def require_values(df: DataFrame, columns, error=ModelError) -> None:
    """One job: raise if a score is NULL or NaN."""
    bad = df.agg(*(F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in columns)).first()
    if any(bad):
        raise error(f"missing values: {bad.asDict()}")


def fit_and_blend(features: DataFrame, target: str = "casualties_36mo", predictors=PREDICTORS, observed: str = "casualties_36mo", unit_types=("corridor", "intersection"), max_iterations: int = 100) -> tuple[DataFrame, dict[str, Fit]]:
    """Adds spf_prediction and eb_estimate from one fit for each kind of unit; units without a prediction keep what was observed (NULL: 0)."""
    fits = {t: fit_nb(features.where(F.col("unit_type") == t), target, predictors, t, max_iterations=max_iterations) for t in unit_types}
    prediction, blend = F.lit(None).cast("double"), F.lit(None).cast("double")
    for t, f in fits.items():
        here = (F.col("unit_type") == t) & F.col("exposure_valid")
        prediction = F.when(here, f.predict()).otherwise(prediction)
        blend = F.when(here, empirical_bayes("spf_prediction", observed, f.dispersion)).otherwise(blend)
    out = features.withColumn("spf_prediction", prediction)
    return out.withColumn("eb_estimate", F.coalesce(blend, F.col(observed).cast("double"), F.lit(0.0))), fits


def calibration(scored: DataFrame, by: str = "is_highway", observed: str = "casualties_36mo", prediction: str = "spf_prediction") -> DataFrame:
    """by, units, observed, predicted, ratio: observed by predicted, for each class."""
    return scored.where(F.col(prediction).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("units"), F.sum(observed).alias("observed"), F.sum(prediction).alias("predicted")).withColumn("ratio", F.try_divide("observed", "predicted"))
