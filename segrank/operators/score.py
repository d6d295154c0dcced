"""Capture rates on the holdout, bootstrap intervals, the pre-registered bar and treatment splits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from segrank.config import BOOTSTRAP_ITERATIONS, BOOTSTRAP_LEVEL, BOOTSTRAP_SEED, MAX_DEGENERATE_SHARE, MIN_LIFT_PP
from segrank.functions.guards import BacktestError, require_columns, require_unique
from segrank.functions.scalars import share

@dataclass(frozen=True)
class Capture:
    captured: int
    total: int
    units: int

    @property
    def defined(self) -> bool:
        return self.total > 0

    @property
    def rate(self) -> float | None:
        return self.captured / self.total if self.defined else None

    def summary(self) -> str:
        return f"{self.captured} of {self.total} ({share(self.captured, self.total)}) by {self.units} units"


def flagged(units: DataFrame, selection: DataFrame, out: str, key: str = "unit_id") -> DataFrame:
    """units with a flag of membership in ``selection``."""
    return units.join(selection.select(key, F.lit(True).alias(out)).distinct(), key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def capture(units: DataFrame, selection: DataFrame, casualties: str = "holdout_casualties") -> DataFrame:
    """One row: captured, total, units, rate (NULL without casualties)."""
    rows = flagged(units.select("unit_id", casualties), selection, "_in").agg(F.coalesce(F.sum(F.when(F.col("_in"), F.col(casualties))), F.lit(0)).cast("bigint").alias("captured"), F.coalesce(F.sum(casualties), F.lit(0)).cast("bigint").alias("total"), F.count_if("_in").alias("units"))
    return rows.withColumn("rate", F.try_divide(F.col("captured").cast("double"), F.col("total")))


def capture_rate(units: DataFrame, selection: DataFrame, casualties: str = "holdout_casualties") -> Capture:
    """capture() checked for repeated units, on the driver."""
    require_columns(units, ["unit_id", casualties], BacktestError, "holdout")
    require_unique(units, "unit_id", BacktestError)
    r = capture(units, selection, casualties).first()
    return Capture(r["captured"], r["total"], r["units"])


@dataclass(frozen=True)
class Interval:
    point: float
    low: float
    high: float
    iterations: int
    discarded: int
    mode: str

    @property
    def excludes_zero(self) -> bool:
        return self.low > 0 or self.high < 0

    def summary(self) -> str:
        return f"{self.point:+.2f} pp [{self.low:.2f}, {self.high:.2f}], {self.iterations} {self.mode} resamples" + (f", {self.discarded} without casualties discarded" if self.discarded else "")


def _interval(point: float, draws: np.ndarray, asked: int, level: float, mode: str) -> Interval:
    lost = asked - len(draws)
    if lost > MAX_DEGENERATE_SHARE * asked:
        raise BacktestError(f"{lost} of {asked} resamples have no casualties")
    low, high = np.percentile(draws, [50 * (1 - level), 50 * (1 + level)])
    return Interval(point, float(low), float(high), asked, lost, mode)


def outcome_classes(marked: DataFrame, a: str = "_a", b: str = "_b", casualties: str = "holdout_casualties") -> DataFrame:
    """v, d, n: units by casualties and membership by two flags (a minus b: 1, 0 or -1). As many rows as casualties have values, times three."""
    return marked.groupBy(F.coalesce(F.col(casualties).cast("double"), F.lit(0.0)).alias("v"), (F.col(a).cast("int") - F.col(b).cast("int")).alias("d")).agg(F.count(F.lit(1)).alias("n"))


def class_interval(classes: DataFrame, iterations: int = BOOTSTRAP_ITERATIONS, level: float = BOOTSTRAP_LEVEL, seed: int = BOOTSTRAP_SEED) -> Interval:
    """The bootstrap over outcome classes, which alone come to the driver."""
    rows = sorted(tuple(r) for r in classes.collect())
    v, d, n = (np.array(c, float) for c in zip(*rows, strict=True)) if rows else (np.zeros(0),) * 3
    if not (n * v).sum():
        raise BacktestError("there are no casualties to capture")
    drawn = np.random.default_rng(seed).multinomial(int(n.sum()), n / n.sum(), size=iterations)
    whole, diff = drawn @ v, drawn @ (v * d)
    return _interval(float(100 * (n * v * d).sum() / (n * v).sum()), 100 * diff[whole > 0] / whole[whole > 0], iterations, level, "multinomial")


def bootstrap_difference(units: DataFrame, a: DataFrame, b: DataFrame, casualties: str = "holdout_casualties", iterations: int = BOOTSTRAP_ITERATIONS, level: float = BOOTSTRAP_LEVEL, seed: int = BOOTSTRAP_SEED) -> Interval:
    """Difference of capture rates a - b in percent points, units resampled with replacement.

    A resample of units is, for the rates, a multinomial draw of how many of each outcome class it has, which is what
    is drawn: the same law at every size. bootstrap_gather() is the form that draws units one by one.
    """
    both = flagged(flagged(units.select("unit_id", casualties), a, "_a"), b, "_b")
    return class_interval(outcome_classes(both, casualties=casualties), iterations, level, seed)


def bootstrap_gather(units: DataFrame, a: DataFrame, b: DataFrame, casualties: str = "holdout_casualties", iterations: int = BOOTSTRAP_ITERATIONS, level: float = BOOTSTRAP_LEVEL, seed: int = BOOTSTRAP_SEED) -> Interval:
    """The same, bit for bit as numpy draws units in the order of unit_id, for comparison with runs that did so.

    Three narrow columns of all units come to the driver; no plan calls it.
    """
    both = flagged(flagged(units.select("unit_id", casualties), a, "_a"), b, "_b")
    pdf = both.select("unit_id", F.col(casualties).cast("double").alias("v"), "_a", "_b").orderBy("unit_id").toPandas()
    n, v = len(pdf), pdf["v"].to_numpy()
    if not v.sum():
        raise BacktestError("there are no casualties to capture")
    d = v * (pdf["_a"].to_numpy().astype(float) - pdf["_b"].to_numpy().astype(float))
    rng, out = np.random.default_rng(seed), []
    for _ in range(iterations):
        m = np.bincount(rng.integers(0, n, size=n), minlength=n)
        if (whole := m @ v) > 0:
            out.append(100 * (m @ d) / whole)
    return _interval(float(100 * d.sum() / v.sum()), np.array(out), iterations, level, "gathered")


#: Cumulative Poisson(1) probabilities, from the rule e^-1 / k!
POISSON_CDF = tuple(np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 12)])).round(15).tolist())


def poisson_weight(key: Column, draw: Column) -> Column:
    """How often a unit is in a resample: Poisson(1) by a uniform number from MD5 of key and draw, the same in any engine."""
    u = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), draw.cast("string"))), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    k = F.lit(len(POISSON_CDF))
    for i in reversed(range(len(POISSON_CDF))):
        k = F.when(u < F.lit(POISSON_CDF[i]), F.lit(i)).otherwise(k)
    return k


def poisson_draws(both: DataFrame, casualties: str, iterations: int) -> DataFrame:
    """draw, whole, diff: sums of each resample. Units without casualties add nothing and are left out before."""
    rows = both.where(F.col(casualties) > 0).select("unit_id", F.col(casualties).alias("_v"), (F.col("_a").cast("int") - F.col("_b").cast("int")).alias("_d"))
    rows = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    rows = rows.withColumn("_k", poisson_weight(F.col("unit_id"), F.col("draw"))).where("_k > 0")
    return rows.groupBy("draw").agg(F.sum(F.col("_k") * F.col("_v")).cast("bigint").alias("whole"), F.sum(F.col("_k") * F.col("_v") * F.col("_d")).cast("bigint").alias("diff"))


def percentile_bounds(df: DataFrame, column: str, level: float = BOOTSTRAP_LEVEL) -> DataFrame:
    """One row: low and high, the exact percentiles around the middle ``level`` of a column."""
    return df.agg(F.percentile(column, (1 - level) / 2).alias("low"), F.percentile(column, (1 + level) / 2).alias("high"))


def poisson_interval(both: DataFrame, casualties: str, iterations: int, level: float = BOOTSTRAP_LEVEL) -> Interval:
    """The bootstrap by Poisson weights of MD5, which SQL repeats exactly; one row comes to the driver."""
    v, d = both.agg(F.sum(casualties), F.sum(F.col(casualties) * (F.col("_a").cast("int") - F.col("_b").cast("int")))).first()
    draws = poisson_draws(both, casualties, iterations).where("whole > 0").withColumn("_r", 100.0 * F.col("diff") / F.col("whole"))
    n = draws.count()
    if iterations - n > MAX_DEGENERATE_SHARE * iterations:
        raise BacktestError(f"{iterations - n} of {iterations} resamples have no casualties")
    low, high = percentile_bounds(draws, "_r", level).first()
    return Interval(100.0 * d / v, low, high, iterations, iterations - n, "Poisson")


@dataclass(frozen=True)
class Verdict:
    clears: bool
    lift: float | None
    reason: str

    def summary(self) -> str:
        return f"{'clears' if self.clears else 'does not clear'} the bar: {self.reason}"


def preregistered_bar(eb: float | None, naive: float | None, low: float, high: float, threshold: float = MIN_LIFT_PP) -> Verdict:
    """Rates in percent. Cleared if the lift is at least ``threshold`` and the interval excludes zero."""
    if eb is None or naive is None:
        return Verdict(False, None, "a capture rate is undefined")
    lift, sure = eb - naive, low > 0 or high < 0
    if lift >= threshold and sure:
        return Verdict(True, lift, f"{lift:.2f} pp, and the CI excludes zero")
    if lift >= threshold:
        return Verdict(False, lift, f"{lift:.2f} pp, but the CI includes zero")
    if sure:
        return Verdict(False, lift, f"{lift:.2f} pp is below the {threshold:g} pp asked for")
    return Verdict(False, lift, f"{lift:.2f} pp is below the {threshold:g} pp asked for and the CI includes zero")


def split_by_treatment(units: DataFrame, selection: DataFrame, casualties: str = "holdout_casualties", holdout_start: Column | None = None) -> DataFrame:
    """bucket, captured, total, rate. Without a date: treated, untreated; with one: before, during, undated, untreated. Every bucket has a row, its own total, and NULL for an undefined rate."""
    require_columns(units, ["unit_id", casualties, "treated", *(["treatment_date"] if holdout_start is not None else [])], BacktestError, "holdout")
    treated = F.coalesce("treated", F.lit(False))
    if holdout_start is None:
        names, bucket = ["treated", "untreated"], F.when(treated, "treated").otherwise("untreated")
    else:
        names = ["before", "during", "undated", "untreated"]
        bucket = F.when(~treated, "untreated").when(F.col("treatment_date").isNull(), "undated").when(F.col("treatment_date") < holdout_start, "before").otherwise("during")
    rows = flagged(units, selection, "_in").select(bucket.alias("bucket"), F.col(casualties).alias("_v"), "_in")
    found = rows.groupBy("bucket").agg(F.sum(F.when(F.col("_in"), F.col("_v"))).alias("_c"), F.sum("_v").alias("_t"))
    every = units.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("bucket"))
    out = every.join(found, "bucket", "left").select("bucket", F.coalesce("_c", F.lit(0)).cast("bigint").alias("captured"), F.coalesce("_t", F.lit(0)).cast("bigint").alias("total"))
    return out.withColumn("rate", F.try_divide(F.col("captured").cast("double"), F.col("total")))
