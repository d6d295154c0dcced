"""Features of units as of a date, without a look ahead."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from segrank.config import FACTORS, MIN_LENGTH_FT, ROAD_ATTRIBUTES, TRAILING_MONTHS
from segrank.functions.guards import FeatureError, require_columns
from segrank.functions.scalars import in_trailing, is_night, is_weekend, months_before, number, share, slug


def exposure(units: DataFrame, length: str = "length_ft", legs: str = "leg_count", minimum: float = MIN_LENGTH_FT) -> DataFrame:
    """Adds exposure (length of corridors, legs of junctions), exposure_valid, log_exposure (of valid ones). No unit is dropped."""
    require_columns(units, ["unit_type", length, legs], FeatureError, "units")
    value = F.when(F.col("unit_type") == "corridor", F.col(length).cast("double")).when(F.col("unit_type") == "intersection", F.col(legs).cast("double"))
    out = units.withColumn("exposure", F.nanvl(value, F.lit(None).cast("double")))
    out = out.withColumn("exposure_valid", F.coalesce((F.col("exposure") >= minimum) & (F.col("exposure") < float("inf")), F.lit(False)))
    return out.withColumn("log_exposure", F.when(F.col("exposure_valid"), F.ln("exposure")))


@dataclass(frozen=True)
class FeatureReport:
    units: int
    without_exposure: int
    infinite: int
    truncated: tuple[int, ...]

    def summary(self) -> str:
        text = f"{self.without_exposure} of {self.units} units ({share(self.without_exposure, self.units)}) have no valid exposure and stay out of the fit"
        return text + "".join(f"; the {m}-month window begins before the data" for m in self.truncated)


def impute_road_attributes(units: DataFrame, columns=ROAD_ATTRIBUTES, group: str = "unit_type") -> DataFrame:
    """Missing attributes become the group's median, else the median of all; road_attrs_imputed flags rows that missed any before coercion."""
    require_columns(units, [*columns, group], FeatureError, "units")
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    out = units.withColumn("road_attrs_imputed", missing.cast("int")).withColumns({c: number(c) for c in columns})
    by = out.groupBy(group).agg(*(F.median(c).alias(f"_m_{c}") for c in columns))  # a row for each kind of unit
    whole = out.agg(*(F.median(c).alias(c) for c in columns)).first()
    if none := [c for c in columns if whole[c] is None]:
        raise FeatureError(f"no value of {none} to impute from")
    out = out.join(F.broadcast(by), out[group].eqNullSafe(by[group]), "left").drop(by[group])
    return out.withColumns({c: F.coalesce(c, f"_m_{c}", F.lit(whole[c])) for c in columns}).drop(*(f"_m_{c}" for c in columns))


def trailing(events: DataFrame, as_of: Column, months=TRAILING_MONTHS, value: str = "pedestrian_casualties", ts: str = "crash_date", unit: str = "unit_id", holdout: tuple[Column, Column] | None = None) -> DataFrame:
    """unit, casualties_{m}mo and crashes_{m}mo for all windows (as_of - m months, as_of], and with ``holdout`` the casualties in [start, end), in one aggregate."""
    wanted, aggs = in_trailing(F.col(ts), as_of, max(months)), []
    summed = lambda where: F.coalesce(F.sum(F.when(where, F.col(value))), F.lit(0)).cast("bigint")
    for m in months:
        inside = in_trailing(F.col(ts), as_of, m)
        aggs += [summed(inside).alias(f"casualties_{m}mo"), F.count_if(inside).alias(f"crashes_{m}mo")]
    if holdout:
        later = (F.col(ts) >= holdout[0]) & (F.col(ts) < holdout[1])
        wanted = wanted | later
        aggs.append(summed(later).alias("holdout_casualties"))
    return events.where(wanted).groupBy(unit).agg(*aggs)


def truncated_windows(events: DataFrame, as_of: Column, months=TRAILING_MONTHS, ts: str = "crash_date") -> tuple[int, ...]:
    """Windows that begin before the first event."""
    row = events.agg(F.min(ts).alias("t")).select(*((F.col("t") > months_before(as_of, m)).alias(str(m)) for m in months)).first()
    return tuple(m for m in months if row[str(m)])


def between_sum(events: DataFrame, start: Column, end: Column, out: str, value: str = "pedestrian_casualties", ts: str = "crash_date", unit: str = "unit_id") -> DataFrame:
    """unit and the sum of ``value`` in [start, end)."""
    return events.where((F.col(ts) >= start) & (F.col(ts) < end)).groupBy(unit).agg(F.sum(value).cast("bigint").alias(out))


def fill_join(units: DataFrame, found: DataFrame, key: str = "unit_id", default=0) -> DataFrame:
    """Left join by key; units without a row get ``default``: quiet, not unknown."""
    new = [c for c in found.columns if c != key]
    return units.join(found, key, "left").withColumns({c: F.coalesce(F.col(c), F.lit(default).cast(found.schema[c].dataType)) for c in new})


def factor_mix(events: DataFrame, columns, factors=FACTORS, unit: str = "unit_id") -> DataFrame:
    """unit, factor_<slug>: share of each factor among all non-NULL mentions in ``columns``."""
    rows = events.select(unit, F.explode(F.array(*(F.col(c) for c in columns))).alias("_f")).where("_f is not null")
    plain = rows.sparkSession.range(1).select(*(slug(F.lit(f)).alias(str(i)) for i, f in enumerate(factors))).first()
    return rows.groupBy(unit).agg(*((F.count_if(F.col("_f") == f) / F.count("_f")).alias(f"factor_{plain[str(i)]}") for i, f in enumerate(factors)))


def temporal_shares(events: DataFrame, ts: str = "crash_date", unit: str = "unit_id") -> DataFrame:
    """unit, night_share, weekend_share."""
    return events.groupBy(unit).agg(F.avg(is_night(ts).cast("double")).alias("night_share"), F.avg(is_weekend(ts).cast("double")).alias("weekend_share"))


def build_features(events: DataFrame, units: DataFrame, as_of: Column, months=TRAILING_MONTHS, factor_columns=("contributing_factor_vehicle_1", "contributing_factor_vehicle_2"), mix_months: int = 36, ts: str = "crash_date") -> DataFrame:
    """One row for each unit: exposure, road attributes, windows, factor mix, shares and as_of."""
    have = [c for c in ROAD_ATTRIBUTES if c in units.columns]
    out = exposure(units)
    if have:
        out = impute_road_attributes(out, have)
    out = fill_join(out, trailing(events, as_of, months, ts=ts))
    recent = events.where(in_trailing(F.col(ts), as_of, mix_months))
    columns = [c for c in factor_columns if c in events.columns]
    if columns:
        out = fill_join(out, factor_mix(recent, columns), default=0.0)
    return fill_join(out, temporal_shares(recent, ts), default=0.0).withColumn("as_of", as_of)


def feature_report(features: DataFrame, events: DataFrame, as_of: Column, months=TRAILING_MONTHS, ts: str = "crash_date") -> FeatureReport:
    """Counts of exposure; raises if a logarithm is infinite."""
    r = features.agg(F.count(F.lit(1)), F.count_if(~F.col("exposure_valid")), F.count_if(F.col("exposure") == float("inf"))).first()
    if r[2]:
        raise FeatureError(f"{r[2]} units have an infinite log exposure")
    return FeatureReport(r[0], r[1], r[2], truncated_windows(events, as_of, months, ts))

