"""Errors, and checks that need no job unless they say so."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


class ScreeningError(ValueError):
    """Base of all errors of the engine."""


class CRSError(ScreeningError):
    """A frame lacks the coordinate system that an operator needs."""


class SpatialJoinError(ScreeningError):
    """A spatial join can't account for its rows."""


class FeatureError(ScreeningError):
    """Features can't be built."""


class ModelError(ScreeningError):
    """A model can't be fitted or applied."""


class BacktestError(ScreeningError):
    """A selection can't be made or scored."""


class SourceError(ScreeningError):
    """A source gave no usable rows."""


class IncompletePullError(SourceError):
    """A source gave other rows than it counts."""


class AuditError(ScreeningError):
    """Artifacts can't be audited."""


def require_columns(df: DataFrame, columns, error: type[ScreeningError] = ScreeningError, what: str = "frame") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise error(f"{what} lacks columns {missing}")


def require_unique(df: DataFrame, key: str, error: type[ScreeningError] = ScreeningError) -> None:
    """One aggregate job: raise if ``key`` repeats."""
    n, distinct = df.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
    if n != distinct:
        raise error(f"{n - distinct} duplicate values of {key}")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """key, copies of keys that repeat."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def with_srid(df: DataFrame, column: str, srid: int) -> DataFrame:
    """Tag a geometry column with its coordinate system, in the column's metadata."""
    return df.withColumn(column, F.col(column).alias(column, metadata={"srid": srid}))


def require_srid(df: DataFrame, column: str, srid: int) -> None:
    require_columns(df, [column], CRSError, "geometry frame")
    found = df.schema[column].metadata.get("srid")
    if found != srid:
        raise CRSError(f"{column} is in {found or 'no known system'}; {srid} is needed")
