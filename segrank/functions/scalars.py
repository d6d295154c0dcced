"""Column expressions: coercion, text, time and tie-breaks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType


def number(c: Column | str) -> Column:
    """Double of a trimmed string; NULL for what is no number or NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(F.trim(c.cast("string")).try_cast("double"), F.lit(None).cast("double"))


def count_of(c: Column | str) -> Column:
    """Whole number; 0 for what is no number."""
    return F.coalesce(number(c), F.lit(0.0)).cast("bigint")


def instant(c: Column | str) -> Column:
    """Timestamp without zone; NULL for what is none."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("timestamp_ntz")


def clean_token(c: Column | str) -> Column:
    """Trimmed text; NULL if blank."""
    return F.nullif(F.trim(c), F.lit(""))


def slug(c: Column | str) -> Column:
    """Lower case, each run of other signs than letters and digits one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_|_$", "")


def half_even(c: Column | str) -> Column:
    """Rounded to a whole number, halves to the even one, as BIGINT."""
    return F.bround(c, 0).cast("bigint")


def is_night(ts: Column | str) -> Column:
    return (F.hour(ts) >= 18) | (F.hour(ts) < 6)


def is_weekend(ts: Column | str) -> Column:
    return F.weekday(ts) >= 5


def months_before(ts: Column, months: int) -> Column:
    """The same time so many months earlier; the last day of the month if that one has no such day."""
    return ts - F.make_ym_interval(F.lit(0), F.lit(months))


def in_trailing(ts: Column, as_of: Column, months: int) -> Column:
    """Whether ts is in (as_of - months, as_of]."""
    return (ts > months_before(as_of, months)) & (ts <= as_of)


def time_part(ts: Column, start: Column, holdout: Column, stop: Column) -> Column:
    """train in [start, holdout), holdout in [holdout, stop), else NULL."""
    return F.when((ts >= start) & (ts < holdout), "train").when((ts >= holdout) & (ts < stop), "holdout")


@pandas_udf(BinaryType())
def blake2b_key(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Eight bytes of BLAKE2b; binary order is the order of unsigned big-endian numbers."""
    for s in ids:
        yield s.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=8).digest())


def tiebreak(c: Column | str, mode: str = "md5") -> Column:
    """A content-free order of ids: ``md5`` stays in the JVM and is the same in SQL, ``blake2b`` is for parity."""
    if mode == "md5":
        return F.md5(c)
    if mode == "blake2b":
        return blake2b_key(c)
    raise ValueError(f"no tie-break {mode}")


def share(part: float | None, whole: float | None) -> str:
    """Percent text of a share; says so if it is undefined."""
    return "UNDEFINED" if not whole or part is None else f"{100 * part / whole:.2f}%"
