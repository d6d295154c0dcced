"""The published tables of a run, and their pull into a snapshot."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from segrank.functions.guards import SourceError
from segrank.sources.paged_api import ApiTable, count_rows, load
from segrank.sources.snapshots import pull_all

# The open-data API, its datasets, and the columns and rows that are pulled.
BASE = "https://data.cityofnewyork.us/resource"
PULL_START = "2016-01-01T00:00:00.000"
CRASH_COLUMNS = ("crash_date", "latitude", "longitude", "borough", "number_of_pedestrians_killed", "number_of_pedestrians_injured", "contributing_factor_vehicle_1", "contributing_factor_vehicle_2")
TABLES = {
    t.key: t
    for t in (
        ApiTable("crashes", "h9gi-nx95", BASE, f"crash_date >= '{PULL_START}'", CRASH_COLUMNS),
        ApiTable("vzv_corridors", "36nr-7fbp", BASE, geometry="the_geom"),
        ApiTable("vzv_intersections", "tmt9-43em", BASE, geometry="the_geom"),
        ApiTable("sip_corridors", "if4c-w48d", BASE, geometry="the_geom"),
        ApiTable("sip_intersections", "shr7-eqdc", BASE, geometry="the_geom"),
        ApiTable("centerline", "inkn-q76z", BASE, geometry="the_geom"),
    )
}


def pull(spark: SparkSession, root: str, only: list[str] | None = None, force: bool = False, token: str | None = None, date: str | None = None, read: Callable[..., DataFrame] = load, count: Callable[..., int] = count_rows) -> int:
    """All tables, or ``only`` some, into ``root``/date; 0 if all came whole, else 1, with what failed in the manifest."""
    keys = list(TABLES) if not only else only
    if unknown := [k for k in keys if k not in TABLES]:
        raise SourceError(f"there are no tables {unknown}; there are {list(TABLES)}")
    make = {k: (lambda t=TABLES[k]: read(spark, t, token)) for k in keys}
    expected = {k: (lambda t=TABLES[k]: count(t, token)) for k in keys}
    return pull_all(spark, make, root, date or datetime.date.today().isoformat(), force, {k: TABLES[k].geometry for k in keys if TABLES[k].geometry}, expected)
