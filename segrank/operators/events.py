"""Events: label, coordinates, and their assignment to units with balanced books."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from segrank.config import BOUNDS_FT, DEFAULT_RADII, Radii
from segrank.functions.guards import FeatureError, SpatialJoinError, require_columns
from segrank.functions.scalars import count_of, instant, number
from segrank.functions.scalars import share as _share
from segrank.operators.geo import in_bounds, nearest_within, reproject


def label_casualties(events: DataFrame, killed: str = "number_of_pedestrians_killed", injured: str = "number_of_pedestrians_injured", date: str = "crash_date", out: str = "pedestrian_casualties") -> DataFrame:
    """killed + injured, bad values 0; ``date`` becomes a timestamp, and undated rows go."""
    require_columns(events, [killed, injured, date], FeatureError, "events")
    return events.withColumn(out, count_of(killed) + count_of(injured)).withColumn(date, instant(date)).where(F.col(date).isNotNull())


def drop_reasons(events: DataFrame, lat: str = "latitude", lon: str = "longitude", bounds=BOUNDS_FT, projected: bool = False) -> DataFrame:
    """Adds x, y and drop_reason: missing, null_island, outside (in this order) or NULL for rows that stay."""
    a, b = number(lat), number(lon)
    x, y = (b, a) if projected else reproject(b, a)
    reason = F.when(a.isNull() | b.isNull(), "missing").when((a == 0) & (b == 0), "null_island").when(~F.coalesce(in_bounds(x, y, bounds), F.lit(False)), "outside")
    return events.withColumns({"x": x, "y": y, "drop_reason": reason})


@dataclass(frozen=True)
class AssignmentReport:
    """What became of every event."""

    total: int
    to_segments: int
    to_nodes: int
    missing: int
    null_island: int
    outside: int
    too_far: int
    radii: Radii

    @property
    def assigned(self) -> int:
        return self.to_segments + self.to_nodes

    @property
    def dropped(self) -> int:
        return self.missing + self.null_island + self.outside + self.too_far

    def check(self) -> AssignmentReport:
        if self.assigned + self.dropped != self.total:
            raise SpatialJoinError(f"{self.total - self.assigned - self.dropped} events were lost silently")
        return self

    def summary(self) -> str:
        return (
            f"{self.assigned} of {self.total} events assigned ({_share(self.assigned, self.total)}): {self.to_segments} to segments within {self.radii.join_ft:g} ft, {self.to_nodes} to nodes within {self.radii.node_ft:g} ft; "
            f"{self.dropped} dropped: {self.missing} without coordinates, {self.null_island} at (0, 0), {self.outside} outside the bounds, {self.too_far} beyond {self.radii.join_ft:g} ft of any unit"
        )


def assign(events: DataFrame, units: DataFrame, event_id: str = "crash_id", radii: Radii = DEFAULT_RADII, path: str = "path") -> DataFrame:
    """event_id, unit_id, distance, stage: junctions within ``radii.node_ft`` claim first, then segments within ``radii.join_ft``.

    ``events`` has stored ids (not made anew in each run) and x, y of rows that have no drop reason.
    """
    if units.limit(1).count() == 0:
        raise SpatialJoinError("the universe is empty")
    nodes = nearest_within(events, units.where("unit_type = 'intersection'"), radii.node_ft, event_id, "unit_id", path)
    rest = events.join(nodes.select(event_id), event_id, "left_anti")
    return claims(nodes, nearest_within(rest, units.where("unit_type = 'corridor'"), radii.join_ft, event_id, "unit_id", path), event_id, radii)


def claims(nodes: DataFrame, lines: DataFrame, event_id: str, radii: Radii) -> DataFrame:
    """What assign() makes of each event's nearest junction and nearest segment, found within these radii or wider ones."""
    near = nodes.where(F.col("distance") <= radii.node_ft).withColumn("stage", F.lit("intersection"))
    rest = lines.where(F.col("distance") <= radii.join_ft).join(near.select(event_id), event_id, "left_anti")
    return near.unionByName(rest.withColumn("stage", F.lit("corridor")))


def assignment_report(reasoned: DataFrame, assigned: DataFrame, radii: Radii = DEFAULT_RADII) -> AssignmentReport:
    """The books of drop_reasons() and assign(), from one aggregate each; raises if they don't balance."""
    r = reasoned.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("drop_reason") == k).alias(k) for k in ("missing", "null_island", "outside"))).first()
    a = assigned.agg(F.count_if(F.col("stage") == "corridor"), F.count_if(F.col("stage") == "intersection")).first()
    kept = r["n"] - r["missing"] - r["null_island"] - r["outside"]
    return AssignmentReport(r["n"], a[0], a[1], r["missing"], r["null_island"], r["outside"], kept - a[0] - a[1], radii).check()
