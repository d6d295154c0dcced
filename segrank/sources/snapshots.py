"""Dated snapshot folders: parquet tables with a manifest."""

from __future__ import annotations

import datetime
import json
import os
import shutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from segrank.config import CRS_GEOGRAPHIC
from segrank.functions.guards import IncompletePullError, SourceError, with_srid
from segrank.operators.geo import geojson_to_wkt, parse_wkt
from segrank.operators.universe import borough_names

MANIFEST = "manifest.json"


def latest_snapshot(root: str) -> str:
    """The newest dated folder that has a manifest."""
    found = [d for d in (sorted(os.listdir(root)) if os.path.isdir(root) else []) if os.path.exists(os.path.join(root, d, MANIFEST))]
    if not found:
        raise SourceError(f"{root} has no complete snapshot")
    return os.path.join(root, found[-1])


def read_table(spark: SparkSession, snapshot: str, key: str) -> DataFrame:
    return spark.read.parquet(f"{snapshot}/{key}.parquet")


def read_geo(spark: SparkSession, snapshot: str, key: str, wkt: str = "geometry_wkt", out: str = "parts") -> DataFrame:
    """A table with its geometry parsed and tagged; rows without geometry go."""
    df = read_table(spark, snapshot, key).where(F.col(wkt).isNotNull())
    return with_srid(df.withColumn(out, parse_wkt(wkt)).where(F.size(out) > 0), out, CRS_GEOGRAPHIC)


def read_centerline(spark: SparkSession, snapshot: str, key: str = "centerline") -> DataFrame:
    """The street lines with borough names; unknown codes stay, as NULL."""
    return borough_names(read_geo(spark, snapshot, key))


def pull_table(df: DataFrame, folder: str, key: str, force: bool = False, geometry: str | None = None, expected: Callable[[], int] | None = None) -> bool:
    """Write a table unless it is there; a GeoJSON column becomes geometry_wkt. Returns whether it was written.

    It is written beside its place first, and moved only if the written rows are as many as ``expected``, so that what
    was counted is what is used.
    """
    path = f"{folder}/{key}.parquet"
    if os.path.exists(path) and not force:
        return False
    if geometry:
        df = df.withColumn("geometry_wkt", geojson_to_wkt(geometry)).drop(geometry)
    new = f"{folder}/_new-{key}.parquet"
    df.write.mode("overwrite").option("compression", "zstd").parquet(new)
    if expected is not None:
        there, wanted = df.sparkSession.read.parquet(new).count(), expected()
        if not wanted or there != wanted:
            shutil.rmtree(new)
            raise IncompletePullError(f"{key}: {there} rows of {wanted}") if wanted else SourceError(f"{key} has no rows")
    shutil.rmtree(path, ignore_errors=True)
    os.replace(new, path)
    return True


def pull_all(spark: SparkSession, tables: dict[str, Callable[[], DataFrame]], root: str, date: str | None = None, force: bool = False, geometry: dict[str, str] | None = None, expected: dict[str, Callable[[], int]] | None = None) -> int:
    """Pull every table into ``root``/date and write the manifest; a failed one is recorded, and 1 returned."""
    folder = os.path.join(root, date or datetime.date.today().isoformat())
    os.makedirs(folder, exist_ok=True)
    done, failed = {}, {}
    for key, make in tables.items():
        try:
            pull_table(make(), folder, key, force, (geometry or {}).get(key), (expected or {}).get(key))
            done[key] = read_table(spark, folder, key).count()
        except Exception as e:  # noqa: BLE001  recorded, and the others still pulled
            failed[key] = f"{type(e).__name__}: {e}"[:500]
    with open(os.path.join(folder, MANIFEST), "w", encoding="utf-8") as f:
        json.dump({"date": os.path.basename(folder), "rows": done, "failed": failed}, f, indent=2, sort_keys=True)
    return int(bool(failed))
