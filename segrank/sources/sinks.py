"""Artifacts: scored units, run summary and shortlist, written whole or not at all."""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession, functions as F

from segrank.config import DEFAULT_RADII, SCORED_COLUMNS, Radii
from segrank.functions.guards import AuditError, ScreeningError, require_columns
from segrank.functions.guards import duplicate_keys
from segrank.operators.rank import top_n

SCORED, SUMMARY, SHORTLIST = "scored-units.parquet", "run-summary.json", "top-50.csv"
SHORTLIST_COLUMNS = ("unit_id", "unit_type", "borough", "full_street_name", "casualties_36mo", "holdout_casualties", "spf_prediction", "eb_estimate", "is_priority", "treated")


def scored_frame(scored: DataFrame) -> DataFrame:
    """The published columns, in order; raises if one is missing."""
    require_columns(scored, SCORED_COLUMNS, ScreeningError, "scored units")
    return scored.select(*SCORED_COLUMNS)


def with_provenance(df: DataFrame, column: str, notes: dict) -> DataFrame:
    """Notes in a column's metadata, which parquet keeps."""
    return df.withColumn(column, F.col(column).alias(column, metadata={k: str(v) for k, v in notes.items()}))


def write_artifacts(scored: DataFrame, summary: dict, folder: str, radii: Radii = DEFAULT_RADII) -> bool:
    """All files into a staging folder first, then into place. Other than the default radii never overwrite: returns False."""
    if radii != DEFAULT_RADII:
        return False
    stage = os.path.join(folder, "_staging")
    shutil.rmtree(stage, ignore_errors=True)
    os.makedirs(stage)
    notes = {"snapshot": summary.get("snapshot"), "radii": radii.tag, "n": summary.get("n"), "dispersion": json.dumps(summary.get("dispersion"))}
    with_provenance(scored_frame(scored), "unit_id", notes).write.option("compression", "zstd").parquet(f"{stage}/{SCORED}")
    top_n(scored, "eb_estimate", 50).select(*(c for c in SHORTLIST_COLUMNS if c in scored.columns)).coalesce(1).write.csv(f"{stage}/{SHORTLIST}", header=True)
    with open(f"{stage}/{SUMMARY}", "w", encoding="utf-8") as f:
        json.dump(summary, f, indent=2, sort_keys=True, default=str)
    for name in (SCORED, SHORTLIST, SUMMARY):
        target = os.path.join(folder, name)
        if os.path.isdir(target):
            shutil.rmtree(target)
        os.replace(os.path.join(stage, name), target)
    os.rmdir(stage)
    return True


def load_artifacts(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """Scored units and summary; raises if snapshot or radii differ between them, or a unit is there twice."""
    df = spark.read.parquet(os.path.join(folder, SCORED))
    with open(os.path.join(folder, SUMMARY), encoding="utf-8") as f:
        summary = json.load(f)
    notes = df.schema["unit_id"].metadata
    if notes.get("snapshot") != str(summary.get("snapshot")):
        raise AuditError(f"units are of snapshot {notes.get('snapshot')}, the summary of {summary.get('snapshot')}")
    if notes.get("radii") != Radii(**summary["radii"]).tag:
        raise AuditError(f"units are of radii {notes.get('radii')}, the summary of {summary['radii']}")
    if duplicate_keys(df, "unit_id").limit(1).count():
        raise AuditError("units are there twice")
    return df, summary
