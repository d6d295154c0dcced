"""Published priority labels and treatments, by distance to units."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from segrank.config import DEFAULT_RADII, TREATMENT_DATE_COLUMNS, TREATMENT_FT
from segrank.functions.guards import SpatialJoinError, require_columns
from segrank.functions.scalars import instant
from segrank.operators.geo import least_within, touching, untouched


def labelled(units: DataFrame, corridors: DataFrame, nodes: DataFrame, radius: float = DEFAULT_RADII.label_ft, path: str = "path") -> DataFrame:
    """units with is_priority and vzv_source.

    The corridor layer labels both kinds of unit, the node layer junctions only. The number of units stays.
    """
    shapes = units.select("unit_id", "unit_type", F.col(path).alias("_u"))
    layers = (("corridor", corridors, shapes), ("intersection", nodes, shapes.where("unit_type = 'intersection'")))
    found = [touching(of, features, radius, "unit_id", "_u", path).withColumn("layer", F.lit(name)) for name, features, of in layers]
    flags = found[0].unionByName(found[1]).groupBy("unit_id").agg(F.array_join(F.array_sort(F.collect_set("layer")), "+").alias("vzv_source"))
    return units.join(flags, "unit_id", "left").withColumn("is_priority", F.col("vzv_source").isNotNull())


def unmatched(units: DataFrame, corridors: DataFrame, nodes: DataFrame, radius: float = DEFAULT_RADII.label_ft, feature_id: str = "feature_id", path: str = "path") -> DataFrame:
    """layer, feature_id of the features that label no unit."""
    of = F.when(F.col("unit_type") == "intersection", F.array(F.lit("corridor"), F.lit("intersection"))).otherwise(F.array(F.lit("corridor")))
    shapes = units.select(F.explode(of).alias("layer"), F.col(path).alias("_u"))
    features = [f.select(F.lit(name).alias("layer"), feature_id, path) for name, f in (("corridor", corridors), ("intersection", nodes))]
    return untouched(features[0].unionByName(features[1]), shapes, radius, "layer", feature_id, path, "_u")


def priority_labels(units: DataFrame, corridors: DataFrame, nodes: DataFrame, radius: float = DEFAULT_RADII.label_ft, feature_id: str = "feature_id", path: str = "path") -> tuple[DataFrame, DataFrame]:
    """labelled() and unmatched()."""
    return labelled(units, corridors, nodes, radius, path), unmatched(units, corridors, nodes, radius, feature_id, path)


def treatment_date_column(layer: DataFrame) -> str:
    for c in TREATMENT_DATE_COLUMNS:
        if c in layer.columns:
            return c
    raise SpatialJoinError(f"a treatment layer has none of {TREATMENT_DATE_COLUMNS}")


def treatments(units: DataFrame, layers: list[DataFrame], radius: float = TREATMENT_FT, feature_id: str = "feature_id", path: str = "path") -> tuple[DataFrame, DataFrame]:
    """units with treated and treatment_date (the earliest of dated features of all layers), and a report of records, undated."""
    dated, counted = None, None
    for layer in layers:
        require_columns(layer, [feature_id, path], SpatialJoinError, "treatment layer")
        part = layer.select(F.col(path).alias("_p"), instant(treatment_date_column(layer)).alias("_d"))
        report = part.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("_d").isNull()).alias("undated"))
        dated = part if dated is None else dated.unionByName(part)
        counted = report if counted is None else counted.unionByName(report)
    dated = dated.where(F.col("_d").isNotNull())
    first = least_within(units.select("unit_id", F.col(path).alias("_u")), dated, radius, "unit_id", "_d", "_u", "_p").withColumnRenamed("_d", "treatment_date")
    out = units.join(first, "unit_id", "left").withColumn("treated", F.col("treatment_date").isNotNull())
    return out, counted.agg(F.sum("records").alias("records"), F.sum("undated").alias("undated"))
