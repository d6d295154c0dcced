"""The universe of units: street segments, and junctions derived from where they meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from segrank.config import BOROUGH_CODES, CRS_PROJECTED, MIN_LENGTH_FT, ROAD_ATTRIBUTES
from segrank.functions.guards import SpatialJoinError, require_srid, require_unique, with_srid
from segrank.functions.scalars import clean_token, half_even, number
from segrank.operators.geo import path_length


def borough_names(df: DataFrame, code: str = "boroughcode", out: str = "borough", codes: dict[str, str] = BOROUGH_CODES) -> DataFrame:
    """Codes to names; unknown codes give NULL and their rows stay."""
    names = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    return df.withColumn(out, F.try_element_at(names, F.trim(F.col(code).cast("string"))))


def is_highway(rw_type: str = "rw_type"):
    """1 for all but plain streets; a NULL road type counts as a highway."""
    return (F.coalesce(F.trim(rw_type), F.lit("")) != "1").cast("int")


def is_degenerate(length: str = "length_ft", minimum: float = MIN_LENGTH_FT):
    """Whether a piece is shorter than the least length, or has none."""
    return F.coalesce(F.col(length) < minimum, F.lit(True))


def segments(lines: DataFrame, parts: str = "parts", order: str = "row_no", min_length: float = MIN_LENGTH_FT) -> DataFrame:
    """One row for each part of each line: unit_id C0, C1, ... in the order of ``order`` and part, with length and flags.

    ``order`` is a stable whole number of the source row. Degenerate pieces are kept and flagged.
    """
    rows = lines.where(F.size(parts) > 0).select("*", F.posexplode(parts).alias("_part", "path")).where(F.size("path") > 0).drop(parts)
    rows = numbered(rows, [], order, [order, "_part"], "ordinal").withColumn("unit_id", F.concat(F.lit("C"), "ordinal")).drop("_part")
    rows = rows.withColumn("unit_type", F.lit("corridor")).withColumn("length_ft", path_length("path"))
    rows = rows.withColumns({c: number(c) for c in ROAD_ATTRIBUTES if c in rows.columns})
    if "rw_type" in rows.columns:
        rows = rows.withColumn("is_highway", is_highway())
    return rows.withColumn("degenerate_length", is_degenerate("length_ft", min_length))


#: Buckets of numbered() for each thousand rows of key, and at most for each leading value.
BUCKET_KEYS, MOST_BUCKETS = 1000, 10_000


def numbered(rows: DataFrame, lead: list[Column], key: str, order: list[str], out: str) -> DataFrame:
    """Adds 0, 1, ... by ``lead``, then ``order``, whose first column is the whole number ``key``, without one task for all.

    Rows are counted by bucket (lead, key div width) first; the table of buckets, of bounded size, is joined with the
    number of rows before each, and only rows of one bucket are sorted together.
    """
    top = rows.agg(F.max(key)).first()[0] or 0
    width = max(BUCKET_KEYS, -(-int(top) // MOST_BUCKETS))
    rows = rows.withColumns({f"_l{i}": c for i, c in enumerate(lead)} | {"_b": F.expr(f"`{key}` div {width}")})
    names = [*(f"_l{i}" for i in range(len(lead))), "_b"]
    sizes = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(F.broadcast(sizes.select(*names, before.alias("_before"))), names)
    place = F.row_number().over(Window.partitionBy(*names).orderBy(*order)) - 1
    return rows.withColumn(out, (F.col("_before") + place).cast("bigint")).drop(*names, "_before")


def endpoints(segs: DataFrame, path: str = "path") -> DataFrame:
    """Two rows for each segment, its rounded ends gx, gy; a loop has both at one node."""
    ends = F.array(F.struct(F.lit(0).alias("side"), F.element_at(path, 1).alias("p")), F.struct(F.lit(1).alias("side"), F.element_at(path, -1).alias("p")))
    return segs.select("*", F.explode(ends).alias("_e")).withColumns({"gx": half_even(F.col("_e.p.x")), "gy": half_even(F.col("_e.p.y")), "side": F.col("_e.side")}).drop("_e")


def junctions(segs: DataFrame) -> DataFrame:
    """Nodes where two or more segment ends meet, numbered I0, I1, ... by falling leg count, then first appearance."""
    ends = endpoints(segs)
    have = set(segs.columns)
    aggs = [F.count(F.lit(1)).alias("leg_count"), F.min(F.struct("ordinal", "side")).alias("_first")]
    if "borough" in have:
        aggs.append(F.mode("borough", True).alias("borough"))
    if "full_street_name" in have:
        aggs.append(F.array_join(F.slice(F.array_sort(F.collect_set(clean_token("full_street_name"))), 1, 3), " & ").alias("full_street_name"))
    for c, agg in (("posted_speed", F.max("posted_speed")), ("streetwidth", F.max("streetwidth")), ("number_travel_lanes", F.coalesce(F.sum("number_travel_lanes"), F.lit(0.0))), ("is_highway", F.max("is_highway"))):
        if c in have:
            aggs.append(agg.alias(c))
    nodes = ends.where("gx is not null and gy is not null").groupBy("gx", "gy").agg(*aggs).where("leg_count >= 2")
    nodes = nodes.withColumn("_key", 2 * F.col("_first.ordinal") + F.col("_first.side"))
    nodes = numbered(nodes, [-F.col("leg_count")], "_key", ["_key"], "_no")
    point = F.array(F.struct(F.col("gx").cast("double").alias("x"), F.col("gy").cast("double").alias("y")))
    return nodes.withColumn("unit_id", F.concat(F.lit("I"), "_no")).withColumn("unit_type", F.lit("intersection")).withColumn("path", point).drop("_first", "_key", "_no", "gx", "gy")


def union_units(segs: DataFrame) -> DataFrame:
    """Segments and the junctions where they meet, in one frame."""
    return segs.unionByName(junctions(segs), allowMissingColumns=True)


def build_universe(lines: DataFrame, parts: str = "parts", order: str = "row_no") -> DataFrame:
    """Segments and junctions in one frame, keys checked; ``parts`` must be in projected feet."""
    require_srid(lines, parts, CRS_PROJECTED)
    segs = segments(lines, parts, order)
    if segs.limit(1).count() == 0:
        raise SpatialJoinError("no segment has an endpoint")
    out = union_units(segs)
    keep = ["unit_id", "unit_type", "path", "length_ft", "degenerate_length", "borough", "full_street_name", "rw_type", *ROAD_ATTRIBUTES, "is_highway", "leg_count"]
    out = out.select(*(c for c in keep if c in out.columns))
    require_unique(out, "unit_id", SpatialJoinError)
    return with_srid(out, "path", CRS_PROJECTED)
