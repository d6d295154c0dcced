"""Geometry as plain columns, and spatial joins by grid cells.

A point is x, y; a line is ARRAY<STRUCT<x, y>>.  A join within a distance puts both sides into cells,
so it is an equi-join that shuffles by cell, with an exact test behind it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from segrank.config import BOUNDS_FT, CRS_GEOGRAPHIC, CRS_PROJECTED
from segrank.functions.guards import SpatialJoinError, require_columns, require_srid, with_srid
from segrank.sources.work import stored

NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
PATH = "array<struct<x:double,y:double>>"
ENDS = ("ax", "ay", "bx", "by")


def parse_wkt(wkt: Column | str) -> Column:
    """ARRAY of parts, each an ARRAY of points, of a POINT, LINESTRING, MULTIPOINT or MULTILINESTRING; NULL for other text."""
    wkt = F.col(wkt) if isinstance(wkt, str) else wkt
    body = F.regexp_extract(wkt, r"(?is)^\s*(?:MULTI)?(?:POINT|LINESTRING)\s*Z?\s*(\(.*\))\s*$", 1)
    parts = F.regexp_extract_all(body, F.lit(r"\(([^()]*)\)"), 1)

    def point(text: Column) -> Column:
        xy = F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1)
        return F.struct(F.get(xy, F.lit(0)).try_cast("double").alias("x"), F.get(xy, F.lit(1)).try_cast("double").alias("y"))

    lines = F.transform(parts, lambda p: F.filter(F.transform(F.split(p, ","), point), lambda q: q["x"].isNotNull() & q["y"].isNotNull()))
    return F.when(F.size(parts) > 0, F.filter(lines, lambda x: F.size(x) > 0))


def geojson_to_wkt(text: Column | str) -> Column:
    """WKT of a GeoJSON Point, LineString or MultiLineString; NULL for what is malformed, so that rows stay."""
    text = F.col(text) if isinstance(text, str) else text
    kind = F.get_json_object(text, "$.type")
    pair = lambda p: F.concat_ws(" ", p)
    line = lambda ps: F.concat(F.lit("("), F.array_join(F.transform(ps, pair), ", "), F.lit(")"))
    at = lambda schema: F.from_json(F.get_json_object(text, "$.coordinates"), schema)
    one, many, deep = at("array<string>"), at("array<array<string>>"), at("array<array<array<string>>>")
    return (
        F.when((kind == "Point") & (F.size(one) >= 2), F.concat(F.lit("POINT ("), pair(one), F.lit(")")))
        .when((kind == "LineString") & (F.size(many) >= 2), F.concat(F.lit("LINESTRING "), line(many)))
        .when((kind == "MultiLineString") & (F.size(deep) >= 1), F.concat(F.lit("MULTILINESTRING ("), F.array_join(F.transform(deep, line), ", "), F.lit(")")))
    )


def _lambert() -> tuple[float, ...]:
    """Constants of the conic projection with two standard parallels on GRS80 (EPSG:2263), lengths in metres."""
    a, f = 6378137.0, 1 / 298.257222101
    e = math.sqrt(2 * f - f * f)
    p1, p2, p0, l0 = (math.radians(x) for x in (41 + 2 / 60, 40 + 40 / 60, 40 + 10 / 60, -74.0))
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    big = m(p1) / (n * t(p1) ** n)
    return a, e, n, big, a * big * t(p0) ** n, l0


def reproject(lon: Column, lat: Column) -> tuple[Column, Column]:
    """x, y in US survey feet (EPSG:2263) of degrees (EPSG:4326), in closed form; NULL outside the range of degrees."""
    a, e, n, big, rho0, l0 = _lambert()
    foot, east = 1200 / 3937, 300_000.0
    p = F.radians(lat)
    t = F.tan(F.lit(math.pi / 4) - p / 2) / F.pow((1 - e * F.sin(p)) / (1 + e * F.sin(p)), F.lit(e / 2))
    rho, theta = F.lit(a * big) * F.pow(t, F.lit(n)), F.lit(n) * (F.radians(lon) - F.lit(l0))
    ok = lat.between(-89.9, 89.9) & lon.between(-180, 180)
    return F.when(ok, (F.lit(east) + rho * F.sin(theta)) / foot), F.when(ok, (F.lit(rho0) - rho * F.cos(theta)) / foot)


def project_path(path: Column | str) -> Column:
    """A line of degrees as a line of feet."""
    def moved(q: Column) -> Column:
        x, y = reproject(q["x"], q["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(path, moved)


def project(df: DataFrame, column: str) -> DataFrame:
    """A geometry column from EPSG:4326 to EPSG:2263; raises if it is tagged otherwise."""
    require_srid(df, column, CRS_GEOGRAPHIC)
    return with_srid(df.withColumn(column, project_path(column)), column, CRS_PROJECTED)


def path_length(path: Column | str) -> Column:
    """Length of a line; 0 for a point."""
    path = F.col(path) if isinstance(path, str) else path
    steps = F.zip_with(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def point_segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.when(size > 0, size)))).otherwise(F.lit(0.0))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def in_bounds(x: Column, y: Column, bounds=BOUNDS_FT) -> Column:
    return x.between(bounds[0], bounds[2]) & y.between(bounds[1], bounds[3])


def pieces(df: DataFrame, path: str, *keep: str) -> DataFrame:
    """One row for each straight piece of a line: ax, ay, bx, by; a point is a piece of no length."""
    p = F.col(path)
    ends = F.when(F.size(p) == 1, F.array(F.struct(p[0].alias("a"), p[0].alias("b")))).otherwise(F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(1))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    rows = df.where(F.size(p) > 0).select(*keep, F.explode(ends).alias("_e"))
    return rows.select(*keep, F.col("_e.a.x").alias("ax"), F.col("_e.a.y").alias("ay"), F.col("_e.b.x").alias("bx"), F.col("_e.b.y").alias("by")).where("ax is not null and ay is not null and bx is not null and by is not null")


def _cell(c: Column, size: float | Column) -> Column:
    return F.floor(c / F.lit(size)).cast("bigint")


def _cells(rows: DataFrame, size: float | Column, around: float) -> DataFrame:
    """Adds cx, cy of every cell that the piece, cut into parts no longer than two cells and widened by ``around``, may touch, each once.

    Long pieces are cut first, so that a diagonal doesn't fill its whole bounding box.
    """
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / F.lit(2 * size))).cast("int")
    part = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("_n")
    low = lambda a, b, i: _cell(F.least(part(a, b, i), part(a, b, i + 1)) - around, size)
    high = lambda a, b, i: _cell(F.greatest(part(a, b, i), part(a, b, i + 1)) + around, size)
    box = lambda i: F.flatten(F.transform(F.sequence(low("ax", "bx", i), high("ax", "bx", i)), lambda cx: F.transform(F.sequence(low("ay", "by", i), high("ay", "by", i)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))
    at = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), box)))
    rows = rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)  # a small file can be many cells
    rows = rows.withColumn("_n", n).withColumn("_at", F.explode(at))
    return rows.withColumns({"cx": F.col("_at.cx"), "cy": F.col("_at.cy")}).drop("_n", "_at")


def _dealt(rows: DataFrame, cx: str = "cx", cy: str = "cy") -> DataFrame:
    """Rows dealt by cell to a fixed number of tasks: few bytes can be much work here, and AQE would merge them into one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), cx, cy)


def _candidates(points: DataFrame, lines: DataFrame, radius: float, point_id: str, unit_id: str, path: str, x: str, y: str) -> DataFrame:
    """point_id, unit_id, distance within ``radius``, a row for each piece."""
    if radius <= 0:
        raise SpatialJoinError("a radius must be positive")
    left = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(point_id), F.col(x).alias("px"), F.col(y).alias("py"), _cell(F.col(x), radius).alias("cx"), _cell(F.col(y), radius).alias("cy"))
    right = _cells(pieces(lines, path, unit_id), radius, radius)
    d = point_segment_distance(*(F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")))
    # the planner takes exploded cells for few and would broadcast them
    return _dealt(left).join(_dealt(right).hint("merge"), ["cx", "cy"]).select(point_id, unit_id, d.alias("distance")).where(F.col("distance") <= radius)


def near_points(points: DataFrame, lines: DataFrame, radius: float, point_id: str, unit_id: str, path: str = "path", x: str = "x", y: str = "y") -> DataFrame:
    """point_id, unit_id, distance of all pairs within ``radius``, each once."""
    return _candidates(points, lines, radius, point_id, unit_id, path, x, y).groupBy(point_id, unit_id).agg(F.min("distance").alias("distance"))


def _radii(points: DataFrame, radius: float, x: str, y: str) -> list[float]:
    """Rising radii that end with ``radius``, in steps of four; the first is about the space between two points."""
    at = F.struct(_cell(F.col(x), radius), _cell(F.col(y), radius))
    n, cells = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count(F.lit(1)), F.approx_count_distinct(at)).first()
    out = [radius]
    while n and out[0] / 4 >= radius * math.sqrt(cells / n):
        out.insert(0, out[0] / 4)
    return out


def nearest_within(points: DataFrame, lines: DataFrame, radius: float, point_id: str, unit_id: str, path: str = "path", x: str = "x", y: str = "y") -> DataFrame:
    """point_id, unit_id, distance: for each point the nearest line within ``radius``, of equally near ones the smallest id.

    A point with any line within a smaller radius has its nearest there, so crowded points are settled in small
    cells, and only those without a line so near go on to the next radius.
    """
    if radius <= 0:
        raise SpatialJoinError("a radius must be positive")
    out, rest = None, points
    steps = _radii(points, radius, x, y)
    for r in steps:
        best = _candidates(rest, lines, r, point_id, unit_id, path, x, y).groupBy(point_id).agg(F.min(F.struct("distance", unit_id)).alias("_b"))
        found = best.select(point_id, F.col(f"_b.{unit_id}").alias(unit_id), F.col("_b.distance").alias("distance"))
        if r < steps[-1]:
            found = stored(found, "nearest")
            rest = rest.join(found.select(point_id), point_id, "left_anti")
        out = found if out is None else out.unionByName(found)
    return out


def _near(radius: float) -> Column:
    """Whether the pieces ax..by and rax..rby are within ``radius``: exact, with nothing buffered."""
    p, q, r, s = ((F.col(k + "x"), F.col(k + "y")) for k in ("a", "b", "ra", "rb"))
    side = lambda o, u, v: (u[0] - o[0]) * (v[1] - o[1]) - (u[1] - o[1]) * (v[0] - o[0])
    crossing = (side(p, q, r) * side(p, q, s) < 0) & (side(r, s, p) * side(r, s, q) < 0)
    gap = F.least(point_segment_distance(*p, *r, *s), point_segment_distance(*q, *r, *s), point_segment_distance(*r, *p, *q), point_segment_distance(*s, *p, *q))
    apart = lambda c: (F.greatest(f"a{c}", f"b{c}") + radius * 1.001 < F.least(f"ra{c}", f"rb{c}")) | (F.greatest(f"ra{c}", f"rb{c}") + radius * 1.001 < F.least(f"a{c}", f"b{c}"))
    return ~apart("x") & ~apart("y") & (crossing | (gap <= radius))  # boxes are cheap and tell most pairs apart


def _both(left: DataFrame, right: DataFrame, radius: float, size: float, left_id: str, left_path: str, right_path: str, *keep: str) -> tuple[DataFrame, DataFrame, Column]:
    """Pieces of both sides by cell, and the test whether two of them are within ``radius``."""
    require_columns(left, [left_id, left_path], SpatialJoinError)
    require_columns(right, [right_path, *keep], SpatialJoinError)
    a = _cells(pieces(left, left_path, left_id), size, 0.0)
    b = _cells(pieces(right, right_path, *keep), size, radius).select(*keep, "cx", "cy", *(F.col(c).alias(f"r{c}") for c in ENDS))
    return _dealt(a), _dealt(b), _near(radius)


def lines_within(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, left_path: str = "path", right_path: str = "path") -> DataFrame:
    """left_id, right_id of lines (or points) whose distance is ``radius`` or less."""
    a, b, near = _both(left, right, radius, radius, left_id, left_path, right_path, right_id)
    return a.join(b, ["cx", "cy"]).where(near).select(left_id, right_id).distinct()


def cell_width(lines: DataFrame, radius: float, path: str = "path") -> float:
    """Cells for searches that stop at the first hit: a quarter of a piece's average length, twice the radius at least."""
    return max(2 * radius, (pieces(lines, path).agg(F.avg(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))).first()[0] or 0.0) / 4)


def touching(left: DataFrame, right: DataFrame, radius: float, left_id: str, left_path: str = "path", right_path: str = "path", width: float | None = None) -> DataFrame:
    """left_id of lines (or points) that have any of ``right`` within ``radius``.

    A semi-join with the exact test as its condition: a piece stops at its first hit, so crowds don't make pairs.
    """
    a, b, near = _both(left, right, radius, width or cell_width(right, radius, right_path), left_id, left_path, right_path)
    b = b.withColumnsRenamed({"cx": "rcx", "cy": "rcy"})
    return a.join(b, (F.col("cx") == F.col("rcx")) & (F.col("cy") == F.col("rcy")) & near, "left_semi").select(left_id).distinct()


def untouched(left: DataFrame, right: DataFrame, radius: float, group: str, left_id: str, left_path: str = "path", right_path: str = "path") -> DataFrame:
    """group, left_id of lines (or points) that have none of ``right`` in the same ``group`` within ``radius``.

    Both sides bear ``group``; it has few values, and cells of its own width for each. Pieces at the same place are
    tested once, and each stops at its first hit. It is first tried in the cell of its middle alone, which settles most
    of a crowd, and only lines without a hit there are put into all their cells. Both sides are stored first, as each
    of these steps reads them.
    """
    require_columns(left, [group, left_id, left_path], SpatialJoinError)
    require_columns(right, [group, right_path], SpatialJoinError)
    both = left.select(group, left_id, F.col(left_path).alias("_p"), F.lit(True).alias("_l")).unionByName(right.select(group, F.col(right_path).alias("_p"), F.lit(False).alias("_l")), allowMissingColumns=True)
    both = stored(both, "sides")
    left, right = both.where("_l"), both.where("not _l")
    long = F.avg(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    width = F.lit(2.0 * radius)
    for g, mean in pieces(left, "_p", group).groupBy(group).agg(long).collect():
        width = F.when(F.col(group) == g, F.lit(max(2.0 * radius, (mean or 0.0) / 4))).otherwise(width)
    shapes, size = pieces(left, "_p", group, left_id), F.col("_w")
    places = lambda rows: rows.select(group, *ENDS).distinct().withColumn("_w", width)
    b = _cells(places(pieces(right, "_p", group)), size, radius)
    b = _dealt(b.select(F.col(group).alias("_rgroup"), F.col("cx").alias("rcx"), F.col("cy").alias("rcy"), *(F.col(c).alias(f"r{c}") for c in ENDS)), "rcx", "rcy").hint("merge")
    same = (F.col(group) == F.col("_rgroup")) & (F.col("cx") == F.col("rcx")) & (F.col("cy") == F.col("rcy")) & _near(radius)
    middle = lambda c: _cell((F.col(f"a{c}") + F.col(f"b{c}")) / 2, size)

    def hits(a: DataFrame) -> DataFrame:
        at = _dealt(a).join(b, same, "left_semi").select(group, *ENDS).distinct()
        return shapes.join(at.hint("merge"), [group, *ENDS], "left_semi").select(group, left_id).distinct()

    first = stored(hits(places(shapes).withColumns({"cx": middle("x"), "cy": middle("y")})), "hit")
    rest = hits(_cells(places(shapes.join(first.hint("merge"), [group, left_id], "left_anti")), size, 0.0))
    return left.select(group, left_id).join(first.unionByName(rest).hint("merge"), [group, left_id], "left_anti")


def least_within(left: DataFrame, right: DataFrame, radius: float, left_id: str, value: str, left_path: str = "path", right_path: str = "path") -> DataFrame:
    """left_id and the smallest ``value`` of those of ``right`` within ``radius``.

    In each cell ``right`` is ordered by value and cut into groups, each four times as large as the one before. A piece
    looks for its first group with a hit, stopping in each at the first, and only that group is searched whole.
    """
    a, b, near = _both(left, right, radius, cell_width(right, radius, right_path), left_id, left_path, right_path, value)
    place = F.row_number().over(Window.partitionBy("cx", "cy").orderBy(value))
    b = stored(b.withColumn("_g", F.floor(F.log2(place) / 2).cast("int")).withColumnsRenamed({"cx": "rcx", "cy": "rcy", "_g": "_rg"}), "by_value")
    groups = b.select(F.col("rcx").alias("cx"), F.col("rcy").alias("cy"), F.col("_rg").alias("_g")).distinct()
    same = (F.col("cx") == F.col("rcx")) & (F.col("cy") == F.col("rcy")) & (F.col("_g") == F.col("_rg")) & near
    first = a.join(groups, ["cx", "cy"]).join(b, same, "left_semi").groupBy(left_id, "cx", "cy", "ax", "ay", "bx", "by").agg(F.min("_g").alias("_g"))
    return first.join(b, same).groupBy(left_id).agg(F.min(value).alias(value))
