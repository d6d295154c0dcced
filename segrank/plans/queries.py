"""The operators over the driver's tables, and the same in SQL.

Units are parts (even keys corridors, odd ones junctions), events are line items, points and lines
come from embeddings; see UNITS and EVENTS for the mapping.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from segrank.config import BOOTSTRAP_ITERATIONS, PREDICTORS, ROAD_ATTRIBUTES, Radii, ZERO_BUDGETS, ZERO_DRAWS
from segrank.functions import scalars as fn
from segrank.functions.guards import duplicate_keys
from segrank.operators import events as ev
from segrank.operators import features as ft
from segrank.operators import geo, labels
from segrank.operators import model as md
from segrank.operators import rank as rk
from segrank.operators import score as sc
from segrank.operators import universe as un
from segrank.sources.sinks import scored_frame
from segrank.sources.work import discard, stored

AS_OF, HOLD_END = "2000-01-01 00:00:00", "2002-01-01 00:00:00"
K = {"corridor": 0.8, "intersection": 1.3}
SIZES = (10, 50, 100, 400)
TYPES = ("click", "view", "purchase")

#: Expressions that mean the same in Spark and DuckDB.
UNIT_ID = "concat(CASE WHEN {0} % 2 = 0 THEN 'C' ELSE 'I' END, CAST({0} AS STRING))"
UNITS = {
    "unit_id": UNIT_ID.format("p_partkey"),
    "unit_type": "CASE WHEN p_partkey % 2 = 0 THEN 'corridor' ELSE 'intersection' END",
    "borough": "CASE CAST(floor(p_partkey / 2.0) AS BIGINT) % 6 WHEN 0 THEN 'MANHATTAN' WHEN 1 THEN 'BROOKLYN' WHEN 2 THEN 'QUEENS' WHEN 3 THEN 'BRONX' WHEN 4 THEN 'STATEN ISLAND' END",
    "length_ft": "CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_size <= 2 THEN CAST(0.0 AS DOUBLE) ELSE p_retailprice END END",
    "leg_count": "CASE WHEN p_partkey % 2 = 1 THEN CAST((p_size % 4) + 2 AS BIGINT) END",
    "posted_speed": "nullif(p_size, 7)",
    "number_travel_lanes": "nullif(p_partkey % 5 + 1, 3)",
    "streetwidth": "CAST(nullif(p_partkey % 23 + 20, 31) AS DOUBLE)",
    "rw_type": "CASE p_size % 3 WHEN 0 THEN '1' WHEN 1 THEN ' 2' END",
    "is_priority": "p_size >= 40",
    "p_name": "p_name",
    "p_brand": "p_brand",
}
EVENTS = {
    "unit_id": UNIT_ID.format("l_partkey"),
    "crash_date": "l_shipdate",
    "killed": "CASE WHEN l_discount >= 0.09 AND l_returnflag = 'R' THEN CAST(CAST(l_quantity AS BIGINT) AS STRING) WHEN l_discount < 0.02 THEN 'x' END",
    "injured": "'0'",
    "l_orderkey": "l_orderkey",
    "l_linenumber": "l_linenumber",
    "latitude": "CASE WHEN l_quantity < 3 THEN NULL WHEN l_quantity < 6 THEN '0' ELSE CAST(l_extendedprice * 4 AS STRING) END",
    "longitude": "CASE WHEN l_quantity < 3 THEN 'bad' WHEN l_quantity < 6 THEN '0' ELSE CAST(900000 + l_extendedprice * 2 AS STRING) END",
}
_cols = lambda m: ", ".join(f"{e} AS {c}" for c, e in m.items())
_stamp = lambda t: f"timestamp '{t}'"
_ntz = lambda t: F.expr(f"timestamp_ntz'{t}'")
_back = lambda m: f"(timestamp '{AS_OF}' - INTERVAL '{m}' MONTH)"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def units(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").selectExpr(*(f"{e} AS {c}" for c, e in UNITS.items()))


def events(spark: SparkSession, d: str) -> DataFrame:
    raw = _table(spark, d, "lineitem").selectExpr(*(f"{e} AS {c}" for c, e in EVENTS.items()))
    return ev.label_casualties(raw, "killed", "injured")


def treated(spark: SparkSession, d: str) -> DataFrame:
    """Units with the earliest urgent order as their treatment."""
    urgent = _table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    first = events(spark, d).join(urgent, "l_orderkey").groupBy("unit_id").agg(F.min("o_orderdate").alias("treatment_date"))
    return units(spark, d).join(first, "unit_id", "left").withColumn("treated", F.col("treatment_date").isNotNull())


def history(spark: SparkSession, d: str) -> DataFrame:
    """Units with their trailing windows and the holdout's casualties."""
    e = events(spark, d)
    return ft.fill_join(units(spark, d), ft.trailing(e, _ntz(AS_OF), holdout=(_ntz(AS_OF), _ntz(HOLD_END))))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """History with a prediction from exposure and a blend at a fixed dispersion."""
    out = ft.exposure(history(spark, d)).withColumn("spf_prediction", F.when(F.col("exposure_valid"), F.when(F.col("unit_type") == "corridor", F.col("exposure") / 1000.0).otherwise(F.col("exposure") / 3.0)))
    k = {t: md.empirical_bayes("spf_prediction", "casualties_36mo", v) for t, v in K.items()}
    blend = F.when(F.col("unit_type") == "corridor", k["corridor"]).otherwise(k["intersection"])
    return out.withColumn("eb_estimate", F.round(F.coalesce(blend, F.col("casualties_36mo").cast("double")), 9))


def points(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").selectExpr("vec_id", "cast(embedding[0] as double) * 4000 AS x", "cast(embedding[1] as double) * 4000 AS y")


def lines(spark: SparkSession, d: str, step: int = 2) -> DataFrame:
    """Line k from point k to point k + 1, for every step-th k."""
    p = points(spark, d)
    a, b = p.where(F.col("vec_id") % step == 0), p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    pt = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return a.join(b, "vec_id").select(F.concat(F.lit("C"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("unit_id"), "vec_id", F.array(pt("x", "y"), pt("bx", "by")).alias("path"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).where("vec_id % 2 = 1").select(F.concat(F.lit("I"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("unit_id"), "vec_id", F.array(F.struct("x", "y")).alias("path"))


# SQL that the oracles share
CTE = f"""u AS (SELECT {_cols(UNITS)} FROM part),
raw AS (SELECT {_cols(EVENTS)} FROM lineitem),
e AS (SELECT *, (coalesce(TRY_CAST(killed AS DOUBLE), 0) + coalesce(TRY_CAST(injured AS DOUBLE), 0))::BIGINT AS pedestrian_casualties FROM raw WHERE crash_date IS NOT NULL),
t AS (SELECT unit_id, {", ".join(f"sum(CASE WHEN crash_date > {_back(m)} AND crash_date <= {_stamp(AS_OF)} THEN pedestrian_casualties ELSE 0 END)::BIGINT AS casualties_{m}mo, count(CASE WHEN crash_date > {_back(m)} AND crash_date <= {_stamp(AS_OF)} THEN 1 END)::BIGINT AS crashes_{m}mo" for m in (12, 24, 36))},
  sum(CASE WHEN crash_date >= {_stamp(AS_OF)} AND crash_date < {_stamp(HOLD_END)} THEN pedestrian_casualties ELSE 0 END)::BIGINT AS holdout_casualties FROM e GROUP BY unit_id),
h AS (SELECT u.*, {", ".join(f"coalesce({c}, 0) AS {c}" for m in (12, 24, 36) for c in (f"casualties_{m}mo", f"crashes_{m}mo"))}, coalesce(holdout_casualties, 0) AS holdout_casualties FROM u LEFT JOIN t USING (unit_id)),
x AS (SELECT *, CASE WHEN unit_type = 'corridor' THEN length_ft ELSE leg_count::DOUBLE END AS exposure FROM h),
p AS (SELECT *, coalesce(exposure >= 1, false) AS exposure_valid, CASE WHEN exposure >= 1 THEN exposure / CASE WHEN unit_type = 'corridor' THEN 1000.0::DOUBLE ELSE 3.0::DOUBLE END END AS spf_prediction FROM x),
w AS (SELECT *, 1 / (1 + CASE WHEN unit_type = 'corridor' THEN {K['corridor']}::DOUBLE ELSE {K['intersection']}::DOUBLE END * greatest(spf_prediction, 1e-9)) AS weight FROM p),
s AS (SELECT *, md5(unit_id) AS tie, round(CASE WHEN spf_prediction IS NULL THEN casualties_36mo::DOUBLE ELSE weight * greatest(spf_prediction, 1e-9) + (1 - weight) * casualties_36mo END, 9) AS eb_estimate FROM w),
n AS (SELECT count(*) AS n FROM s WHERE is_priority)"""
TREATED = f"tr AS (SELECT {UNIT_ID.format('l_partkey')} AS unit_id, min(o_orderdate) AS treatment_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1)"
XY = "v AS (SELECT vec_id, embedding[1]::DOUBLE * 4000 AS x, embedding[2]::DOUBLE * 4000 AS y FROM embeddings)"
ALL_LINES = "l AS (SELECT concat('C', lpad(a.vec_id::VARCHAR, 9, '0')) AS unit_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)"
LINE = "l AS (SELECT concat('C', lpad(a.vec_id::VARCHAR, 9, '0')) AS unit_id, a.vec_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0), nd AS (SELECT concat('I', lpad(vec_id::VARCHAR, 9, '0')) AS unit_id, vec_id, x, y FROM v WHERE vec_id % 2 = 1)"


def _ps(px: str, py: str, a: str, b: str, c: str, d: str) -> str:
    """Distance of a point from a piece, in SQL."""
    t = f"CASE WHEN ({c}-{a})*({c}-{a})+({d}-{b})*({d}-{b}) > 0 THEN greatest(0.0, least(1.0, (({px}-{a})*({c}-{a})+({py}-{b})*({d}-{b})) / (({c}-{a})*({c}-{a})+({d}-{b})*({d}-{b})))) ELSE 0.0 END"
    return f"sqrt(pow({px}-({a}+({t})*({c}-{a})),2)+pow({py}-({b}+({t})*({d}-{b})),2))"


R = 100.0
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
O: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


@query(f"WITH {CTE}, {TREATED} SELECT unit_id, unit_type, borough, casualties_36mo, holdout_casualties, round(spf_prediction, 6) AS spf_prediction, round(eb_estimate, 6) AS eb_estimate, is_priority, treatment_date IS NOT NULL AS treated, treatment_date FROM s LEFT JOIN tr USING (unit_id)")
def a14_scored_projection(spark, d):
    full = scored(spark, d).join(treated(spark, d).select("unit_id", "treated", "treatment_date"), "unit_id")
    return scored_frame(full).withColumns({c: F.round(c, 6) for c in ("spf_prediction", "eb_estimate")})


@query("SELECT CASE o_custkey % 7 WHEN 0 THEN 'MANHATTAN' WHEN 1 THEN 'MANHATTAN' WHEN 2 THEN 'BRONX' WHEN 3 THEN 'BROOKLYN' WHEN 4 THEN 'QUEENS' WHEN 5 THEN 'STATEN ISLAND' END AS borough, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def a11_borough_codes(spark, d):
    codes = _table(spark, d, "orders").select(F.concat(F.lit(" "), F.greatest(F.col("o_custkey") % 7, F.when(F.col("o_custkey") % 7 == 0, F.lit(1)).otherwise(F.lit(0))).cast("string")).alias("boroughcode"))
    return un.borough_names(codes).groupBy("borough").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CTE} SELECT unit_id, crash_date, pedestrian_casualties FROM e")
def b1_label_coerce(spark, d):
    return events(spark, d).select("unit_id", "crash_date", "pedestrian_casualties")


@query(f"""WITH {CTE}, c AS (SELECT CASE WHEN TRY_CAST(latitude AS DOUBLE) IS NULL OR TRY_CAST(longitude AS DOUBLE) IS NULL THEN 'missing' WHEN TRY_CAST(latitude AS DOUBLE) = 0 AND TRY_CAST(longitude AS DOUBLE) = 0 THEN 'null_island'
 WHEN NOT (TRY_CAST(longitude AS DOUBLE) BETWEEN 900000 AND 1090000 AND TRY_CAST(latitude AS DOUBLE) BETWEEN 110000 AND 280000) THEN 'outside' END AS drop_reason FROM e) SELECT drop_reason, count(*)::BIGINT AS n FROM c GROUP BY 1""")
def b2_drop_reasons(spark, d):
    return ev.drop_reasons(events(spark, d), projected=True).groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CTE} SELECT unit_id, CASE WHEN coalesce(trim(rw_type), '') <> '1' THEN 1 ELSE 0 END AS is_highway FROM u")
def b6_flag_null_safe(spark, d):
    return units(spark, d).select("unit_id", un.is_highway().alias("is_highway"))


@query(f"WITH {CTE} SELECT unit_id, coalesce(length_ft < 1, true) AS degenerate_length FROM u WHERE unit_type = 'corridor'")
def b7_degenerate(spark, d):
    return units(spark, d).where(F.col("unit_type").isin("corridor")).select("unit_id", un.is_degenerate().alias("degenerate_length"))


@query(f"WITH {CTE} SELECT CASE WHEN crash_date < {_stamp(AS_OF)} THEN 'train' ELSE 'holdout' END AS part, count(*)::BIGINT AS n, sum(pedestrian_casualties)::BIGINT AS casualties FROM e WHERE crash_date < {_stamp(HOLD_END)} GROUP BY 1")
def b8_time_split(spark, d):
    part = fn.time_part(F.col("crash_date"), _ntz("1900-01-01 00:00:00"), _ntz(AS_OF), _ntz(HOLD_END))
    return events(spark, d).where(part.isNotNull()).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("pedestrian_casualties").alias("casualties"))


@query(f"WITH {CTE} SELECT unit_id, casualties_36mo = 0 AS zero_history, casualties_36mo FROM h WHERE casualties_36mo = 0")
def b10_zero_history(spark, d):
    from segrank.plans.sweep import zero_stratum

    return zero_stratum(history(spark, d)).select("unit_id", F.lit(True).alias("zero_history"), "casualties_36mo")


@query(f"WITH {CTE} SELECT coalesce(borough, '') AS borough, count(*)::BIGINT AS n, count(CASE WHEN borough IS NULL THEN 1 END)::BIGINT AS excluded FROM u GROUP BY 1")
def b11_null_stratum(spark, d):
    return rk.stratum_counts(units(spark, d))


@query("SELECT user_id, round(avg(CASE WHEN hour(ts) >= 18 OR hour(ts) < 6 THEN 1.0 ELSE 0.0 END), 6) AS night_share, round(avg(CASE WHEN isodow(ts) >= 6 THEN 1.0 ELSE 0.0 END), 6) AS weekend_share FROM events GROUP BY user_id")
def b12_night_weekend(spark, d):
    t = ft.temporal_shares(_table(spark, d, "events"), "ts", "user_id")
    return t.select("user_id", F.round("night_share", 6).alias("night_share"), F.round("weekend_share", 6).alias("weekend_share"))


@query(f"WITH {XY}, r AS (SELECT a.vec_id AS point_id, concat('I', lpad(b.vec_id::VARCHAR, 9, '0')) AS unit_id, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) AS dist FROM v a, v b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1) SELECT point_id, unit_id, round(dist, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist, unit_id) AS k FROM r WHERE dist <= {R}) WHERE k = 1")
def c1_nearest_within(spark, d):
    left = points(spark, d).where("vec_id % 2 = 0").withColumnRenamed("vec_id", "point_id")
    return geo.nearest_within(left, nodes(spark, d), R, "point_id", "unit_id").withColumn("distance", F.round("distance", 4))


_ASSIGN = f"""{XY}, {LINE}, ps AS (SELECT vec_id AS crash_id, x + 30 AS x, y - 20 AS y FROM v),
a1 AS (SELECT crash_id, min(struct_pack(d := dist, u := unit_id)) AS b FROM (SELECT crash_id, unit_id, sqrt(pow(ps.x-nd.x,2)+pow(ps.y-nd.y,2)) AS dist FROM ps, nd) WHERE dist <= 37 GROUP BY 1),
a2 AS (SELECT crash_id, min(struct_pack(d := dist, u := unit_id)) AS b FROM (SELECT crash_id, unit_id, {_ps('ps.x', 'ps.y', 'l.ax', 'l.ay', 'l.bx', 'l.by_')} AS dist FROM ps, l WHERE crash_id NOT IN (SELECT crash_id FROM a1)) WHERE dist <= 25 GROUP BY 1),
asg AS (SELECT crash_id, b.u AS unit_id, round(b.d, 4) AS distance, 'intersection' AS stage FROM a1 UNION ALL SELECT crash_id, b.u, round(b.d, 4), 'corridor' FROM a2)"""


def _universe(spark, d):
    return lines(spark, d).withColumn("unit_type", F.lit("corridor")).unionByName(nodes(spark, d).withColumn("unit_type", F.lit("intersection")))


def _assigned(spark, d):
    ps = points(spark, d).select(F.col("vec_id").alias("crash_id"), (F.col("x") + 30).alias("x"), (F.col("y") - 20).alias("y"))
    return ps, ev.assign(ps, _universe(spark, d), "crash_id", Radii(25.0, 37.0))


@query(f"WITH {_ASSIGN} SELECT * FROM asg")
def c2_two_stage_assign(spark, d):
    return _assigned(spark, d)[1].withColumn("distance", F.round("distance", 4))


@query(f"WITH {_ASSIGN} SELECT crash_id FROM ps WHERE crash_id NOT IN (SELECT crash_id FROM asg)")
def c3_unassigned_anti(spark, d):
    ps, found = _assigned(spark, d)
    return ps.join(found, "crash_id", "left_anti").select("crash_id")


_CROSS = "((l.bx-l.ax)*(k.ay-l.ay)-(l.by_-l.ay)*(k.ax-l.ax))*((l.bx-l.ax)*(k.by_-l.ay)-(l.by_-l.ay)*(k.bx-l.ax)) < 0 AND ((k.bx-k.ax)*(l.ay-k.ay)-(k.by_-k.ay)*(l.ax-k.ax))*((k.bx-k.ax)*(l.by_-k.ay)-(k.by_-k.ay)*(l.bx-k.ax)) < 0"
_LL = f"least({_ps('l.ax', 'l.ay', 'k.ax', 'k.ay', 'k.bx', 'k.by_')}, {_ps('l.bx', 'l.by_', 'k.ax', 'k.ay', 'k.bx', 'k.by_')}, {_ps('k.ax', 'k.ay', 'l.ax', 'l.ay', 'l.bx', 'l.by_')}, {_ps('k.bx', 'k.by_', 'l.ax', 'l.ay', 'l.bx', 'l.by_')})"
_LABEL = f"""{XY}, {LINE}, k AS (SELECT a.vec_id, a.x + 900 AS ax, a.y + 700 AS ay, b.x + 900 AS bx, b.y + 700 AS by_ FROM v a JOIN v b ON b.vec_id = a.vec_id + 1), q AS (SELECT vec_id, x + 23 AS x, y + 41 AS y FROM v),
lk AS (SELECT l.unit_id, k.vec_id FROM l, k WHERE ({_CROSS}) OR {_LL} <= 10), nk AS (SELECT nd.unit_id, k.vec_id FROM nd, k WHERE {_ps('nd.x', 'nd.y', 'k.ax', 'k.ay', 'k.bx', 'k.by_')} <= 10),
np AS (SELECT nd.unit_id, q.vec_id FROM nd, q WHERE sqrt(pow(nd.x-q.x,2)+pow(nd.y-q.y,2)) <= 10)"""


@query(f"""WITH {_LABEL}, f AS (SELECT unit_id, 'corridor' AS y FROM lk UNION SELECT unit_id, 'corridor' FROM nk UNION SELECT unit_id, 'intersection' FROM np),
uu AS (SELECT unit_id FROM l UNION ALL SELECT unit_id FROM nd)
SELECT unit_id, string_agg(y, '+' ORDER BY y) AS vzv_source, count(y) > 0 AS is_priority FROM uu LEFT JOIN f USING (unit_id) GROUP BY unit_id""")
def c4_buffer_labels(spark, d):
    return labels.labelled(_universe(spark, d), *_features(spark, d), 10.0).select("unit_id", "vzv_source", "is_priority")


def _features(spark, d):
    """Every segment and every point as a feature, moved aside so that none is a unit itself."""
    moved = F.transform("path", lambda p: F.struct((p["x"] + 900).alias("x"), (p["y"] + 700).alias("y")))
    return lines(spark, d, 1).select(F.col("vec_id").alias("feature_id"), moved.alias("path")), points(spark, d).select(F.col("vec_id").alias("feature_id"), F.array(F.struct((F.col("x") + 23).alias("x"), (F.col("y") + 41).alias("y"))).alias("path"))


@query(f"""WITH {_LABEL}, f AS (SELECT unit_id, vec_id FROM lk UNION ALL SELECT unit_id, vec_id FROM nk), uu AS (SELECT unit_id FROM l UNION ALL SELECT unit_id FROM nd),
g AS (SELECT unit_id, min(timestamp '2019-01-01' + to_days((vec_id * 37 % 1000)::INTEGER)) AS treatment_date FROM f WHERE vec_id % 3 <> 0 GROUP BY 1)
SELECT unit_id, treatment_date, treatment_date IS NOT NULL AS treated FROM uu LEFT JOIN g USING (unit_id)""")
def c5_earliest_treatment(spark, d):
    day = F.when(F.col("feature_id") % 3 != 0, F.date_add(F.lit("2019-01-01").cast("date"), (F.col("feature_id") * 37 % 1000).cast("int")).cast("string"))
    out, _ = labels.treatments(_universe(spark, d), [_features(spark, d)[0].withColumn("completion_date", day)], 10.0)
    return out.select("unit_id", "treatment_date", "treated")


@query(f"WITH {CTE} SELECT unit_id, casualties_36mo, holdout_casualties FROM h")
def c6_lookup_fill(spark, d):
    return history(spark, d).select("unit_id", "casualties_36mo", "holdout_casualties")


@query(f"WITH {CTE}, r2 AS (SELECT unit_id FROM s ORDER BY casualties_36mo DESC, tie LIMIT 100) SELECT unit_id, unit_id IN (SELECT unit_id FROM r2) AS chosen FROM s")
def c7_semi_flag(spark, d):
    h = history(spark, d)
    return sc.flagged(h, rk.top_n(h, "casualties_36mo", 100), "chosen").select("unit_id", "chosen")


@query(f"WITH {CTE}, r2 AS (SELECT unit_id FROM s ORDER BY casualties_36mo DESC, tie LIMIT 200) SELECT unit_id FROM r2 WHERE unit_id IN (SELECT unit_id FROM s WHERE is_priority)")
def c8_selection_subset(spark, d):
    h = history(spark, d)
    return rk.top_n(h, "casualties_36mo", 200).select("unit_id").join(h.where("is_priority").select("unit_id"), "unit_id", "left_semi")


@query(f"WITH {CTE} SELECT unit_id, {', '.join(f'casualties_{m}mo, crashes_{m}mo' for m in (12, 24, 36))} FROM h")
def d1_trailing_counts(spark, d):
    return history(spark, d).select("unit_id", *(c for m in (12, 24, 36) for c in (f"casualties_{m}mo", f"crashes_{m}mo")))


@query("SELECT m::INTEGER AS months, min(ts) > timestamp '2024-01-30' - to_months(m::INTEGER) AS truncated FROM events, range(0, 3) r(m) GROUP BY m")
def d2_truncation(spark, d):
    months = (0, 1, 2)
    begun = ft.truncated_windows(_table(spark, d, "events"), _ntz("2024-01-30 00:00:00"), months, "ts")
    return spark.createDataFrame([(m, m in begun) for m in months], "months int, truncated boolean")


@query("WITH m AS (SELECT user_id, event_type AS f FROM events UNION ALL SELECT user_id, json_extract_string(props, '$.k') FROM events) SELECT user_id, " + ", ".join(f"round(sum(CASE WHEN f = '{t}' THEN 1.0 ELSE 0.0 END) / count(f), 6) AS factor_{t}" for t in TYPES) + " FROM m WHERE f IS NOT NULL GROUP BY user_id")
def d4_factor_mix(spark, d):
    e = _table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    mix = ft.factor_mix(e, ["event_type", "k"], TYPES, "user_id")
    return mix.select("user_id", *(F.round(f"factor_{t}", 6).alias(f"factor_{t}") for t in TYPES))


_SEGS = "sg AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal, o_custkey % 40 AS a, o_orderkey % 37 AS b, o_orderpriority AS nm, CASE o_custkey % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' END AS borough, (o_custkey % 5)::DOUBLE AS sp, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 2.0 END AS lanes FROM orders), en AS (SELECT *, a AS gx, b AS gy FROM sg UNION ALL SELECT *, b + 40, a FROM sg)"


def _segments(spark, d):
    o = _table(spark, d, "orders")
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    a, b = F.col("o_custkey") % 40, F.col("o_orderkey") % 37
    src = o.select("o_orderkey", F.col("o_orderpriority").alias("full_street_name"), F.when(F.col("o_custkey") % 3 == 0, "X").when(F.col("o_custkey") % 3 == 1, "Y").alias("borough"), (F.col("o_custkey") % 5).alias("posted_speed"), F.when(F.col("o_orderkey") % 4 != 0, F.lit("2")).alias("number_travel_lanes"), F.array(F.array(pt(a, b), pt(b + 40, a))).alias("parts"))
    return un.segments(src, order="o_orderkey")


@query(f"WITH {_SEGS} SELECT gx::DOUBLE AS x, gy::DOUBLE AS y, count(*)::BIGINT AS leg_count FROM en GROUP BY gx, gy HAVING count(*) >= 2")
def d6_junctions(spark, d):
    return un.junctions(_segments(spark, d)).select(F.col("path")[0]["x"].alias("x"), F.col("path")[0]["y"].alias("y"), "leg_count")


@query(f"WITH {_SEGS}, g AS (SELECT gx, gy FROM en GROUP BY 1, 2 HAVING count(*) >= 2), c AS (SELECT gx, gy, borough, count(*) AS n FROM en WHERE borough IS NOT NULL GROUP BY ALL), b AS (SELECT gx, gy, borough FROM (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY n DESC, borough) AS k FROM c) WHERE k = 1) SELECT gx::DOUBLE AS x, gy::DOUBLE AS y, borough FROM g LEFT JOIN b USING (gx, gy)")
def d7_mode(spark, d):
    return un.junctions(_segments(spark, d)).select(F.col("path")[0]["x"].alias("x"), F.col("path")[0]["y"].alias("y"), "borough")


@query(f"WITH {_SEGS} SELECT gx::DOUBLE AS x, gy::DOUBLE AS y, array_to_string(list_sort(list_distinct(list(trim(nm))))[1:3], ' & ') AS full_street_name FROM en GROUP BY gx, gy HAVING count(*) >= 2")
def d8_names(spark, d):
    return un.junctions(_segments(spark, d)).select(F.col("path")[0]["x"].alias("x"), F.col("path")[0]["y"].alias("y"), "full_street_name")


@query(f"WITH {_SEGS} SELECT gx::DOUBLE AS x, gy::DOUBLE AS y, max(sp) AS posted_speed, coalesce(sum(lanes), 0)::DOUBLE AS number_travel_lanes FROM en GROUP BY gx, gy HAVING count(*) >= 2")
def d9_node_attrs(spark, d):
    return un.junctions(_segments(spark, d)).select(F.col("path")[0]["x"].alias("x"), F.col("path")[0]["y"].alias("y"), "posted_speed", "number_travel_lanes")


@query(f"WITH {_SEGS}, f AS (SELECT gx, gy, count(*) AS legs, min(ordinal * 2 + CASE WHEN gx >= 40 THEN 1 ELSE 0 END) AS first FROM en GROUP BY gx, gy HAVING count(*) >= 2) SELECT concat('I', (row_number() OVER (ORDER BY legs DESC, first) - 1)::VARCHAR) AS unit_id, gx::DOUBLE AS x, gy::DOUBLE AS y FROM f")
def i18_node_ids(spark, d):
    return un.junctions(_segments(spark, d)).select("unit_id", F.col("path")[0]["x"].alias("x"), F.col("path")[0]["y"].alias("y"))


@query(f"WITH {_SEGS} SELECT concat('C', ordinal::VARCHAR) AS unit_id, 'corridor' AS unit_type, round(sqrt(pow(b + 40 - a, 2) + pow(a - b, 2)), 4) AS length_ft FROM sg UNION ALL SELECT concat('I', (row_number() OVER (ORDER BY count(*) DESC, min(ordinal * 2 + CASE WHEN gx >= 40 THEN 1 ELSE 0 END)) - 1)::VARCHAR), 'intersection', NULL FROM en GROUP BY gx, gy HAVING count(*) >= 2")
def g1_union_units(spark, d):
    return un.union_units(_segments(spark, d)).select("unit_id", "unit_type", F.round("length_ft", 4).alias("length_ft"))


@query(f"WITH {CTE}, g AS (SELECT unit_type, median(posted_speed) AS m FROM u GROUP BY 1) SELECT unit_id, coalesce(posted_speed, m)::DOUBLE AS posted_speed, CASE WHEN posted_speed IS NULL THEN 1 ELSE 0 END AS road_attrs_imputed FROM u JOIN g USING (unit_type)")
def d12_impute_median(spark, d):
    return ft.impute_road_attributes(units(spark, d), ["posted_speed"]).select("unit_id", "posted_speed", "road_attrs_imputed")


@query(f"WITH {CTE} SELECT coalesce(borough, '?') AS borough, unit_type, count(*)::BIGINT AS n, sum(casualties_36mo)::BIGINT AS casualties FROM h GROUP BY 1, 2")
def d15_group_totals(spark, d):
    return rk.group_totals(history(spark, d), "casualties_36mo").withColumn("borough", F.coalesce("borough", F.lit("?")))


@query(f"WITH {CTE}, r2 AS (SELECT unit_id, borough FROM s ORDER BY eb_estimate DESC, tie LIMIT 300) SELECT borough, count(*)::BIGINT AS n FROM r2 WHERE borough IS NOT NULL GROUP BY 1")
def d14_selection_boroughs(spark, d):
    return rk.counts_by(rk.top_n(scored(spark, d), "eb_estimate", 300))


@query("SELECT l_orderkey, count(*)::BIGINT AS copies FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def d17_dup_keys(spark, d):
    return duplicate_keys(_table(spark, d, "lineitem"), "l_orderkey")


@query("SELECT round(quantile_cont(o_totalprice, 0.025), 4) AS low, round(quantile_cont(o_totalprice, 0.975), 4) AS high FROM orders")
def d18_percentile(spark, d):
    return sc.percentile_bounds(_table(spark, d, "orders"), "o_totalprice").select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query(f"WITH {_ASSIGN} SELECT count(*)::BIGINT AS total, count(a.crash_id)::BIGINT AS assigned, count(CASE WHEN stage = 'corridor' THEN 1 END)::BIGINT AS to_segments, (count(*) - count(a.crash_id))::BIGINT AS too_far FROM ps LEFT JOIN asg a USING (crash_id)")
def d20_balance(spark, d):
    ps, found = _assigned(spark, d)
    r = ev.assignment_report(ps.withColumn("drop_reason", F.lit(None).cast("string")), found, Radii(25.0, 37.0))
    return spark.createDataFrame([(r.total, r.assigned, r.to_segments, r.too_far)], "total long, assigned long, to_segments long, too_far long")


@query(f"WITH {CTE} SELECT min_by(unit_id, (eb_estimate, unit_id)) AS lowest, max_by(unit_id, (eb_estimate, unit_id)) AS highest, bool_and(eb_estimate >= 0) AS all_positive, round(max(abs(eb_estimate - casualties_36mo)), 6) AS most_moved FROM s")
def d21_extremes(spark, d):
    key = F.struct("eb_estimate", "unit_id")
    return scored(spark, d).agg(F.min_by("unit_id", key).alias("lowest"), F.max_by("unit_id", key).alias("highest"), F.bool_and(F.col("eb_estimate") >= 0).alias("all_positive"), F.round(F.max(F.abs(F.col("eb_estimate") - F.col("casualties_36mo"))), 6).alias("most_moved"))


@query(f"WITH {CTE}, {TREATED} SELECT count(*)::BIGINT AS units, count(CASE WHEN unit_type = 'corridor' THEN 1 END)::BIGINT AS corridors, count(CASE WHEN is_priority THEN 1 END)::BIGINT AS priority, count(CASE WHEN borough IS NULL THEN 1 END)::BIGINT AS no_borough, count(treatment_date)::BIGINT AS treated, count(CASE WHEN treatment_date < {_stamp('1997-01-01 00:00:00')} THEN 1 END)::BIGINT AS treated_before, count(CASE WHEN treatment_date >= {_stamp('1997-01-01 00:00:00')} THEN 1 END)::BIGINT AS treated_during, sum(holdout_casualties)::BIGINT AS holdout FROM s LEFT JOIN tr USING (unit_id)")
def d22_summary_counts(spark, d):
    from segrank.plans.run import summary_counts

    return summary_counts(history(spark, d).join(treated(spark, d).select("unit_id", "treated", "treatment_date"), "unit_id"), _ntz("1997-01-01 00:00:00"))


@query(f"WITH {CTE} SELECT unit_id, casualties_36mo, row_number() OVER (ORDER BY casualties_36mo DESC, tie)::BIGINT AS position FROM s")
def e1_ranked(spark, d):
    return rk.ranked(history(spark, d), "casualties_36mo").select("unit_id", "casualties_36mo", "position")


_STRAT = """z AS (SELECT *, row_number() OVER q AS position, sum(casualties_36mo) OVER (q ROWS UNBOUNDED PRECEDING)::BIGINT AS cumulative, sum(casualties_36mo) OVER (PARTITION BY borough, unit_type)::BIGINT AS total
 FROM (SELECT *, {score} AS sc FROM s WHERE borough IS NOT NULL) WINDOW q AS (PARTITION BY borough, unit_type ORDER BY sc DESC, tie)),
y AS (SELECT *, min(CASE WHEN cumulative::DOUBLE / total >= CASE WHEN unit_type = 'corridor' THEN 0.5 ELSE 0.15 END THEN position END) OVER (PARTITION BY borough, unit_type) AS stop FROM z WHERE total > 0),
pick AS (SELECT * FROM y WHERE position <= coalesce(stop, position))"""


@query(f"WITH {CTE}, {_STRAT.format(score='casualties_36mo')} SELECT borough, unit_type, unit_id, round(cumulative::DOUBLE / total, 6) AS cum_share FROM pick")
def e2_cumshare(spark, d):
    return rk.stratified(history(spark, d), "casualties_36mo", "casualties_36mo").select("borough", "unit_type", "unit_id", F.round(F.col("cumulative") / F.col("total"), 6).alias("cum_share"))


@query(f"WITH {CTE}, {_STRAT.format(score='eb_estimate')} SELECT borough, unit_type, unit_id, position::BIGINT AS position FROM pick")
def e3_stratified(spark, d):
    return rk.stratified(scored(spark, d), "eb_estimate", "casualties_36mo").select("borough", "unit_type", "unit_id", F.col("position").cast("bigint").alias("position"))


@query(f"WITH {CTE} SELECT unit_id, round((rank() OVER (PARTITION BY unit_type ORDER BY casualties_36mo) + (count(*) OVER (PARTITION BY unit_type, casualties_36mo) - 1) / 2.0) / count(*) OVER (PARTITION BY unit_type), 6)::DOUBLE AS pct_rank FROM s")
def e4_pct_rank(spark, d):
    return rk.pct_rank(history(spark, d), "casualties_36mo", "unit_type").select("unit_id", F.round(F.col("pct_rank").cast("double"), 6).alias("pct_rank"))


@query(f"WITH {CTE}, c AS (SELECT min(casualties_36mo) AS cut FROM (SELECT casualties_36mo FROM s ORDER BY 1 DESC LIMIT 400)) SELECT count(CASE WHEN casualties_36mo = cut THEN 1 END)::BIGINT AS tied, (400 - count(CASE WHEN casualties_36mo > cut THEN 1 END))::BIGINT AS by_tiebreak FROM s, c HAVING count(*) > 400")
def e7_tie_block(spark, d):
    return rk.tie_block(history(spark, d), "casualties_36mo", 400)


@query(f"WITH {CTE} SELECT unit_id, casualties_36mo FROM s ORDER BY casualties_36mo DESC, tie LIMIT 300")
def f1_top_n_count(spark, d):
    return rk.top_n(history(spark, d), "casualties_36mo", 300).select("unit_id", "casualties_36mo")


@query(f"WITH {CTE} SELECT unit_id, round(eb_estimate, 6) AS eb_estimate FROM s ORDER BY s.eb_estimate DESC, tie LIMIT 300")
def f1_top_n_eb(spark, d):
    return rk.top_n(scored(spark, d), "eb_estimate", 300).select("unit_id", F.round("eb_estimate", 6).alias("eb_estimate"))


@query(f"WITH {CTE} SELECT unit_id, unit_type, borough, casualties_36mo, holdout_casualties FROM s ORDER BY eb_estimate DESC, tie LIMIT 50")
def f2_top50(spark, d):
    return rk.top_n(scored(spark, d), "eb_estimate", 50).select("unit_id", "unit_type", "borough", "casualties_36mo", "holdout_casualties")


@query(f"WITH {CTE}, r AS (SELECT *, row_number() OVER (ORDER BY casualties_36mo DESC, tie) AS k FROM s), z(n) AS (VALUES {', '.join(f'({n})' for n in SIZES)}) SELECT z.n::BIGINT AS n, sum(CASE WHEN k <= z.n THEN holdout_casualties ELSE 0 END)::BIGINT AS captured, sum(holdout_casualties)::BIGINT AS total FROM r, z GROUP BY 1")
def f6_n_sweep(spark, d):
    h = history(spark, d)
    top = rk.n_sweep(h, "casualties_36mo", "holdout_casualties", SIZES)
    return top


@query(f"WITH {_LABEL} SELECT 'corridor' AS layer, vec_id AS feature_id FROM k WHERE vec_id NOT IN (SELECT vec_id FROM lk) AND vec_id NOT IN (SELECT vec_id FROM nk) UNION ALL SELECT 'intersection', vec_id FROM q WHERE vec_id NOT IN (SELECT vec_id FROM np)")
def g3_unmatched(spark, d):
    return labels.unmatched(_universe(spark, d), *_features(spark, d), 10.0)


@query("SELECT DISTINCT regexp_replace(regexp_replace(lower(p_type || '/' || p_brand), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS slug FROM part")
def h3_slug(spark, d):
    return _table(spark, d, "part").select(fn.slug(F.concat("p_type", F.lit("/"), "p_brand")).alias("slug")).distinct()


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0)::BIGINT AS half FROM lineitem")
def h5_round_half_even(spark, d):
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.half_even(F.col("l_quantity") / 2).alias("half"))


@query("SELECT o_orderkey, date_trunc('second', o_orderdate - INTERVAL 1 MONTH) AS before FROM orders")
def h10_month_arithmetic(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", F.date_trunc("second", fn.months_before(F.col("o_orderdate"), 1)).cast("timestamp_ntz").alias("before"))


@query(f"WITH {CTE} SELECT unit_id, md5(unit_id) AS tie FROM u")
def h11_tiebreak_md5(spark, d):
    return rk.with_tiebreak(units(spark, d).select("unit_id"))


@query()
def h11_tiebreak_blake2b(spark, d):
    return units(spark, d).select("unit_id", F.hex(fn.tiebreak("unit_id", "blake2b")).alias("tie"))


@query(f"WITH {XY}, {ALL_LINES} SELECT unit_id, round(sqrt(pow(bx-ax,2)+pow(by_-ay,2)), 4) AS length FROM l")
def h15_length(spark, d):
    return lines(spark, d, 1).select("unit_id", F.round(geo.path_length("path"), 4).alias("length"))


def _reproject_sql() -> str:
    a, e, n, big, rho0, l0 = geo._lambert()
    lon, lat = "(-74.0 + (vec_id % 100) / 500.0)", "(40.5 + (vec_id % 77) / 200.0)"
    t = f"tan({geo.math.pi / 4!r} - radians({lat})/2) / pow((1 - {e!r}*sin(radians({lat}))) / (1 + {e!r}*sin(radians({lat}))), {e / 2!r})"
    rho, th = f"({a * big!r} * pow({t}, {n!r}))", f"({n!r} * (radians({lon}) - {l0!r}))"
    return f"SELECT vec_id, round((300000.0 + {rho}*sin({th})) * 3937 / 1200, 2) AS x, round(({rho0!r} - {rho}*cos({th})) * 3937 / 1200, 2) AS y FROM embeddings"


@query(_reproject_sql())
def h16_reproject(spark, d):
    x, y = geo.reproject(-74.0 + (F.col("vec_id") % 100) / 500.0, 40.5 + (F.col("vec_id") % 77) / 200.0)
    return _table(spark, d, "embeddings").select("vec_id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 3) AS x, round(embedding[2]::DOUBLE, 3) AS y FROM embeddings")
def h21_wkt_geojson(spark, d):
    js = F.concat(F.lit('{"type":"Point","coordinates":['), F.round(F.col("embedding")[0].cast("double"), 3).cast("string"), F.lit(","), F.round(F.col("embedding")[1].cast("double"), 3).cast("string"), F.lit("]}"))
    p = geo.parse_wkt(geo.geojson_to_wkt(js))[0][0]
    return _table(spark, d, "embeddings").select("vec_id", p["x"].alias("x"), p["y"].alias("y"))


@query(f"WITH {CTE} SELECT unit_id, exposure, exposure_valid, CASE WHEN exposure_valid THEN round(ln(exposure), 6) END AS log_exposure FROM p")
def i1_exposure(spark, d):
    return ft.exposure(units(spark, d)).select("unit_id", "exposure", "exposure_valid", F.round("log_exposure", 6).alias("log_exposure"))


@query(f"""WITH {CTE}, c AS (SELECT unit_id, unit_type, posted_speed::DOUBLE AS a, length_ft AS b FROM u), g AS (SELECT unit_type, median(a) AS a, median(b) AS b FROM c GROUP BY 1), a AS (SELECT median(a) AS a, median(b) AS b FROM c)
SELECT unit_id, coalesce(c.a, g.a, a.a)::DOUBLE AS posted_speed, round(coalesce(c.b, g.b, a.b), 6)::DOUBLE AS length_ft, CASE WHEN c.a IS NULL OR c.b IS NULL THEN 1 ELSE 0 END AS road_attrs_imputed FROM c JOIN g USING (unit_type), a""")
def i2_impute(spark, d):
    out = ft.impute_road_attributes(units(spark, d), ["posted_speed", "length_ft"])  # no junction has a length: the median of all
    return out.select("unit_id", "posted_speed", F.round("length_ft", 6).alias("length_ft"), "road_attrs_imputed")


@query(f"WITH {CTE} SELECT unit_id, round(eb_estimate, 6) AS eb_estimate FROM s")
def i10_empirical_bayes(spark, d):
    return scored(spark, d).select("unit_id", F.round("eb_estimate", 6).alias("eb_estimate"))


_TREATED_SQL = f"{CTE}, {TREATED}, st AS (SELECT s.*, treatment_date, treatment_date IS NOT NULL AS treated FROM s LEFT JOIN tr USING (unit_id))"


@query(f"WITH {CTE}, {_STRAT.format(score='eb_estimate')} SELECT sum(CASE WHEN unit_id IN (SELECT unit_id FROM pick) THEN holdout_casualties ELSE 0 END)::BIGINT AS captured, sum(holdout_casualties)::BIGINT AS total, (SELECT count(*) FROM pick)::BIGINT AS units, round(sum(CASE WHEN unit_id IN (SELECT unit_id FROM pick) THEN holdout_casualties ELSE 0 END)::DOUBLE / sum(holdout_casualties), 6) AS rate FROM s")
def i12_regime_a(spark, d):
    s = scored(spark, d)
    return sc.capture(s, rk.stratified(s, "eb_estimate", "casualties_36mo")).withColumn("rate", F.round("rate", 6))


def _pick(name: str, score: str) -> str:
    return f"{name} AS (SELECT unit_id FROM (SELECT *, row_number() OVER (ORDER BY {score} DESC, tie) AS k FROM s) WHERE k <= (SELECT n FROM n))"


@query(f"WITH {CTE}, {_pick('a', 'casualties_36mo')} SELECT sum(CASE WHEN unit_id IN (SELECT unit_id FROM a) THEN holdout_casualties ELSE 0 END)::BIGINT AS captured, sum(holdout_casualties)::BIGINT AS total, (SELECT n FROM n)::BIGINT AS units, round(sum(CASE WHEN unit_id IN (SELECT unit_id FROM a) THEN holdout_casualties ELSE 0 END)::DOUBLE / sum(holdout_casualties), 6) AS rate FROM s")
def i13_capture(spark, d):
    h = history(spark, d)
    return sc.capture(h, rk.top_n(h, "casualties_36mo", h.where("is_priority").count())).withColumn("rate", F.round("rate", 6))


#: Resamples by MD5 weights, which SQL can repeat; the intervals of runs draw BOOTSTRAP_ITERATIONS by class.
DRAWS = 1000
_POISSON = "CASE " + " ".join(f"WHEN un < {c!r} THEN {i}" for i, c in enumerate(sc.POISSON_CDF)) + f" ELSE {len(sc.POISSON_CDF)} END"


@query(f"""WITH {CTE}, {_pick('a', 'eb_estimate')}, {_pick('b', 'casualties_36mo')},
z AS (SELECT unit_id, holdout_casualties AS v, (CASE WHEN unit_id IN (SELECT unit_id FROM a) THEN 1 ELSE 0 END) - (CASE WHEN unit_id IN (SELECT unit_id FROM b) THEN 1 ELSE 0 END) AS d FROM s WHERE holdout_casualties > 0),
y AS (SELECT *, ('0x' || substr(md5(unit_id || ':' || draw::VARCHAR), 1, 8))::BIGINT / 4294967296.0 AS un FROM z, range(1, {DRAWS + 1}) r(draw)), k AS (SELECT *, {_POISSON} AS k FROM y)
SELECT draw::INTEGER AS draw, sum(k * v)::BIGINT AS whole, sum(k * v * d)::BIGINT AS diff FROM k WHERE k > 0 GROUP BY draw""")
def i14_poisson_bootstrap(spark, d):
    s = stored(rk.with_tiebreak(scored(spark, d)), "scored")
    n = s.where("is_priority").count()
    both = sc.flagged(sc.flagged(s, rk.top_n(s, "eb_estimate", n), "_a"), rk.top_n(s, "casualties_36mo", n), "_b")
    return sc.poisson_draws(both, "holdout_casualties", DRAWS)


@query()
def i14_bootstrap_numpy(spark, d):
    s = stored(rk.with_tiebreak(scored(spark, d)), "scored")
    n = s.where("is_priority").count()
    ci = sc.bootstrap_gather(s, rk.top_n(s, "eb_estimate", n), rk.top_n(s, "casualties_36mo", n))
    return spark.range(1).select(F.lit(ci.point).alias("point"), F.lit(ci.low).alias("low"), F.lit(ci.high).alias("high"), F.lit(ci.iterations).alias("iterations"))


@query()
def i14_bootstrap_classes(spark, d):
    s = stored(rk.with_tiebreak(scored(spark, d)), "scored")
    n = s.where("is_priority").count()
    ci = sc.bootstrap_difference(s, rk.top_n(s, "eb_estimate", n), rk.top_n(s, "casualties_36mo", n))
    return spark.range(1).select(F.lit(ci.point).alias("point"), F.lit(ci.low).alias("low"), F.lit(ci.high).alias("high"), F.lit(ci.iterations).alias("iterations"))


_DRAWN = f"""{_pick('a', 'eb_estimate')}, {_pick('b', 'casualties_36mo')},
z AS (SELECT unit_id, holdout_casualties AS v, (CASE WHEN unit_id IN (SELECT unit_id FROM a) THEN 1 ELSE 0 END) - (CASE WHEN unit_id IN (SELECT unit_id FROM b) THEN 1 ELSE 0 END) AS d FROM s WHERE holdout_casualties > 0),
y AS (SELECT *, ('0x' || substr(md5(unit_id || ':' || draw::VARCHAR), 1, 8))::BIGINT / 4294967296.0 AS un FROM z, range(1, {DRAWS + 1}) r(draw)), k AS (SELECT *, {_POISSON} AS k FROM y),
dr AS (SELECT 100.0::DOUBLE * sum(k * v * d) / sum(k * v) AS r FROM k WHERE k > 0 GROUP BY draw), ci AS (SELECT quantile_cont(r, 0.025) AS low, quantile_cont(r, 0.975) AS high FROM dr)"""


@query(f"WITH {CTE}, {_DRAWN}, r AS (SELECT 100.0 * sum(CASE WHEN unit_id IN (SELECT unit_id FROM a) THEN holdout_casualties ELSE 0 END) / sum(holdout_casualties) AS eb, 100.0 * sum(CASE WHEN unit_id IN (SELECT unit_id FROM b) THEN holdout_casualties ELSE 0 END) / sum(holdout_casualties) AS naive FROM s) SELECT round(eb::DOUBLE, 6) AS eb, round(naive::DOUBLE, 6) AS naive, round((eb - naive)::DOUBLE, 6) AS lift, round(low, 6) AS low, round(high, 6) AS high, (eb - naive) >= 5.0 AND (low > 0 OR high < 0) AS clears FROM r, ci")
def i15_verdict(spark, d):
    s = stored(rk.with_tiebreak(scored(spark, d)), "scored")
    n = s.where("is_priority").count()
    picks = {c: rk.top_n(s, c, n) for c in ("eb_estimate", "casualties_36mo")}
    a, b = (100 * sc.capture_rate(s, p).rate for p in picks.values())
    ci = sc.poisson_interval(sc.flagged(sc.flagged(s, picks["eb_estimate"], "_a"), picks["casualties_36mo"], "_b"), "holdout_casualties", DRAWS)
    v = sc.preregistered_bar(a, b, ci.low, ci.high)
    return spark.createDataFrame([(round(a, 6), round(b, 6), round(v.lift, 6), round(ci.low, 6), round(ci.high, 6), v.clears)], "eb double, naive double, lift double, low double, high double, clears boolean")


@query(f"WITH {_TREATED_SQL}, g AS (SELECT CASE WHEN NOT treated THEN 'untreated' WHEN treatment_date < {_stamp('1997-01-01 00:00:00')} THEN 'before' ELSE 'during' END AS bucket, is_priority, holdout_casualties FROM st), f(bucket) AS (VALUES ('before'), ('during'), ('undated'), ('untreated')) SELECT f.bucket, coalesce(sum(CASE WHEN is_priority THEN holdout_casualties ELSE 0 END), 0)::BIGINT AS captured, coalesce(sum(holdout_casualties), 0)::BIGINT AS total, round(CASE WHEN sum(holdout_casualties) > 0 THEN sum(CASE WHEN is_priority THEN holdout_casualties ELSE 0 END)::DOUBLE / sum(holdout_casualties) END, 6) AS rate FROM f LEFT JOIN g USING (bucket) GROUP BY 1")
def i16_treatment_split(spark, d):
    u = treated(spark, d).select("unit_id", "treated", "treatment_date")
    h = history(spark, d).join(u, "unit_id")
    return sc.split_by_treatment(h, h.where("is_priority").select("unit_id"), holdout_start=_ntz("1997-01-01 00:00:00")).withColumn("rate", F.round("rate", 6))


@query(f"WITH {CTE} SELECT CASE WHEN coalesce(trim(rw_type), '') <> '1' THEN 1 ELSE 0 END AS is_highway, count(*)::BIGINT AS units, sum(casualties_36mo)::BIGINT AS observed, round(sum(spf_prediction), 4) AS predicted, round(sum(casualties_36mo) / sum(spf_prediction), 4) AS ratio FROM s WHERE spf_prediction IS NOT NULL GROUP BY 1")
def i27_calibration(spark, d):
    s = scored(spark, d).withColumn("is_highway", (F.coalesce(F.trim("rw_type"), F.lit("")) != "1").cast("int"))
    return md.calibration(s).withColumns({"predicted": F.round("predicted", 4), "ratio": F.round("ratio", 4)})


@query("SELECT user_id, time_bucket(INTERVAL '5 days', ts, timestamp '2024-01-01') AS \"start\", time_bucket(INTERVAL '5 days', ts, timestamp '2024-01-01') + INTERVAL '5 days' AS \"end\", count(*)::BIGINT AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def j_windowed_counts(spark, d):
    from segrank.streaming.trailing import windowed_counts

    e = _table(spark, d, "events").withColumn("ts", F.col("ts") - F.expr("INTERVAL '3' DAY"))  # windows count from 1970-01-01
    out = windowed_counts(e, "ts", "user_id", "value", "5 days")
    shift = lambda c: (F.col(c) + F.expr("INTERVAL '3' DAY")).cast("timestamp_ntz")
    return out.select("user_id", shift("start").alias("start"), shift("end").alias("end"), "events", F.round("total", 4).alias("total"))


MODEL_PREDICTORS = list(PREDICTORS)


def _model_frame(spark, d):
    h = ft.exposure(treated(spark, d).select("unit_id", "treated", "treatment_date").join(history(spark, d), "unit_id"))
    return ft.impute_road_attributes(h, list(ROAD_ATTRIBUTES)).withColumn("is_highway", un.is_highway())


@query()
def i7_poisson_glm(spark, d):
    f = _model_frame(spark, d).where("unit_type = 'corridor'")
    b0, b = md.poisson_glm(f, "crashes_36mo", MODEL_PREDICTORS)
    return spark.range(1).select(F.round(F.lit(b0), 6).alias("intercept"), *(F.round(F.lit(x), 8).alias(c) for c, x in zip(MODEL_PREDICTORS, b, strict=True)))


@query()
def i8_nb2_fit(spark, d):
    frame = _model_frame(spark, d)
    fits = [md.fit_nb(frame.where(F.col("unit_type") == t), "casualties_36mo", MODEL_PREDICTORS, t) for t in K]
    return spark.createDataFrame([(f.unit_type, f.n, round(f.intercept, 6), round(f.dispersion, 6), *(round(f.coefficients[c], 8) for c in MODEL_PREDICTORS)) for f in fits], ["unit_type", "n", "intercept", "dispersion", *MODEL_PREDICTORS])


@query()
def i11_fit_and_blend(spark, d):
    return md.fit_and_blend(_model_frame(spark, d), predictors=MODEL_PREDICTORS)[0].select("unit_id", "unit_type", "casualties_36mo", "spf_prediction", "eb_estimate")


#: Events at points, beside the units: one a day and place by vec_id, three years to train and two to hold out.
SWEEP_EVENTS = {"crash_id": "vec_id", "x": "x + 30", "y": "y - 20", "casualties": "CASE WHEN vec_id % 4 = 0 THEN vec_id % 7 ELSE vec_id % 2 END", "late": "vec_id * 37 % 1825 >= 1095"}


def _sweep_sql(i: int, r: Radii) -> str:
    """The run of one setting: two-stage assignment, labels by buffer, blend at fixed dispersions, three selections of one size."""
    return f"""n{i}a AS (SELECT crash_id, min(struct_pack(d := dist, u := unit_id)) AS b FROM nn WHERE dist <= {r.node_ft} GROUP BY 1),
n{i}b AS (SELECT crash_id, min(struct_pack(d := dist, u := unit_id)) AS b FROM ll WHERE dist <= {r.join_ft} AND crash_id NOT IN (SELECT crash_id FROM n{i}a) GROUP BY 1),
n{i}e AS (SELECT b.u AS unit_id, casualties, late FROM (SELECT * FROM n{i}a UNION ALL SELECT * FROM n{i}b) JOIN pe USING (crash_id)),
n{i}p AS (SELECT unit_id FROM lf WHERE dist <= {r.label_ft} UNION SELECT unit_id FROM nf WHERE dist <= {r.label_ft}),
n{i}u AS (SELECT unit_id, unit_type, exposure, coalesce(sum(CASE WHEN NOT late THEN casualties END), 0)::BIGINT AS past, coalesce(sum(CASE WHEN late THEN casualties END), 0)::BIGINT AS hold FROM uu LEFT JOIN n{i}e USING (unit_id) GROUP BY ALL),
n{i}w AS (SELECT *, unit_id IN (SELECT unit_id FROM n{i}p) AS r1, md5(unit_id) AS tie, 1 / (1 + CASE WHEN unit_type = 'corridor' THEN {K['corridor']}::DOUBLE ELSE {K['intersection']}::DOUBLE END * exposure) AS w FROM n{i}u),
n{i}s AS (SELECT *, round(w * exposure + (1 - w) * past, 9) AS eb FROM n{i}w),
n{i}r AS (SELECT *, row_number() OVER (ORDER BY past DESC, tie) AS k2, row_number() OVER (ORDER BY eb DESC, tie) AS k3, (SELECT count(*) FROM n{i}s WHERE r1) AS n FROM n{i}s),
n{i} AS (SELECT '{r.tag}' AS tag, max(n)::BIGINT AS n, sum(hold)::BIGINT AS holdout, round(100.0 * sum(CASE WHEN r1 THEN hold ELSE 0 END) / sum(hold), 6)::DOUBLE AS r1, round(100.0 * sum(CASE WHEN k2 <= n THEN hold ELSE 0 END) / sum(hold), 6)::DOUBLE AS r2, round(100.0 * sum(CASE WHEN k3 <= n THEN hold ELSE 0 END) / sum(hold), 6)::DOUBLE AS r3 FROM n{i}r)"""


def _sweep_oracle() -> str:
    from segrank.plans.sweep import settings

    runs = {r.tag: r for _, r in settings()}
    shifted = {"x": "x + 900", "y": "y + 700"}
    k = ", ".join(f"a.{c} + {900 if c == 'x' else 700} AS a{c}, b.{c} + {900 if c == 'x' else 700} AS b{'y_' if c == 'y' else c}" for c in shifted)
    rows = " UNION ALL ".join(f"SELECT '{knob}' AS knob, {r.as_dict()[knob]}::DOUBLE AS value, * FROM n{list(runs).index(r.tag)}" for knob, r in settings())
    return f"""WITH {XY}, {LINE}, k AS (SELECT a.vec_id, {k} FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 WHERE a.y < -400), q AS (SELECT vec_id, x + 23 AS x, y + 41 AS y FROM v WHERE y < -400),
pe AS (SELECT {_cols(SWEEP_EVENTS)} FROM v), uu AS (SELECT unit_id, 'corridor' AS unit_type, greatest(sqrt(pow(bx-ax,2)+pow(by_-ay,2)) / 1000, 1e-9) AS exposure FROM l UNION ALL SELECT unit_id, 'intersection', 1.0 FROM nd),
nn AS (SELECT crash_id, unit_id, sqrt(pow(pe.x-nd.x,2)+pow(pe.y-nd.y,2)) AS dist FROM pe, nd), ll AS (SELECT crash_id, unit_id, {_ps('pe.x', 'pe.y', 'l.ax', 'l.ay', 'l.bx', 'l.by_')} AS dist FROM pe, l),
lf AS (SELECT unit_id, min(CASE WHEN {_CROSS} THEN 0.0 ELSE {_LL} END) AS dist FROM l, k GROUP BY 1 UNION ALL SELECT nd.unit_id, min({_ps('nd.x', 'nd.y', 'k.ax', 'k.ay', 'k.bx', 'k.by_')}) FROM nd, k GROUP BY 1),
nf AS (SELECT nd.unit_id, min(sqrt(pow(nd.x-q.x,2)+pow(nd.y-q.y,2))) AS dist FROM nd, q GROUP BY 1),
{", ".join(_sweep_sql(i, r) for i, r in enumerate(runs.values()))}
SELECT *, round(r3 - r2, 6) AS lift FROM ({rows})"""


def _sweep_units(labelled, at, nearest, radii):
    """Units of one setting, labelled already: events assigned, casualties before and after, and the blend."""
    found = ev.claims(*nearest, "crash_id", radii).join(at.select("crash_id", "casualties", "late"), "crash_id")
    sums = found.groupBy("unit_id").agg(*(F.coalesce(F.sum(F.when(c, F.col("casualties"))), F.lit(0)).cast("bigint").alias(n) for n, c in (("casualties_36mo", ~F.col("late")), ("holdout_casualties", F.col("late")))))
    units_ = ft.fill_join(labelled, sums)
    units_ = units_.withColumn("spf_prediction", F.when(F.col("unit_type") == "corridor", F.greatest(geo.path_length("path") / 1000, F.lit(1e-9))).otherwise(1.0))
    blend = F.when(F.col("unit_type") == "corridor", md.empirical_bayes("spf_prediction", "casualties_36mo", K["corridor"])).otherwise(md.empirical_bayes("spf_prediction", "casualties_36mo", K["intersection"]))
    extra = {"borough": F.lit("TOWN"), "treated": F.lit(False), "treatment_date": F.lit(None).cast("timestamp_ntz"), "eb_estimate": F.round(blend, 9)}
    return units_.withColumns(extra).drop("path")


@query(_sweep_oracle())
def i24_sensitivity(spark, d):
    """Every setting assigns, labels, blends and evaluates by its own radii; interval ends are random and so not among the columns.

    The nearest units are searched once within the widest radii, as in the SQL: who is nearest within a radius is who is nearest at all, if near enough.
    """
    from segrank.plans.run import judge
    from segrank.plans.sweep import settings, sweep

    universe = stored(_universe(spark, d), "universe")
    at = stored(points(spark, d).selectExpr(*(f"{e} AS {c}" for c, e in SWEEP_EVENTS.items())), "events")
    # the published list covers one part of the town
    layers = [stored(df.where(F.element_at("path", 1)["y"] - dy < -400), "layer") for df, dy in zip(_features(spark, d), (700, 41), strict=True)]
    runs = settings()
    widest = Radii(*(max(getattr(r, c) for _, r in runs) for c in ("join_ft", "node_ft", "label_ft")))
    nearest = [stored(geo.nearest_within(at, universe.where(F.col("unit_type") == t), r, "crash_id", "unit_id"), "nearest") for t, r in (("intersection", widest.node_ft), ("corridor", widest.join_ft))]
    labelled = {r: stored(labels.labelled(universe, *layers, r), "labelled") for r in sorted({r.label_ft for _, r in runs})}

    def one(radii):
        scored_, summary = judge(_sweep_units(labelled[radii.label_ft], at, nearest, radii), K, brief=True)
        discard(scored_)
        return summary

    rows = sweep(one, runs)
    keep = lambda r: (r["knob"], r["value"], r["tag"], r["n"], r["holdout"], *(round(r[c], 6) for c in ("r1", "r2", "r3")), round(round(r["r3"], 6) - round(r["r2"], 6), 6))
    return spark.createDataFrame([keep(r) for r in rows], "knob string, value double, tag string, n long, holdout long, r1 double, r2 double, r3 double, lift double")


@query()
def i25_zero_history(spark, d):
    from segrank.plans.sweep import zero_history

    rows = zero_history(scored(spark, d), K, ZERO_BUDGETS, ZERO_DRAWS)
    return spark.createDataFrame([{k: v for k, v in r.items() if k != "ceiling"} for r in rows])


@query()
def i23_audit(spark, d):
    from segrank.plans.audit import rederive
    from segrank.plans.run import evaluate

    frame, summary = evaluate(_model_frame(spark, d), MODEL_PREDICTORS, holdout_start="1997-01-01 00:00:00")
    return spark.createDataFrame([(c.label, c.published if c.published is None else float(c.published), c.rederived if c.rederived is None else float(c.rederived), c.agrees) for c in rederive(frame, summary, BOOTSTRAP_ITERATIONS)], "label string, published double, rederived double, agrees boolean")


@query()
def flagship_backtest(spark, d):
    from segrank.plans.run import evaluate

    _, s = evaluate(_model_frame(spark, d), MODEL_PREDICTORS, holdout_start="1997-01-01 00:00:00")
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in s["rates"].items()], "ranking string, capture_pct double")


@query(f"WITH {CTE}, {_pick('a', 'casualties_36mo')}, {_pick('b', 'eb_estimate')} SELECT k AS ranking, sum(CASE WHEN chosen THEN holdout_casualties ELSE 0 END)::BIGINT AS captured, sum(holdout_casualties)::BIGINT AS total FROM (SELECT 'r1' AS k, is_priority AS chosen, holdout_casualties FROM s UNION ALL SELECT 'r2', unit_id IN (SELECT unit_id FROM a), holdout_casualties FROM s UNION ALL SELECT 'r3', unit_id IN (SELECT unit_id FROM b), holdout_casualties FROM s) GROUP BY 1")
def flagship_fixed_k(spark, d):
    s = stored(rk.with_tiebreak(scored(spark, d)), "scored")
    n = s.where("is_priority").count()
    picks = {"r1": s.where("is_priority"), "r2": rk.top_n(s, "casualties_36mo", n), "r3": rk.top_n(s, "eb_estimate", n)}
    out = None
    for k, sel in picks.items():
        row = sc.capture(s, sel).select(F.lit(k).alias("ranking"), "captured", "total")
        out = row if out is None else out.unionByName(row)
    return out
