"""Known answers of the screening operators."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from segrank.config import DEFAULT_RADII, Radii
from segrank.functions import guards as g
from segrank.functions import scalars as fn
from segrank.operators import events as ev
from segrank.operators import features as ft
from segrank.operators import geo, labels
from segrank.operators import model as md
from segrank.operators import rank as rk
from segrank.operators import score as sc
from segrank.operators import universe as un
from segrank.plans import audit, sweep
from segrank.sources import paged_api, sinks, snapshots

LON, LAT = (-73.980, -73.979, -73.978), (40.750, 40.751, 40.752)


def line(*points):
    return "LINESTRING (" + ", ".join(f"{x} {y}" for x, y in points) + ")"


@pytest.fixture(scope="module")
def city(spark):
    """Three by three junctions and the twelve segments between them."""
    rows = [(line((a, y), (b, y)),) for y in LAT for a, b in zip(LON, LON[1:])] + [(line((x, a), (x, b)),) for x in LON for a, b in zip(LAT, LAT[1:])]
    df = spark.createDataFrame([(i, w, "1", f"street {i % 3}", "1", "25") for i, (w,) in enumerate(rows)], "row_no long, wkt string, boroughcode string, full_street_name string, rw_type string, posted_speed string")
    df = un.borough_names(g.with_srid(df.withColumn("parts", geo.parse_wkt("wkt")), "parts", 4326))
    df = g.with_srid(df.withColumn("parts", F.transform("parts", geo.project_path)), "parts", 2263)
    return un.build_universe(df).persist()


def feet(x, y):
    return F.array(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")))


def test_universe(city):
    assert city.where("unit_type = 'corridor'").count() == 12
    assert sorted(r[0] for r in city.where("unit_type = 'intersection'").select("leg_count").collect()) == [2, 2, 2, 2, 3, 3, 3, 3, 4]
    assert city.where("borough is null").count() == 0 and all(100 < r[0] < 1000 for r in city.where("unit_type = 'corridor'").select("length_ft").collect())
    assert city.where("unit_id = 'I0'").first()["leg_count"] == 4


def test_reproject(spark):
    x, y = spark.range(1).select(*geo.reproject(F.lit(-73.98), F.lit(40.75))).first()
    assert abs(x - 989791) < 1 and abs(y - 212523) < 1
    assert spark.range(1).select(geo.reproject(F.lit(0.0), F.lit(95.0))[0]).first()[0] is None


def test_crs_guards(spark, city):
    with pytest.raises(g.CRSError):
        un.build_universe(spark.createDataFrame([(1, [[(0.0, 0.0)]])], "row_no long, parts array<array<struct<x:double,y:double>>>"))
    with pytest.raises(g.CRSError):
        geo.project(city, "path")


def test_assignment_balances(spark, city):
    rows = [(-73.9795, 40.75, "2022-03-01T08:00:00.000", 0, 2), (-73.9790, 40.7510, "2022-06-15T19:30:00.000", 1, 0), (-73.9785, 40.752, "2023-01-20T23:15:00.000", 0, 1), (None, None, "2022-04-01", 0, 1), (0.0, 0.0, "2022-05-01", 0, 1), (-118.24, 34.05, "2022-07-01", 0, 1), (-73.9, 40.7, "2022-08-01", 0, 1)]
    raw = spark.createDataFrame([(i, a, b, d, k, n) for i, (a, b, d, k, n) in enumerate(rows)], "crash_id int, longitude double, latitude double, crash_date string, number_of_pedestrians_killed int, number_of_pedestrians_injured int")
    labelled = ev.label_casualties(raw)
    reasoned = ev.drop_reasons(labelled)
    found = ev.assign(reasoned.where("drop_reason is null"), city)
    report = ev.assignment_report(reasoned, found)
    assert (report.missing, report.null_island, report.outside, report.too_far, report.to_segments, report.to_nodes) == (1, 1, 1, 1, 2, 1)
    assert "150 ft" in report.summary()
    with pytest.raises(g.SpatialJoinError, match="lost silently"):
        ev.AssignmentReport(10, 3, 0, 1, 0, 0, 0, DEFAULT_RADII).check()
    with pytest.raises(g.SpatialJoinError):
        ev.assign(reasoned, city.limit(0))


def test_nearest_ties_take_the_smallest_id(spark):
    two = spark.createDataFrame([("C_beta", [(990000.0, 200000.0), (990500.0, 200000.0)]), ("C_alpha", [(990000.0, 200200.0), (990500.0, 200200.0)])], "unit_id string, path array<struct<x:double,y:double>>")
    p = spark.createDataFrame([(1, 990250.0, 200100.0), (2, 0.0, 0.0)], "id int, x double, y double")
    assert [tuple(r) for r in geo.nearest_within(p, two, 150.0, "id", "unit_id").collect()] == [(1, "C_alpha", 100.0)]
    plan = geo.nearest_within(p, two, 150.0, "id", "unit_id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_wkt_and_geojson(spark):
    df = spark.createDataFrame([("MULTILINESTRING ((0 0, 3 4), (1 1, 1 2))",), ("POINT (1 2)",), ("junk",), (None,)], "w string").select(geo.parse_wkt("w").alias("p"))
    assert [None if r[0] is None else [len(x) for x in r[0]] for r in df.collect()] == [[2, 2], [1], None, None]
    js = [(json.dumps({"type": "LineString", "coordinates": [[0, 0], [3, 4]]}),), ('{"type":"Point","coordinates":"x"}',), ("{",), (None,)]
    assert [r[0] for r in spark.createDataFrame(js, "j string").select(geo.geojson_to_wkt("j")).collect()] == ["LINESTRING (0 0, 3 4)", None, None, None]


def test_labels_and_treatment(spark, city):
    a = city.where("unit_id = 'C0'").first()["path"]
    far = [(0.0, 0.0), (10.0, 0.0)]
    shape = "feature_id int, path array<struct<x:double,y:double>>, completion_date string"
    corridors = spark.createDataFrame([(0, [tuple(p) for p in a], None), (1, far, None)], shape)
    nodes = spark.createDataFrame([(0, [tuple(a[0])], None)], shape)
    out, lost = labels.priority_labels(city, corridors, nodes)
    assert out.count() == city.count() and [tuple(r) for r in lost.collect()] == [("corridor", 1)]
    assert out.where("vzv_source = 'corridor+intersection'").count() == 1 and out.where("is_priority is null").count() == 0
    late = spark.createDataFrame([(0, [tuple(p) for p in a], "2023-01-01"), (1, far, None)], shape)
    early = spark.createDataFrame([(0, [tuple(p) for p in a], "2019-01-01")], shape)
    got, report = labels.treatments(city, [late, early])
    assert str(got.where("unit_id = 'C0'").first()["treatment_date"]) == "2019-01-01 00:00:00" and tuple(report.first()) == (3, 1)
    with pytest.raises(g.SpatialJoinError):
        labels.treatments(city, [late.drop("completion_date")])


@pytest.fixture(scope="module")
def small(spark):
    units = spark.createDataFrame([("C1", "corridor", 500.0, None), ("C2", "corridor", 0.0, None), ("I1", "intersection", None, 4.0)], "unit_id string, unit_type string, length_ft double, leg_count double")
    rows = [("C1", "2023-01-15 20:00:00", 2, "Driver Inattention/Distraction", None), ("C1", "2023-06-10 03:00:00", 1, "Unspecified", None), ("I1", "2023-07-04 14:00:00", 3, "Unsafe Speed", None)]
    ev_ = spark.createDataFrame(rows, "unit_id string, d string, pedestrian_casualties int, contributing_factor_vehicle_1 string, contributing_factor_vehicle_2 string").withColumn("crash_date", F.col("d").cast("timestamp_ntz"))
    return units, ev_


def at(t):
    return F.expr(f"timestamp_ntz'{t} 00:00:00'")


def test_features(small):
    units, e = small
    x = {r["unit_id"]: r for r in ft.build_features(e, units, at("2024-01-01")).collect()}
    assert x["C1"]["log_exposure"] == pytest.approx(math.log(500)) and not x["C2"]["exposure_valid"] and x["I1"]["exposure"] == 4
    assert (x["C1"]["casualties_12mo"], x["C2"]["casualties_12mo"]) == (3, 0) and x["C1"]["night_share"] == 1 and x["I1"]["night_share"] == 0
    assert {r["unit_id"]: r["casualties_12mo"] for r in ft.trailing(e, at("2023-03-01")).collect()} == {"C1": 2}
    assert ft.truncated_windows(e, at("2023-12-01"), (6, 120)) == (120,)
    assert "1 of 3" in ft.feature_report(ft.exposure(units), e, at("2024-01-01"), (12,)).summary()
    with pytest.raises(g.FeatureError):
        ev.label_casualties(e)


def test_label_values(spark):
    df = spark.createDataFrame([("1", "2", "2022-03-01T08:00:00.000"), (None, "2", "2022-03-01"), ("2.0", "x", "2022-03-01"), ("1", "1", "bad")], "k string, i string, crash_date string")
    assert [r[0] for r in ev.label_casualties(df, "k", "i").select("pedestrian_casualties").collect()] == [3, 2, 2]


@pytest.fixture(scope="module")
def holdout(spark):
    v = (10, 8, 6, 4, 2, 9, 7, 5, 3, 1)
    return spark.createDataFrame([(f"C{i}", "corridor", "M" if i < 5 else "B", x, float(x), i % 2 == 0) for i, x in enumerate(v)], "unit_id string, unit_type string, borough string, holdout_casualties int, score double, treated boolean").persist()


def test_selection(spark, holdout):
    assert {r[0] for r in rk.top_n(holdout, "score", 3).select("unit_id").collect()} == {"C0", "C5", "C1"} and rk.top_n(holdout, "score", 99).count() == 10
    c = sc.capture_rate(holdout, rk.top_n(holdout, "score", 2))
    assert (c.captured, c.total) == (19, 55)
    for bad in (lambda: rk.top_n(holdout, "score", 0), lambda: rk.top_n(holdout, "nope", 1), lambda: sc.capture_rate(holdout.union(holdout), holdout)):
        with pytest.raises(g.BacktestError):
            bad()
    tied = spark.range(1000).select(F.concat(F.when(F.col("id") < 500, "C").otherwise("I"), F.col("id")).alias("unit_id"), F.lit(1).alias("s"))
    for mode in ("md5", "blake2b"):
        assert 175 < rk.top_n(tied, "s", 500, mode).where("unit_id like 'C%'").count() < 325
    assert spark.range(1).select(F.hex(fn.blake2b_key(F.lit("C0")))).first()[0] == f"{10475129511078190953:016X}"
    assert tuple(rk.tie_block(tied.limit(50), "s", 10).first()) == (50, 10) and tuple(rk.tie_block(holdout, "score", 3).first()) == (1, 1) and tuple(rk.tie_block(holdout, "score", 10).first()) == (0, 0)


def test_ranked_is_the_whole_order(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("unit_id"), F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(0).alias("s"))
    got = {r["unit_id"]: r["position"] for r in rk.ranked(df.repartition(7), "s").collect()}
    want = {r["unit_id"]: i + 1 for i, r in enumerate(rk.with_tiebreak(df).orderBy(F.desc("s"), "tie").collect())}
    assert got == want


def test_stratified(spark):
    f = lambda kind: spark.createDataFrame([(u, kind, "M", c) for u, c in zip("ABCDE", (10, 8, 6, 4, 2))] + [("N", kind, None, 9)], "unit_id string, unit_type string, borough string, c int")
    pick = lambda df: [r["unit_id"] for r in rk.stratified(df, "c", "c").orderBy("position").collect()]
    assert pick(f("corridor")) == ["A", "B"] and pick(f("intersection")) == ["A"] and pick(f("other")) == []
    assert "1 units have no borough" in rk.check_stratified(f("corridor"), rk.stratified(f("corridor"), "c", "c"))[0]
    for bad in (f("corridor").withColumn("borough", F.lit(None).cast("string")), f("corridor").withColumn("c", F.lit(0))):
        with pytest.raises(g.BacktestError):
            rk.check_stratified(bad, rk.stratified(bad, "c", "c"))


def test_bootstrap_and_bar(spark, holdout):
    a, b = rk.top_n(holdout, "score", 3), rk.top_n(holdout.withColumn("score", -F.col("score")), "score", 3)
    same = sc.bootstrap_difference(holdout, a, a, iterations=50)
    assert same.low == same.high == 0 and not same.excludes_zero
    ci = sc.bootstrap_difference(holdout, a, b, iterations=300)
    assert ci.low <= ci.point <= ci.high and sc.bootstrap_difference(holdout, a, b, iterations=300) == ci
    # drawing classes or units is one law: only chance differs; Poisson weights don't fix the number of units
    many = sc.bootstrap_difference(holdout, a, b, iterations=20_000)
    units = sc.bootstrap_gather(holdout, a, b, iterations=20_000)
    weights = sc.poisson_interval(sc.flagged(sc.flagged(holdout, a, "_a"), b, "_b"), "holdout_casualties", 3000)
    assert many.point == pytest.approx(units.point) and abs(many.low - units.low) < 1.5 and abs(many.high - units.high) < 1.5, (many, units)
    assert weights.point == pytest.approx(units.point) and abs(weights.low - units.low) < 8 and abs(weights.high - units.high) < 8, (weights, units)
    one = holdout.withColumn("holdout_casualties", (F.col("unit_id") == "C0").cast("int"))
    with pytest.raises(g.BacktestError):
        sc.bootstrap_difference(one, a, b, iterations=200)
    assert sc.preregistered_bar(40, 30, 1, 2).clears and "CI includes zero" in sc.preregistered_bar(40, 30, -1, 2).reason and "below the" in sc.preregistered_bar(32, 30, 1, 2).reason and not sc.preregistered_bar(31, 30, -1, 2).clears and sc.preregistered_bar(None, 1, 1, 2).lift is None
    zero = sc.capture_rate(holdout.withColumn("holdout_casualties", F.lit(0)), a)
    assert not zero.defined and zero.rate is None and "UNDEFINED" in zero.summary()


def test_treatment_split(spark):
    df = spark.createDataFrame([("A", 10, True, "2019-06-01"), ("B", 10, True, "2025-06-01"), ("C", 10, False, None)], "unit_id string, holdout_casualties int, treated boolean, d string").withColumn("treatment_date", F.col("d").cast("timestamp_ntz"))
    got = {r["bucket"]: (r["total"], r["rate"]) for r in sc.split_by_treatment(df, df.where("unit_id = 'A'"), holdout_start=at("2024-01-01")).collect()}
    assert got == {"before": (10, 1.0), "during": (10, 0.0), "undated": (0, None), "untreated": (10, 0.0)}
    with pytest.raises(g.BacktestError):
        sc.split_by_treatment(df.drop("treated"), df)


def test_empirical_bayes(spark):
    eb = lambda p, o, k: spark.range(1).select(md.empirical_bayes(F.lit(p), F.lit(o), k)).first()[0]
    assert eb(2.0, 10, 0.5) == pytest.approx(6) and eb(5.0, 0, 0.5) == pytest.approx(10 / 7) and eb(0.0, 5, 0.5) < 1e-6
    for k in (0.0, -1.0, float("nan")):
        with pytest.raises(g.ModelError):
            eb(1.0, 1, k)


def simulated(spark, n=1500):
    import numpy as np

    r = np.random.default_rng(20260812)
    length, night = r.uniform(200, 2000, n), r.uniform(0, 1, n)
    mu = np.exp(-6 + 0.5 * night) * length
    y = r.negative_binomial(2, 2 / (2 + mu))
    return spark.createDataFrame([(f"C{i}", "corridor", True, float(math.log(a)), float(b), int(c), int(c)) for i, (a, b, c) in enumerate(zip(length, night, y))], "unit_id string, unit_type string, exposure_valid boolean, log_exposure double, night_share double, casualties_36mo long, holdout_casualties long")


def test_negative_binomial(spark):
    df = simulated(spark).persist()
    fit = md.fit_nb(df, predictors=["night_share"])
    assert fit.dispersion == pytest.approx(0.5, abs=0.08) and fit.intercept == pytest.approx(-6, abs=0.15) and fit.coefficients["night_share"] == pytest.approx(0.5, abs=0.2)
    spread = md.fit_nb(df, predictors=["night_share"], local_rows=0)
    assert spread.dispersion == pytest.approx(fit.dispersion, rel=1e-4) and spread.intercept == pytest.approx(fit.intercept, rel=1e-4)
    out, fits = md.fit_and_blend(df, predictors=["night_share"], unit_types=("corridor",))
    assert out.where("spf_prediction <= 0 or eb_estimate is null").count() == 0 and set(fits) == {"corridor"}
    for bad in (lambda: md.fit_nb(df, predictors=["night_share"], max_iterations=1), lambda: md.fit_nb(df.limit(2), predictors=["night_share"]), lambda: md.fit_nb(df, predictors=["nope"]), lambda: md.fit_nb(df.withColumn("exposure_valid", F.lit(False)), predictors=["night_share"])):
        with pytest.raises(g.ModelError):
            bad()


@pytest.fixture(scope="module")
def published(spark):
    rows = []
    for i in range(60):
        kind = "corridor" if i % 2 == 0 else "intersection"
        k, p, c = {"corridor": 1.3, "intersection": 0.7}[kind], None if i == 3 else 0.5 + i / 20, i * 7 % 11
        w = None if p is None else 1 / (1 + k * p)
        rows.append((f"U{i}", kind, None if i == 7 else ("M", "B")[i // 30], c, 1 + i % 5, p, float(c) if p is None else w * p + (1 - w) * c, i % 3 == 0, i % 4 != 0, ("2022-05-01", "2024-06-01")[i % 2] if i % 4 else None))
    df = spark.createDataFrame(rows, "unit_id string, unit_type string, borough string, casualties_36mo int, holdout_casualties int, spf_prediction double, eb_estimate double, is_priority boolean, treated boolean, d string").withColumn("treatment_date", F.col("d").cast("timestamp_ntz")).persist()
    df = rk.with_tiebreak(df)
    start = at("2024-01-01")
    r1 = df.where("is_priority")
    n = r1.count()
    r2, r3 = rk.top_n(df, "casualties_36mo", n), rk.top_n(df, "eb_estimate", n)
    rate = lambda s: 100 * sc.capture_rate(df, s).rate
    rates = {"r1": rate(r1), "r2": rate(r2), "r3": rate(r3), "r2_stratified": rate(rk.stratified(df, "casualties_36mo", "casualties_36mo")), "r3_stratified": rate(rk.stratified(df, "eb_estimate", "casualties_36mo"))}
    ci = sc.bootstrap_difference(df, r3, r2, iterations=200)
    t = df.agg(F.count_if(F.col("treated") & (F.col("treatment_date") < start)), F.count_if(F.col("treated") & (F.col("treatment_date") >= start)), F.sum("holdout_casualties")).first()
    summary = {"n": n, "holdout_casualties": t[2], "rates": rates, "lift": rates["r3"] - rates["r2"], "ci": [ci.low, ci.high], "dispersion": {"corridor": 1.3, "intersection": 0.7}, "treated_before": t[0], "treated_during": t[1], "iterations": 200, "holdout_start": "2024-01-01 00:00:00",
               "split": {r["bucket"]: None if r["rate"] is None else 100 * r["rate"] for r in sc.split_by_treatment(df, r1, holdout_start=start).collect()}, "ties": {k: tuple(rk.tie_block(df, s, n).first()) for k, s in (("r2", "casualties_36mo"), ("r3", "eb_estimate"))}, "snapshot": "2026-01-01", "radii": DEFAULT_RADII.as_dict()}
    return df, summary


def test_audit_agrees_and_notices_changes(published):
    df, summary = published
    checks = audit.rederive(df, summary, 200)
    assert all(c.agrees for c in checks), [c for c in checks if not c.agrees]
    for key, value in (("n", 1), ("lift", 99.0), ("treated_before", 0), ("ci", [0.0, 99.0]), ("rates", summary["rates"] | {"r1": 1.0}), ("ties", summary["ties"] | {"r2": (0, 0)}), ("dispersion", {"corridor": 9.0, "intersection": 0.7})):
        assert not all(c.agrees for c in audit.rederive(df, summary | {key: value}, 200)), key
    source = open(audit.__file__).read()
    assert "segrank" not in source.replace("\"\"\"", "")


def test_artifacts(spark, published, tmp_path):
    df, summary = published
    out = str(tmp_path)
    assert not sinks.write_artifacts(df, summary, out, Radii(join_ft=100.0)) and not os.listdir(out)
    assert sinks.write_artifacts(df, summary, out)
    back, s = sinks.load_artifacts(spark, out)
    assert back.columns == list(sinks.SCORED_COLUMNS) and s["n"] == summary["n"] and sorted(os.listdir(out)) == sorted([sinks.SCORED, sinks.SUMMARY, sinks.SHORTLIST])
    s["radii"]["label_ft"] = 1.0
    json.dump(s, open(os.path.join(out, sinks.SUMMARY), "w"))
    with pytest.raises(g.AuditError):
        sinks.load_artifacts(spark, out)


class FakeApi:
    def __init__(self, rows, count=None, fail=(), short=0):
        self.rows, self.count, self.fail, self.short, self.calls = rows, len(rows) if count is None else count, list(fail), short, 0

    def __call__(self, url, token):
        import urllib.parse

        self.calls += 1
        if self.fail:
            return self.fail.pop(0), ""
        q = {k: v[0] for k, v in urllib.parse.parse_qs(url.partition("?")[2]).items()}
        if "$select" in q and q["$select"].startswith("count"):
            return 200, json.dumps([{"n": str(self.count)}])
        a, n = int(q["$offset"]), int(q["$limit"])
        return 200, json.dumps(self.rows[a : a + n - self.short])


def test_paged_source(spark):
    table = paged_api.ApiTable("t", "abcd-1234", "http://api", "x > 1", ("id",))
    rows = [{"id": str(i)} for i in range(250)]
    quiet = {"sleep": lambda s: None}
    assert [r["id"] for r in paged_api.fetch_pages(table, size=100, get=FakeApi(rows), **quiet)] == [str(i) for i in range(250)]
    assert len(paged_api.fetch_pages(table, size=100, get=FakeApi(rows, fail=(503, 503, 429)), **quiet)) == 250
    for api, error in ((FakeApi(rows, short=1), g.IncompletePullError), (FakeApi(rows[:10], count=99), g.IncompletePullError), (FakeApi([]), g.SourceError), (FakeApi(rows, fail=(400,)), g.SourceError), (FakeApi(rows, fail=(503,) * 9), g.SourceError)):
        with pytest.raises(error):
            paged_api.fetch_pages(table, size=100, get=api, **quiet)
    bad = FakeApi(rows, fail=(400, 400))
    with pytest.raises(g.SourceError):
        paged_api.count_rows(table, get=bad, **quiet)
    assert bad.calls == 1  # a bad request isn't tried again
    reader = paged_api.PagedReader(table, spark.createDataFrame([("a",)], "id string").schema, None, 100, FakeApi(rows))
    parts = reader.partitions()
    assert len(parts) == 3 and sum(len(list(reader.read(p))) for p in parts) == 250 and paged_api.clean_token("  ") is None


def test_snapshots(spark, tmp_path):
    df = lambda: spark.createDataFrame([(i, f"v{i}") for i in range(5)], "id int, value string")
    root = str(tmp_path)
    assert snapshots.pull_all(spark, {"t": df}, root, "2026-01-01") == 0 and snapshots.pull_all(spark, {"t": df, "bad": lambda: 1 / 0}, root, "2026-01-02") == 1
    assert snapshots.latest_snapshot(root).endswith("2026-01-02") and "bad" in json.load(open(f"{root}/2026-01-02/manifest.json"))["failed"]
    assert not snapshots.pull_table(df(), f"{root}/2026-01-01", "t") and snapshots.pull_table(df(), f"{root}/2026-01-01", "t", force=True)
    with pytest.raises(g.SourceError):
        snapshots.latest_snapshot(str(tmp_path / "none"))


def test_pull_of_published_tables(spark, tmp_path):
    from segrank.sources import published

    read = lambda t, token: spark.createDataFrame([('{"type":"Point","coordinates":[1,2]}', t.key)], "the_geom string, name string")
    root = str(tmp_path)
    assert len(published.TABLES) == 6 and published.TABLES["crashes"].url.endswith("/h9gi-nx95.json")
    assert published.pull(spark, root, date="2026-01-01", read=lambda s, t, token: read(t, token), count=lambda t, token: 1) == 0
    assert spark.read.parquet(f"{root}/2026-01-01/vzv_corridors.parquet").columns == ["name", "geometry_wkt"] and "the_geom" in spark.read.parquet(f"{root}/2026-01-01/crashes.parquet").columns
    assert published.pull(spark, root, ["crashes"], date="2026-01-02", read=lambda s, t, token: read(t, token), count=lambda t, token: 2) == 1  # rows were lost
    assert "1 rows of 2" in json.load(open(f"{root}/2026-01-02/manifest.json"))["failed"]["crashes"] and not os.path.exists(f"{root}/2026-01-02/crashes.parquet")
    with pytest.raises(g.SourceError):
        published.pull(spark, root, ["nope"])
    api = FakeApi([{"id": "1"}, {"id": "2", "name": "x"}])
    assert paged_api.columns_of(paged_api.ApiTable("t", "abcd-1234", "http://api"), get=api) == ("id", "name")


def test_numbers_and_ranks_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(un, "BUCKET_KEYS", 7)
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 37 % 5).alias("lead")).repartition(6)
    got = {r["k"]: r["no"] for r in un.numbered(df, [-F.col("lead")], "k", ["k"], "no").collect()}
    assert got == {k: i for i, k in enumerate(sorted(range(500), key=lambda k: (-(k * 37 % 5), k)))}
    units = spark.range(900).select(F.col("id").cast("string").alias("unit_id"), (F.col("id") % 3).cast("string").alias("kind"), F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") * 7919 % 211).alias("s")).repartition(5)
    rows = [(r["unit_id"], r["kind"], r["s"]) for r in units.collect()]
    got = {r["unit_id"]: r["pct_rank"] for r in rk.pct_rank(units, "s", "kind").collect()}
    for u, kind, v in rows[::37]:
        own = [x for _, k, x in rows if k == kind]
        assert got[u] == pytest.approx((sum(x < v for x in own) + (sum(x == v for x in own) + 1) / 2) / len(own))
    few, many = rk.top_n(units, "s", 250), rk.top_n(units, "s", 250, sort_limit=10)
    assert {r["unit_id"] for r in few.collect()} == {r["unit_id"] for r in many.collect()} and many.columns == few.columns
    got = {r["unit_id"]: (r["position"], r["cumulative"], r["total"]) for r in rk.ranked(units, "s", by=("kind",), total="s").collect()}
    for kind in "012":
        so_far = 0
        own = [r for r in rk.with_tiebreak(units).where(F.col("kind") == kind).orderBy(F.desc("s"), "tie").collect()]
        for i, r in enumerate(own):
            so_far += r["s"]
            assert got[r["unit_id"]] == (i + 1, so_far, sum(x["s"] for x in own))


def test_reports_of_sweeps(spark, tmp_path):
    rows = sweep.sweep(lambda r: {"n": 1, "holdout_casualties": 1, "rates": {"r1": 1.0, "r2": None, "r3": 2.0}, "lift": 1.5, "ci": [0.1, 0.2], "clears_bar": r.join_ft < 200}, sweep.settings())
    assert sweep.write_sweep(spark, rows, str(tmp_path)) and "NOT every setting" in open(tmp_path / "radius-sensitivity.md").read() and "UNDEFINED" in sweep.sweep_report(rows)
    zero = [{"budget": 5, "stratum": 9, "total": 4, "eb": 2, "pct": 1, "random_mean": 1.5, "random_p95": 3.0, "random_max": 4, "tie_block": 1, "ceiling": {"corridor": 0.5}}]
    assert "| 5 | eb | 2 | 50.00% |" in sweep.write_zero_history(zero, {"corridor": 2.0}, str(tmp_path))
    assert json.load(open(tmp_path / "zero-history-validity.json"))["eb_ceiling_1_over_k"] == {"corridor": 0.5}


def test_selection_counts_by_borough(holdout):
    assert {r["borough"]: r["n"] for r in rk.counts_by(rk.top_n(holdout, "score", 4)).collect()} == {"M": 2, "B": 2}


def test_sweep_runs_each_setting_once():
    assert Radii().tag == "j150-i100-v50" and len(sweep.settings()) == 9 and len({r.tag for _, r in sweep.settings()}) == 7
    runs = []

    def run(r):
        runs.append(r.tag)
        return {"n": 1, "holdout_casualties": 1, "rates": {"r1": 1.0, "r2": 1.0, "r3": 2.0}, "lift": r.join_ft / 10, "ci": [0.1, 0.2], "clears_bar": True}

    rows = sweep.sweep(run, sweep.settings())
    assert len(rows) == 9 and len(runs) == 7 and sweep.conclusion(rows)["max_tag"] == "j250-i100-v50" and sweep.conclusion(rows)["all_clear"]


def test_zero_history(spark):
    df = spark.range(400).select(F.col("id").cast("string").alias("unit_id"), F.lit("corridor").alias("unit_type"), (F.col("id") % 2).alias("casualties_36mo"), (F.col("id") % 5 == 0).cast("int").alias("holdout_casualties"), (F.col("id") % 5 == 0).cast("double").alias("eb_estimate"))
    rows = sweep.zero_history(df, {"corridor": 2.0}, (10, 40), 200)
    assert rows[0]["stratum"] == 200 and rows[0]["eb"] == 10 and 0 < rows[0]["random_mean"] < 10 and rows[0]["ceiling"] == {"corridor": 0.5}


def test_stream_equals_batch(spark, tmp_path):
    from segrank.streaming.trailing import windowed_counts

    df = spark.createDataFrame([("a", f"2024-01-{d:02d} 05:00:00", d) for d in range(1, 29)], "unit_id string, t string, v int").withColumn("ts", F.col("t").cast("timestamp")).select("unit_id", "ts", "v")
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "unit_id", "v", "7 days")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, windowed_counts(df, "ts", "unit_id", "v", "7 days").collect()))


@pytest.fixture(scope="module")
def crowd(spark):
    """Two hundred units and features that nearly all cross, and lone ones."""
    rng = __import__("random").Random(5)
    shape = lambda lone: [(20000.0 * lone + rng.uniform(0, 300), rng.uniform(0, 300)), (20000.0 * lone + rng.uniform(0, 300), rng.uniform(0, 300))]
    units = [(f"C{i}", "corridor", shape(i % 40 == 0)) for i in range(200)] + [(f"I{i}", "intersection", shape(i % 40 == 0)[:1]) for i in range(200)]
    features = [(i, shape(1 if i % 50 == 0 else 2 if i % 50 == 1 else 0), f"{2010 + i % 7}-01-{1 + i % 28:02d}" if i % 3 else None) for i in range(200)]
    u = spark.createDataFrame(units, "unit_id string, unit_type string, path array<struct<x:double,y:double>>")
    f = spark.createDataFrame(features, "feature_id int, path array<struct<x:double,y:double>>, completion_date string")
    return u.persist(), f.persist(), {tuple(r) for r in geo.lines_within(u, f, 10.0, "unit_id", "feature_id").collect()}


def rows_made(df):
    """The most rows that any step of the plan made."""
    df.collect()
    top, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(p.plan())
        else:
            if p.metrics().contains("numOutputRows"):
                top = max(top, p.metrics().apply("numOutputRows").value())
            plans.extend(p.children().apply(i) for i in range(p.children().size()))
    return top


def test_labels_of_a_crowd_make_no_pairs(crowd):
    units, features, pairs = crowd
    assert len(pairs) > 8000
    out, _ = labels.priority_labels(units, features, features.limit(0), 10.0)
    assert {r[0] for r in out.where("is_priority").select("unit_id").collect()} == {u for u, _ in pairs}
    assert rows_made(out) < 8000


def test_unmatched_features_of_a_crowd_make_no_pairs(crowd):
    units, features, pairs = crowd
    _, lost = labels.priority_labels(units, features, features.limit(0), 10.0)
    assert {tuple(r) for r in lost.collect()} == {("corridor", i) for i in set(range(200)) - {f for _, f in pairs}} != set()
    assert rows_made(lost) < 8000


def test_unmatched_features_are_settled_in_one_cell_each(spark, monkeypatch):
    rng = __import__("random").Random(7)
    spot = lambda far=0.0: (far + rng.uniform(0, 300), rng.uniform(0, 300))
    shape = "path array<struct<x:double,y:double>>"
    units = spark.createDataFrame([(f"C{i}", "corridor", [spot(), spot()]) for i in range(80)] + [(f"I{i}", "intersection", [spot()]) for i in range(80)], f"unit_id string, unit_type string, {shape}").persist()
    lines = spark.createDataFrame([(i, [spot(), spot()]) for i in range(1500)] + [(1500 + i, [spot(400.0), spot(400.0)]) for i in range(20)] + [(1520, [spot(400.0), (400.0, 0.0), (0.0, 300.0)]), (1521, None), (1522, [])], f"feature_id int, {shape}").persist()
    points = spark.createDataFrame([(i, [spot()]) for i in range(300)], f"feature_id int, {shape}").persist()
    hit = {("corridor", r[0]) for r in geo.lines_within(units, lines, 10.0, "unit_id", "feature_id").select("feature_id").collect()}
    hit |= {("intersection", r[0]) for r in geo.lines_within(units.where("unit_type = 'intersection'"), points, 10.0, "unit_id", "feature_id").select("feature_id").collect()}
    steps, store = [], geo.stored
    monkeypatch.setattr(geo, "stored", lambda df, name: store(steps.append(df) or df, name))
    lost = labels.priority_labels(units, lines, points, 10.0)[1]
    every = {("corridor", i) for i in range(1523)} | {("intersection", i) for i in range(300)}
    assert sorted(map(tuple, lost.collect())) == sorted(every - hit) and 1500 < len(hit) < 1800
    assert max(map(rows_made, [*steps, lost])) < 5000  # 12,634 when all features are put into all their cells


def test_unmatched_copies_are_tested_once(spark, monkeypatch):
    shape = "path array<struct<x:double,y:double>>"
    units = spark.createDataFrame([(f"C{i}", "corridor", [(0.0, 0.0), (200.0, 0.0)]) for i in range(400)], f"unit_id string, unit_type string, {shape}")
    lines = spark.createDataFrame([(i, [(0.0, 15.0), (200.0, 15.0)]) for i in range(400)] + [(400, [(50.0, 5.0), (60.0, 5.0)]), (401, [(50.0, 5.0), (60.0, 5.0)])], f"feature_id int, {shape}")
    steps, store = [], geo.stored
    monkeypatch.setattr(geo, "stored", lambda df, name: store(steps.append(df) or df, name))
    lost = labels.unmatched(units, lines, lines.limit(0), 10.0)
    assert sorted(map(tuple, lost.collect())) == [("corridor", i) for i in range(400)]
    assert max(map(rows_made, [*steps, lost])) < 1000  # 4,800 when each copy is put into all its cells


def test_earliest_treatment_in_a_crowd_makes_no_pairs(crowd):
    units, features, pairs = crowd
    day = {r[0]: r[1] for r in features.select("feature_id", fn.instant("completion_date")).collect()}
    first = {}
    for u, f in pairs:
        if day[f] and (u not in first or day[f] < first[u]):
            first[u] = day[f]
    out, report = labels.treatments(units, [features], 10.0)
    assert {r[0]: r[1] for r in out.where("treated").select("unit_id", "treatment_date").collect()} == first and tuple(report.first()) == (200, 67)
    assert rows_made(out) < 8000


def test_nearest_in_a_crowd_takes_small_cells_first(spark, crowd):
    rng = __import__("random").Random(6)
    rows = [(i, rng.uniform(-200, 500), rng.uniform(-200, 500)) for i in range(2000)] + [(2000, 20100.0, 150.0), (2001, 9000.0, 0.0), (2002, None, 1.0)]
    p = spark.createDataFrame(rows, "id int, x double, y double").persist()
    steps = geo._radii(p, 250.0, "x", "y")
    assert len(steps) > 1 and steps[-1] == 250.0
    best = geo.near_points(p, crowd[0], 250.0, "id", "unit_id").groupBy("id").agg(F.min(F.struct("distance", "unit_id")).alias("b"))
    plain = {(r[0], r[1]["unit_id"], r[1]["distance"]) for r in best.collect()}
    assert {tuple(r) for r in geo.nearest_within(p, crowd[0], 250.0, "id", "unit_id").collect()} == plain and 1900 < len(plain) < 2002
    first = geo._candidates(p, crowd[0], steps[0], "id", "unit_id", "path", "x", "y").count()
    assert first < geo._candidates(p, crowd[0], 250.0, "id", "unit_id", "path", "x", "y").count() / 10
