"""From a snapshot to a verdict: the whole run, and its command line."""

from __future__ import annotations

import argparse
import hashlib
import inspect
import os
import sys

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from segrank.config import BOOTSTRAP_ITERATIONS, BOOTSTRAP_SEED, DEFAULT_RADII, HOLDOUT_YEARS, PREDICTORS, TRAILING_MONTHS, TRAIN_YEARS, Radii
from segrank.operators import events as ev
from segrank.operators import features as ft
from segrank.operators import labels as lb
from segrank.operators import model as md
from segrank.operators import rank as rk
from segrank.operators import score as sc
from segrank.operators import universe as un
from segrank.operators.geo import project_path
from segrank.functions.guards import BacktestError, require_unique, with_srid
from segrank.functions.scalars import time_part
from segrank.config import CRS_PROJECTED
from segrank.sources import sinks, snapshots
from segrank.sources.work import discard, stored


def code_tag() -> str:
    """Six bytes of a hash of the code that units depend on."""
    h = hashlib.blake2b(digest_size=6)
    for module in (ev, ft, lb, un):
        h.update(inspect.getsource(module).encode())
    return h.hexdigest()


def cache_path(folder: str, snapshot: str, radii: Radii) -> str:
    return f"{folder}/units-{os.path.basename(snapshot.rstrip('/'))}-{radii.tag}-{code_tag()}.parquet"


def _years(a: int, b: int):
    at = lambda y: F.expr(f"timestamp_ntz'{y}-01-01 00:00:00'")
    return at(a), at(b + 1)


def with_stored_id(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` with a row number, stored: rows keep their numbers even if executors are lost. Coordinate systems stay in the columns' metadata."""
    return stored(df.withColumn(name, F.monotonically_increasing_id()), key)


def features_of(shapes: DataFrame) -> DataFrame:
    """feature_id and projected path of a layer's parts."""
    rows = shapes.select("*", F.explode("parts").alias("_p")).withColumn("path", project_path("_p")).drop("parts", "_p")
    return rows


def build_units(spark: SparkSession, snapshot: str, radii: Radii = DEFAULT_RADII, cache: str | None = None, train=TRAIN_YEARS, holdout=HOLDOUT_YEARS, months=TRAILING_MONTHS) -> tuple[DataFrame, ev.AssignmentReport | None]:
    """Universe, labels, treatments, assigned events, features and the holdout's outcome, one row a unit; a cached table if there is one of this snapshot, radii and code."""
    if cache and os.path.exists(os.path.join(cache_path(cache, snapshot, radii), "_SUCCESS")):
        return spark.read.parquet(cache_path(cache, snapshot, radii)), None
    lines = with_stored_id(snapshots.read_centerline(spark, snapshot), "row_no", "lines")
    lines = with_srid(lines.withColumn("parts", F.transform("parts", project_path)), "parts", CRS_PROJECTED)
    units = un.build_universe(lines).persist()
    layer = lambda key: features_of(with_stored_id(snapshots.read_geo(spark, snapshot, key), "feature_id", key))
    units_ = lb.labelled(units, layer("vzv_corridors"), layer("vzv_intersections"), radii.label_ft)
    sips = [layer(k) for k in ("sip_corridors", "sip_intersections") if os.path.exists(f"{snapshot}/{k}.parquet")]
    if sips:
        units_, _ = lb.treatments(units_, sips)
    else:
        units_ = units_.withColumn("treated", F.lit(False)).withColumn("treatment_date", F.lit(None).cast("timestamp_ntz"))
    raw = with_stored_id(ev.label_casualties(snapshots.read_table(spark, snapshot, "crashes")), "crash_id", "crashes")
    reasoned = ev.drop_reasons(raw).persist()
    found = ev.assign(reasoned.where("drop_reason is null"), units, "crash_id", radii).persist()
    report = ev.assignment_report(reasoned, found, radii)
    assigned = reasoned.join(found.select("crash_id", "unit_id"), "crash_id")
    begin, end = _years(*train)
    start, stop = _years(*holdout)
    trained = assigned.where(time_part(F.col("crash_date"), begin, start, stop) == "train").where(F.col("crash_date") < end)
    out = ft.build_features(trained, units_, end, months)
    out = ft.fill_join(out, ft.between_sum(assigned, start, stop, "holdout_casualties")).drop("path")
    if cache:
        out.write.mode("overwrite").parquet(cache_path(cache, snapshot, radii))
        out = spark.read.parquet(cache_path(cache, snapshot, radii))
    return out, report


def summary_counts(scored: DataFrame, start: Column) -> DataFrame:
    """One row of counts: units by kind, label, borough and treatment, and the holdout's casualties."""
    return scored.agg(
        F.count(F.lit(1)).alias("units"), F.count_if(F.col("unit_type") == "corridor").alias("corridors"), F.count_if("is_priority").alias("priority"), F.count_if(F.col("borough").isNull()).alias("no_borough"), F.count_if("treated").alias("treated"),
        F.count_if(F.col("treated") & (F.col("treatment_date") < start)).alias("treated_before"), F.count_if(F.col("treated") & (F.col("treatment_date") >= start)).alias("treated_during"), F.coalesce(F.sum("holdout_casualties"), F.lit(0)).cast("bigint").alias("holdout"),
    )


def evaluate(units: DataFrame, predictors=PREDICTORS, iterations: int = BOOTSTRAP_ITERATIONS, seed: int = BOOTSTRAP_SEED, holdout_start: str = "2024-01-01 00:00:00", observed: str = "casualties_36mo", mode: str = "md5") -> tuple[DataFrame, dict]:
    """Scored units and the run's figures: three rankings of one size, interval, bar, both stratified selections and the treatment split."""
    units = stored(units, "units")
    scored, fits = md.fit_and_blend(units, observed, predictors, observed)
    return judge(scored, {t: f.dispersion for t, f in fits.items()}, iterations, seed, holdout_start, observed, mode)


def judge(scored: DataFrame, dispersion: dict[str, float], iterations: int = BOOTSTRAP_ITERATIONS, seed: int = BOOTSTRAP_SEED, holdout_start: str = "2024-01-01 00:00:00", observed: str = "casualties_36mo", mode: str = "md5", brief: bool = False) -> tuple[DataFrame, dict]:
    """What evaluate() makes of units that have spf_prediction and eb_estimate already.

    Selections become flags of the units, so that all rates, classes of the bootstrap and sizes come from aggregates of
    one persisted frame. ``brief`` gives what a sweep's row takes: no stratified selections, splits, ties and boroughs.
    """
    start = F.expr(f"timestamp_ntz'{holdout_start}'")
    scored = stored(rk.with_tiebreak(scored, mode), "scored")
    require_unique(scored, "unit_id", BacktestError)
    row = summary_counts(scored, start).first()
    n = row["priority"]
    picks = {"r2": rk.top_n(scored, observed, n), "r3": rk.top_n(scored, "eb_estimate", n)}
    if not brief:
        picks |= {"r2_stratified": rk.stratified(scored, observed, observed), "r3_stratified": rk.stratified(scored, "eb_estimate", observed)}
    marked = scored.select("unit_id", "borough", "holdout_casualties", F.col("is_priority").alias("r1"))
    for k, sel in picks.items():
        marked = sc.flagged(marked, sel.select("unit_id"), k)
    marked = stored(marked, "marked")
    names = ("r1", *picks)
    got = marked.agg(*(F.sum(F.when(F.col(k), F.col("holdout_casualties"))).alias(k) for k in names), *(F.count_if(k).alias(f"n_{k}") for k in names)).first()
    pct = {k: 100 * (got[k] or 0) / row["holdout"] if row["holdout"] else None for k in names}
    ci = sc.class_interval(sc.outcome_classes(marked, "r3", "r2"), iterations, seed=seed)
    verdict = sc.preregistered_bar(pct["r3"], pct["r2"], ci.low, ci.high)
    if brief:
        discard(marked)
        return scored, {"n": n, "holdout_casualties": row["holdout"], "rates": pct, "lift": verdict.lift, "ci": [ci.low, ci.high], "clears_bar": verdict.clears}
    split = {r["bucket"]: None if r["rate"] is None else 100 * r["rate"] for r in sc.split_by_treatment(scored, scored.where("is_priority").select("unit_id"), holdout_start=start).collect()}
    ties = {k: tuple(rk.tie_block(scored, s, n).first()) for k, s in (("r2", observed), ("r3", "eb_estimate"))}
    boroughs = {r["borough"]: r["n"] for r in rk.counts_by(marked.where("r3")).collect()}
    discard(marked)
    summary = {
        "n": n, "units": row["units"], "corridors": row["corridors"], "intersections": row["units"] - row["corridors"], "treated": row["treated"], "treated_before": row["treated_before"], "treated_during": row["treated_during"], "holdout_casualties": row["holdout"], "rates": pct,
        "lift": verdict.lift, "ci": [ci.low, ci.high], "ci_mode": ci.mode, "clears_bar": verdict.clears, "reason": verdict.reason, "dispersion": dispersion, "split": split, "ties": ties, "iterations": iterations, "seed": seed, "holdout_start": holdout_start,
        "stratified_sizes": [got["n_r2_stratified"], got["n_r3_stratified"]], "boroughs_r3": boroughs,
    }
    return scored, summary


def run(spark: SparkSession, snapshot: str, out: str | None = None, radii: Radii = DEFAULT_RADII, cache: str | None = None, iterations: int = BOOTSTRAP_ITERATIONS, **how) -> dict:
    """The whole run; writes artifacts into ``out`` if the radii are the default ones."""
    units, report = build_units(spark, snapshot, radii, cache)
    scored, summary = evaluate(units, iterations=iterations, **how)
    summary |= {"snapshot": os.path.basename(snapshot.rstrip("/")), "radii": radii.as_dict()}
    if report:
        summary |= {"events": report.total, "events_assigned": report.assigned, "events_dropped": report.dropped}
    if out:
        sinks.write_artifacts(scored, summary, out, radii)
    return summary


def session(name: str = "segrank") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    """pull | run | audit | sweep | zero-history, over a snapshot root or a folder of artifacts."""
    p = argparse.ArgumentParser(prog="segrank")
    p.add_argument("what", choices=("pull", "run", "audit", "sweep", "zero-history"))
    p.add_argument("--snapshots", default="data/raw")
    p.add_argument("--out", default="data/processed")
    p.add_argument("--cache", default="data/cache")
    p.add_argument("--iterations", type=int, default=BOOTSTRAP_ITERATIONS)
    for k, v in DEFAULT_RADII.as_dict().items():
        p.add_argument(f"--{k.replace('_', '-')}", type=float, default=v)
    p.add_argument("--quick", action="store_true", help="sweep: the first value of each radius only")
    p.add_argument("--force", action="store_true", help="pull: tables that are there already, too")
    p.add_argument("--only", nargs="*", help="pull: keys of tables")
    a = p.parse_args(argv)
    spark, radii = session(), Radii(a.join_ft, a.node_ft, a.label_ft)
    from segrank.plans import audit, sweep
    from segrank.sources import published

    if a.what == "pull":
        return published.pull(spark, a.snapshots, a.only, a.force, os.environ.get("APP_TOKEN"))
    if a.what == "audit":
        df, summary = sinks.load_artifacts(spark, a.out)
        checks = audit.rederive(df, summary, a.iterations)
        print(audit.render(checks))
        return int(not all(c.agrees for c in checks))
    snapshot = snapshots.latest_snapshot(a.snapshots)
    if a.what == "run":
        print(run(spark, snapshot, a.out, radii, a.cache, a.iterations))
    elif a.what == "sweep":
        rows = sweep.sweep(lambda r: run(spark, snapshot, None, r, a.cache, a.iterations), sweep.settings(a.quick))
        sweep.write_sweep(spark, rows, a.out, partial=a.quick)
        print(sweep.sweep_report(rows))
        return int(not all(r["clears_bar"] for r in rows))
    else:
        units, _ = build_units(spark, snapshot, radii, a.cache)
        scored, fits = md.fit_and_blend(units)
        dispersion = {t: f.dispersion for t, f in fits.items()}
        rows = sweep.zero_history(scored, dispersion)
        print(sweep.write_zero_history(rows, dispersion, a.out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
