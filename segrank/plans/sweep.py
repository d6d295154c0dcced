"""Sensitivity to the radii, and the validity of the order among units without history."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from segrank.config import DEFAULT_RADII, SWEEP, ZERO_BUDGETS, ZERO_DRAWS, ZERO_SEED, Radii
from segrank.functions.guards import BacktestError
from segrank.operators.rank import pct_rank


SCHEMA = "knob string, value double, tag string, published boolean, join_ft double, node_ft double, label_ft double, n long, holdout long, r1 double, r2 double, r3 double, lift double, low double, high double, clears_bar boolean"


def settings(quick: bool = False) -> list[tuple[str, Radii]]:
    """(knob, radii): each radius varied alone with the published value among its own; ``quick``: the first of each."""
    out = []
    for knob, values in SWEEP.items():
        base = DEFAULT_RADII.as_dict()
        for v in sorted([*values, base[knob]])[: 1 if quick else None]:
            out.append((knob, Radii(**(base | {knob: v}))))
    return out


def sweep(run: Callable[[Radii], dict], chosen: list[tuple[str, Radii]]) -> list[dict]:
    """A row for each setting; equal settings run once."""
    known: dict[str, dict] = {}
    rows = []
    for knob, radii in chosen:
        if radii.tag not in known:
            known[radii.tag] = run(radii)
        s = known[radii.tag]
        rows.append({"knob": knob, "value": radii.as_dict()[knob], "tag": radii.tag, "published": radii == DEFAULT_RADII, **radii.as_dict(), "n": s["n"], "holdout": s["holdout_casualties"], "r1": s["rates"]["r1"], "r2": s["rates"]["r2"], "r3": s["rates"]["r3"], "lift": s["lift"], "low": s["ci"][0], "high": s["ci"][1], "clears_bar": s["clears_bar"]})
    return rows


def conclusion(rows: list[dict]) -> dict:
    """Smallest and largest lift with their settings, and whether all clear the bar."""
    low, high = min(rows, key=lambda r: r["lift"]), max(rows, key=lambda r: r["lift"])
    return {"min_lift": low["lift"], "min_tag": low["tag"], "max_lift": high["lift"], "max_tag": high["tag"], "all_clear": all(r["clears_bar"] for r in rows)}


def _table(head: list[str], rows: list[list]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(str, r)) + " |" for r in rows)]


def sweep_report(rows: list[dict]) -> str:
    """Markdown: a line for each setting, and whether all clear the bar."""
    pct = lambda x: "UNDEFINED" if x is None else f"{x:.2f}"
    end = conclusion(rows)
    lines = _table(["radius", "ft", "setting", "N", "r1 %", "r2 %", "r3 %", "lift pp", "interval", "clears"], [[r["knob"], f"{r['value']:g}", r["tag"] + " (published)" * r["published"], r["n"], pct(r["r1"]), pct(r["r2"]), pct(r["r3"]), pct(r["lift"]), f"[{r['low']:.2f}, {r['high']:.2f}]", "yes" if r["clears_bar"] else "NO"] for r in rows])
    return "\n".join(["# Sensitivity to the radii", "", *lines, "", f"Lift from {end['min_lift']:.2f} pp ({end['min_tag']}) to {end['max_lift']:.2f} pp ({end['max_tag']}); " + ("every setting clears the bar." if end["all_clear"] else "NOT every setting clears the bar."), ""])


def write_sweep(spark: SparkSession, rows: list[dict], folder: str, partial: bool = False) -> str:
    """A CSV and a Markdown file; a partial sweep has other names."""
    path = os.path.join(folder, "radius-sensitivity-quick.csv" if partial else "radius-sensitivity.csv")
    spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA).coalesce(1).write.mode("overwrite").csv(path, header=True)
    os.makedirs(folder, exist_ok=True)
    with open(path[:-4] + ".md", "w", encoding="utf-8") as f:
        f.write(sweep_report(rows))
    return path


def write_zero_history(rows: list[dict], dispersion: dict[str, float], folder: str, draws: int = ZERO_DRAWS, seed: int = ZERO_SEED) -> str:
    """zero-history-validity.json and .md; returns the Markdown."""
    os.makedirs(folder, exist_ok=True)
    results = [{k: v for k, v in r.items() if k != "ceiling"} for r in rows]
    ceiling = {t: 1 / k for t, k in dispersion.items()}
    with open(os.path.join(folder, "zero-history-validity.json"), "w", encoding="utf-8") as f:
        json.dump({"stratum_units": rows[0]["stratum"], "stratum_holdout_casualties": rows[0]["total"], "dispersion": dispersion, "eb_ceiling_1_over_k": ceiling, "random_draws": draws, "seed": seed, "results": results}, f, indent=2)
    share = lambda c: "UNDEFINED" if not rows[0]["total"] else f"{100 * c / rows[0]['total']:.2f}%"
    lines = _table(["budget", "order", "captured", "of stratum", "random mean", "random p95", "tie block"], [[r["budget"], k, r[k], share(r[k]), f"{r['random_mean']:.1f}", f"{r['random_p95']:.0f}", r["tie_block"]] for r in rows for k in ("eb", "pct")])
    text = "\n".join(["# Order among units without history", "", f"{rows[0]['stratum']} units without history have {rows[0]['total']} casualties in the holdout.", "", "Ceiling 1/k: " + ", ".join(f"{t} {c:.4f}" for t, c in sorted(ceiling.items())), "", *lines, ""])
    with open(os.path.join(folder, "zero-history-validity.md"), "w", encoding="utf-8") as f:
        f.write(text)
    return text


def zero_stratum(scored: DataFrame, observed: str = "casualties_36mo") -> DataFrame:
    """Units without history in the window."""
    return scored.where(F.col(observed) == 0)


def captured_by(stratum: DataFrame, score: str, budget: int, casualties: str = "holdout_casualties") -> int:
    """Casualties of the ``budget`` highest scores; ties by unit_id."""
    return int(stratum.orderBy(F.desc(score), F.asc("unit_id")).limit(budget).agg(F.coalesce(F.sum(casualties), F.lit(0))).first()[0])


def zero_history(scored: DataFrame, dispersion: dict[str, float], budgets=ZERO_BUDGETS, draws: int = ZERO_DRAWS, seed: int = ZERO_SEED, casualties: str = "holdout_casualties", observed: str = "casualties_36mo") -> list[dict]:
    """For each budget: what the blended order and the order by rank inside each type capture, against random draws without replacement.

    Random totals are drawn from the numbers of units by casualty count (a multivariate hypergeometric law), so no unit comes to the driver.
    """
    stratum = pct_rank(zero_stratum(scored, observed), "eb_estimate", "unit_type").persist()
    levels = sorted(tuple(r) for r in stratum.groupBy(casualties).count().collect())  # as many rows as there are counts
    size = sum(n for _, n in levels)
    if not size:
        raise BacktestError("no unit is without history")
    values, counts = np.array([v for v, _ in levels]), np.array([n for _, n in levels])
    rng, out = np.random.default_rng(seed), []
    for b in budgets:
        take = min(b, size)
        totals = rng.multivariate_hypergeometric(counts, take, size=draws, method="marginals") @ values
        cut = stratum.orderBy(F.desc("eb_estimate"), F.asc("unit_id")).limit(take).agg(F.min("eb_estimate")).first()[0]
        tied = stratum.where(F.col("eb_estimate") == cut).count()
        out.append({"budget": b, "stratum": size, "total": int((values * counts).sum()), "eb": captured_by(stratum, "eb_estimate", take, casualties), "pct": captured_by(stratum, "pct_rank", take, casualties), "random_mean": float(totals.mean()), "random_p95": float(np.percentile(totals, 95)), "random_max": int(totals.max()), "tie_block": tied})
    out[0]["ceiling"] = {t: 1 / k for t, k in dispersion.items()}
    stratum.unpersist()
    return out
