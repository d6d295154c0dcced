"""Independent re-derivation of a run's headline, in SQL text; shares no code with the operators."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

PP, EB = 1e-6, 1e-12


class RederivationError(ValueError):
    """Scores can't be ranked, or artifacts contradict each other."""


@dataclass(frozen=True)
class Check:
    label: str
    published: float | None
    rederived: float | None
    tolerance: float

    @property
    def agrees(self) -> bool:
        if self.published is None or self.rederived is None:
            return self.published is None and self.rederived is None
        return abs(self.published - self.rederived) <= self.tolerance


def _k(dispersion: dict[str, float]) -> str:
    return "CASE unit_type " + " ".join(f"WHEN '{t}' THEN {k!r}D" for t, k in dispersion.items()) + " END"


def rederive(frame: DataFrame, summary: dict, iterations: int = 10_000) -> list[Check]:
    """All published figures against what SQL makes of the published units.

    ``summary`` has n, holdout_casualties, rates (r1, r2, r3, r2_stratified, r3_stratified; percent), lift, ci,
    dispersion, split (bucket to percent), treated_before, treated_during and ties (r2, r3: tied, by_tiebreak).
    """
    spark: SparkSession = frame.sparkSession
    frame.createOrReplaceTempView("audit_units")
    bad = spark.sql("SELECT count_if(casualties_36mo IS NULL OR isnan(eb_estimate) OR eb_estimate IS NULL) AS n, count(*) - count(DISTINCT unit_id) AS d FROM audit_units").first()
    if bad["n"] or bad["d"]:
        raise RederivationError(f"{bad['n']} units without a score, {bad['d']} repeated")
    floor = "greatest(spf_prediction, 1e-9D)"
    k = _k(summary["dispersion"])
    spark.sql(f"""
        SELECT *, md5(unit_id) AS audit_key, CASE WHEN spf_prediction IS NULL THEN cast(casualties_36mo AS DOUBLE)
          ELSE 1 / (1 + {k} * {floor}) * {floor} + (1 - 1 / (1 + {k} * {floor})) * casualties_36mo END AS eb2 FROM audit_units""").createOrReplaceTempView("audit_scored")
    n = int(spark.sql("SELECT count_if(is_priority) FROM audit_units").first()[0])
    total = int(spark.sql("SELECT sum(holdout_casualties) FROM audit_units").first()[0] or 0)
    checks = [Check("selection size", summary["n"], n, 0), Check("holdout casualties", summary["holdout_casualties"], total, 0)]
    gap = spark.sql("SELECT max(abs(eb2 - eb_estimate)) FROM audit_scored").first()[0]
    checks.append(Check("largest difference of blends", 0.0, gap, EB * max(1.0, float(spark.sql("SELECT max(abs(eb_estimate)) FROM audit_units").first()[0] or 1))))

    def caught(where: str) -> float | None:
        got = spark.sql(f"SELECT sum(holdout_casualties) FROM ({where})").first()[0] or 0
        return 100 * got / total if total else None

    picks = {"r1": "SELECT * FROM audit_scored WHERE is_priority", "r2": f"SELECT * FROM audit_scored ORDER BY casualties_36mo DESC, audit_key LIMIT {n}", "r3": f"SELECT * FROM audit_scored ORDER BY eb2 DESC, audit_key LIMIT {n}"}
    for name, score in (("r2_stratified", "casualties_36mo"), ("r3_stratified", "eb2")):
        picks[name] = f"""
            SELECT * FROM (SELECT *, min(CASE WHEN run / whole >= CASE unit_type WHEN 'corridor' THEN 0.5D ELSE 0.15D END THEN place END) OVER (PARTITION BY borough, unit_type) AS stop
              FROM (SELECT *, row_number() OVER (PARTITION BY borough, unit_type ORDER BY {score} DESC, audit_key) AS place, cast(sum(casualties_36mo) OVER (PARTITION BY borough, unit_type) AS DOUBLE) AS whole,
                      sum(casualties_36mo) OVER (PARTITION BY borough, unit_type ORDER BY {score} DESC, audit_key ROWS UNBOUNDED PRECEDING) AS run
                    FROM audit_scored WHERE borough IS NOT NULL AND unit_type IN ('corridor', 'intersection')) WHERE whole > 0) WHERE place <= coalesce(stop, place)"""
    rates = {name: caught(sql) for name, sql in picks.items()}
    checks += [Check(f"rate {name}", summary["rates"][name], rate, PP) for name, rate in rates.items()]
    checks.append(Check("lift", summary["lift"], None if rates["r3"] is None else rates["r3"] - rates["r2"], PP))
    low, high = _interval(spark, picks, iterations, summary.get("seed", 20260812))
    loose = PP if iterations == summary.get("iterations", iterations) else 0.5
    checks += [Check("interval, low", summary["ci"][0], low, loose), Check("interval, high", summary["ci"][1], high, loose)]
    start = f"timestamp_ntz'{summary['holdout_start']}'"
    split = spark.sql(f"""SELECT b, sum(CASE WHEN is_priority THEN holdout_casualties END) AS c, sum(holdout_casualties) AS t FROM (SELECT *, CASE WHEN NOT coalesce(treated, false) THEN 'untreated' WHEN treatment_date IS NULL THEN 'undated' WHEN treatment_date < {start} THEN 'before' ELSE 'during' END AS b FROM audit_units) GROUP BY b""").collect()
    found = {r["b"]: 100 * (r["c"] or 0) / r["t"] if r["t"] else None for r in split}
    checks += [Check(f"rate r1, {b}", v, found.get(b), PP) for b, v in sorted(summary["split"].items())]
    row = spark.sql(f"SELECT count_if(treated AND treatment_date < {start}) AS a, count_if(treated AND treatment_date >= {start}) AS b FROM audit_units").first()
    checks += [Check("treated before", summary["treated_before"], row["a"], 0), Check("treated during", summary["treated_during"], row["b"], 0)]
    for name, score in (("r2", "casualties_36mo"), ("r3", "eb2")):
        t = spark.sql(f"WITH c AS (SELECT min({score}) AS cut FROM ({picks[name]})) SELECT count_if({score} = cut) AS tied, {n} - count_if({score} > cut) AS picks, count(*) AS n FROM audit_scored CROSS JOIN c").first()
        tied, by = (t["tied"], t["picks"]) if t["n"] > n else (0, 0)
        checks += [Check(f"ties {name}", summary["ties"][name][0], tied, 0), Check(f"picks by tie-break {name}", summary["ties"][name][1], by, 0)]
    return checks


def _interval(spark: SparkSession, picks: dict[str, str], iterations: int, seed: int) -> tuple[float, float]:
    """The bootstrap, draw by draw over counts of units that are alike in casualties and membership; no unit comes to the driver."""
    rows = spark.sql(f"""SELECT v, d, count(*) AS n FROM (SELECT coalesce(cast(u.holdout_casualties AS DOUBLE), 0D) AS v, if(a.unit_id IS NULL, 0, 1) - if(b.unit_id IS NULL, 0, 1) AS d
      FROM audit_units u LEFT JOIN (SELECT unit_id FROM ({picks['r3']})) a ON u.unit_id = a.unit_id LEFT JOIN (SELECT unit_id FROM ({picks['r2']})) b ON u.unit_id = b.unit_id) GROUP BY v, d ORDER BY v, d""").collect()
    counts = np.array([r["n"] for r in rows])
    rng, out = np.random.default_rng(seed), []
    for _ in range(iterations):
        whole = diff = 0.0
        for k, r in zip(rng.multinomial(counts.sum(), counts / counts.sum()).tolist(), rows, strict=True):
            whole += k * r["v"]
            diff += k * r["v"] * r["d"]
        if whole > 0:
            out.append(100 * diff / whole)
    return tuple(float(x) for x in np.percentile(out, [2.5, 97.5]))


def render(checks: list[Check]) -> str:
    """Markdown: one line for each comparison."""
    lines = ["| figure | published | re-derived | agrees |", "|---|---:|---:|---|"]
    lines += [f"| {c.label} | {c.published} | {c.rederived} | {'yes' if c.agrees else 'NO'} |" for c in checks]
    good = sum(c.agrees for c in checks)
    return "\n".join([f"{good} of {len(checks)} figures re-derived", "", *lines])
