"""Rankings with a content-free tie-break, and the two selection rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from segrank.config import STRATUM_SHARES
from segrank.functions.guards import BacktestError, require_columns
from segrank.functions.scalars import tiebreak


def with_tiebreak(units: DataFrame, mode: str = "md5", key: str = "unit_id") -> DataFrame:
    """Adds tie, once for all rankings."""
    return units if "tie" in units.columns else units.withColumn("tie", tiebreak(key, mode))


def order_by(score: str) -> list[Column]:
    return [F.desc(score), F.asc("tie")]


#: Selections up to this size are a sort-limit, whose last task holds them whole; larger ones are cut from the ranking.
SORT_LIMIT = 200_000


def top_n(units: DataFrame, score: str, n: int, mode: str = "md5", sort_limit: int = SORT_LIMIT) -> DataFrame:
    """The n units of the highest scores; all if there are fewer. Up to ``sort_limit`` a sort-limit, beyond it the first n of ranked(): the same units."""
    if n <= 0:
        raise BacktestError("n must be positive")
    require_columns(units, [score, "unit_id"], BacktestError, "units")
    if n > sort_limit:
        return ranked(units, score, mode, out="_position").where(F.col("_position") <= n).drop("_position")
    return with_tiebreak(units, mode).orderBy(*order_by(score)).limit(n)


def counts_by(selection: DataFrame, by: str = "borough") -> DataFrame:
    """by, n: units of a selection by borough; those without one are left out."""
    return selection.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def ranked(units: DataFrame, score: str, mode: str = "md5", buckets: int = 64, out: str = "position", by: tuple[str, ...] = (), total: str | None = None) -> DataFrame:
    """Adds the place (1, 2, ...) of each unit in the whole order, or in that of its ``by`` columns, without one task for all.

    Scores are cut at approximate quantiles of each group, a row of them for a group; places are counted inside a
    bucket and shifted by the sizes of the buckets before it. Units that share a score at a cut, however many, are a
    bucket of their own and split by the first digit of the tie-break. With ``total`` its running sum and its sum in
    the group are added, as cumulative and total.
    """
    require_columns(units, [score, *by], BacktestError, "units")
    group = [F.col(c) for c in by] or [F.lit(0)]
    rows = with_tiebreak(units, mode).withColumn("_g", F.struct(*(c.alias(f"g{i}") for i, c in enumerate(group))))
    cuts = rows.groupBy("_g").agg(F.percentile_approx(F.col(score).cast("double"), [i / buckets for i in range(1, buckets)], 10_000).alias("_cuts"))  # a row for each group
    rows = rows.join(F.broadcast(cuts), "_g")
    value = F.col(score).cast("double")
    at, above = F.coalesce(F.array_contains("_cuts", value), F.lit(False)), F.size(F.filter(F.array_distinct("_cuts"), lambda b: F.col(score) <= b))
    digit = F.substring(F.hex(F.col("tie").cast("binary")) if mode == "blake2b" else F.col("tie"), 1, 1)
    rows = rows.withColumns({"_b": F.when(value.isNull(), -(2**30)).otherwise(-2 * above - F.when(at, 0).otherwise(1)), "_t": F.when(at, digit).otherwise("")}).drop("_cuts")
    sums = [F.coalesce(F.sum(total), F.lit(0)).alias("_s")] if total else []
    sizes = rows.groupBy("_g", "_b", "_t").agg(F.count(F.lit(1)).alias("_n"), *sums)  # a few hundred rows for each group
    earlier = Window.partitionBy("_g").orderBy(F.desc("_b"), "_t").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before{c}") for c in ("_n", *(["_s"] if total else []))]
    whole = [F.sum("_s").over(Window.partitionBy("_g")).alias("total")] if total else []
    rows = rows.join(F.broadcast(sizes.select("_g", "_b", "_t", *before, *whole)), ["_g", "_b", "_t"])
    inside = Window.partitionBy("_g", "_b", "_t").orderBy(*order_by(score))
    rows = rows.withColumn(out, (F.col("_before_n") + F.row_number().over(inside)).cast("bigint"))
    if total:
        rows = rows.withColumn("cumulative", F.col("_before_s") + F.coalesce(F.sum(total).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    return rows.drop("_g", "_b", "_t", "_before_n", "_before_s")


def pct_rank(units: DataFrame, score: str, by: str, out: str = "pct_rank") -> DataFrame:
    """Average rank of ascending scores among equal ones, over the group's size.

    Ranks are made for the distinct scores, cut into buckets like in ranked(), and come back by a join on the score.
    """
    level = units.groupBy(F.col(by).alias("_k"), F.col(score).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    level = level.withColumn("unit_id", F.col("_v").cast("string")).withColumn("_up", -F.col("_v").cast("double"))
    level = ranked(level, "_up", by=("_k",), total="_c")
    level = level.select("_k", "_v", ((F.col("cumulative") - F.col("_c") + (F.col("_c") + 1) / 2.0) / F.col("total")).alias(out))
    return units.join(level, units[by].eqNullSafe(level["_k"]) & units[score].eqNullSafe(level["_v"]), "left").drop("_k", "_v")


def stratified(units: DataFrame, score: str, casualties: str, shares: dict[str, float] = STRATUM_SHARES, mode: str = "md5", stratum: str = "borough") -> DataFrame:
    """In each (stratum, unit_type) the units by score up to and with the one whose cumulative casualties reach the type's share.

    Adds position, cumulative and total. Strata without casualties select nothing; a NULL stratum and unknown types are left out.
    """
    require_columns(units, [score, casualties, stratum, "unit_type", "unit_id"], BacktestError, "units")
    wanted = F.create_map(*(x for t, s in shares.items() for x in (F.lit(t), F.lit(s))))
    rows = with_stratum(units, stratum).where(F.col("unit_type").isin(*shares))
    rows = ranked(rows, score, mode, by=(stratum, "unit_type"), total=casualties).where("total > 0")
    stops = rows.where(F.col("cumulative") / F.col("total") >= wanted[F.col("unit_type")]).groupBy(stratum, "unit_type").agg(F.min("position").alias("_stop"))  # a row for each stratum
    return rows.join(F.broadcast(stops), [stratum, "unit_type"], "left").where("position <= coalesce(_stop, position)").drop("_stop")


def with_stratum(units: DataFrame, stratum: str = "borough") -> DataFrame:
    """Units that have a stratum."""
    return units.where(F.col(stratum).isNotNull())


def stratum_counts(units: DataFrame, stratum: str = "borough") -> DataFrame:
    """stratum (empty for NULL), n, excluded: units by stratum, and how many of them have none."""
    return units.groupBy(F.coalesce(stratum, F.lit("")).alias(stratum)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(stratum).isNull()).alias("excluded"))


def group_totals(units: DataFrame, casualties: str, stratum: str = "borough") -> DataFrame:
    """stratum, unit_type, n, casualties."""
    return units.groupBy(stratum, "unit_type").agg(F.count(F.lit(1)).alias("n"), F.sum(casualties).alias("casualties"))


def check_stratified(units: DataFrame, selection: DataFrame, stratum: str = "borough") -> list[str]:
    """Notes on what was left out; raises if all strata are NULL or nothing was picked."""
    n, null = stratum_counts(units, stratum).agg(F.sum("n"), F.sum("excluded")).first()
    if n == null:
        raise BacktestError(f"{stratum} is NULL everywhere")
    if selection.limit(1).count() == 0:
        raise BacktestError("nothing was picked")
    notes = [f"{null} units have no {stratum} and were not considered"] if null else []
    picked = selection.select(stratum, "unit_type").distinct()
    for r in with_stratum(units, stratum).select(stratum, "unit_type").distinct().join(picked, [stratum, "unit_type"], "left_anti").orderBy(stratum, "unit_type").collect():
        notes.append(f"{r[0]} {r[1]}: no casualties, nothing selected")
    return notes


def tie_block(units: DataFrame, score: str, n: int, mode: str = "md5") -> DataFrame:
    """One row: tied (units with the score of the cut) and by_tiebreak (picks that only the tie-break decides); both 0 if n takes all."""
    cut = top_n(units.select("unit_id", score), score, n, mode).agg(F.min(score).alias("cut"), F.count(F.lit(1)).alias("_k"))
    size = units.agg(F.count(F.lit(1)).alias("_n"))
    level = units.groupBy(score).agg(F.count(F.lit(1)).alias("_c"))  # a row for each score, so the join is small
    joined = level.join(F.broadcast(cut), F.col(score) >= F.col("cut")).agg(F.sum(F.when(F.col(score) == F.col("cut"), F.col("_c"))).alias("tied"), F.coalesce(F.sum(F.when(F.col(score) > F.col("cut"), F.col("_c"))), F.lit(0)).alias("_above"))
    return joined.join(F.broadcast(size)).select(F.when(F.col("_n") > n, F.col("tied")).otherwise(0).cast("bigint").alias("tied"), F.when(F.col("_n") > n, n - F.col("_above")).otherwise(0).cast("bigint").alias("by_tiebreak"))


def n_sweep(units: DataFrame, score: str, casualties: str, sizes, mode: str = "md5") -> DataFrame:
    """n, captured, total for selections of several sizes, from one sort-limit of the largest."""
    top = top_n(units.select("unit_id", score, casualties), score, max(sizes), mode)
    top = top.withColumn("_r", F.row_number().over(Window.orderBy(*order_by(score))))  # max(sizes) rows at most
    caught = top.agg(*(F.coalesce(F.sum(F.when(F.col("_r") <= n, F.col(casualties))), F.lit(0)).cast("bigint").alias(str(n)) for n in sizes))
    rows = caught.select(F.explode(F.array(*(F.struct(F.lit(n).cast("bigint").alias("n"), F.col(str(n)).alias("captured")) for n in sizes))).alias("s")).select("s.*")
    return rows.join(F.broadcast(units.agg(F.sum(casualties).cast("bigint").alias("total"))))
