"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Signals of a text are computed in one pass.  Cutoffs form one ladder of rungs, fixed beforehand, from
loose to strict; a rung rejects what exceeds any of its cutoffs.  A labelled holdout says how far down
each stratum (the language) may go: its good documents that a rung rejects are counted jointly over all
signals, and rungs are tested in order (fixed-sequence testing) until one isn't proven, by the exact
binomial bound, to reject no more than ``risk`` of the stratum's good documents.  Testing in a fixed
order needs no correction for the number of rungs; the error probability is shared out over the strata
(Bonferroni), so all strata keep the promise together with probability 1 - ``error`` at least.  A
stratum without enough labels gets no rung and keeps its documents: at 0.05, 0.05 and four strata, 86
good documents without a rejection are enough.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from segrank.llm.common import MAX_BROADCAST_KEYS, materialize, release, require

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Allowed false rejection in a stratum, and the probability of exceeding it.
RISK, ERROR = 0.05, 0.05
SIGNALS = ("symbol_share", "dup_line_share", "repeat_share", "word_length")
#: Cutoffs of SIGNALS in thousandths, loosest rung first; a document is rejected if a signal exceeds its cutoff.
LADDER = (
    (300, 700, 500, 15_000),
    (200, 600, 400, 14_000),
    (150, 500, 400, 12_000),
    (100, 500, 400, 12_000),
    (60, 500, 400, 12_000),
    (60, 400, 300, 10_000),
    (60, 300, 300, 10_000),
    (60, 300, 200, 10_000),
)
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def signals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts as columns; a null text has no words. Counts are code points and whole texts.

    Repeats: windows of three words are compared by 64-bit hashes. Without equal hashes the answer is zero at
    once; few distinct repeats are looked up, many are found by sorting (hash, place). Each step is a column of
    its own projection, so nothing is computed twice.
    """
    require(docs, text_col)
    hidden = "_q_"
    text, words, hashes, windows = (F.col(hidden + x) for x in ("t", "w", "h", "g"))
    n = F.col("n_words").cast("int")
    df = docs.withColumn(hidden + "t", F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumns({hidden + "w": F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), hidden + "l": F.split(text, "\n")})
    df = df.withColumn(hidden + "l", F.filter(F.col(hidden + "l"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != ""))
    df = df.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(hidden + "l") - F.size(F.array_distinct(hidden + "l"))).cast("long"),
        "n_lines": F.size(hidden + "l").cast("long"),
        hidden + "h": F.transform(words, lambda w: F.xxhash64(w)),
    }).drop(hidden + "t", hidden + "w", hidden + "l")
    df = df.withColumns({hidden + "a": F.slice(hashes, 1, F.greatest(n - 2, F.lit(0))), hidden + "b": F.slice(hashes, 2, F.greatest(n - 2, F.lit(0))), hidden + "c": F.slice(hashes, 3, F.greatest(n - 2, F.lit(0)))})
    df = df.withColumn(hidden + "g", F.zip_with(F.zip_with(hidden + "a", hidden + "b", lambda a, b: F.xxhash64(a, b)), F.col(hidden + "c"), lambda ab, c: F.xxhash64(ab, c))).drop(*(hidden + x for x in "habc"))
    df = df.withColumn(hidden + "s", F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.array_sort(windows)))
    again = F.filter(F.zip_with(F.col(hidden + "s"), F.slice(hidden + "s", 2, F.size(hidden + "s")), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull())
    df = df.withColumn(hidden + "r", F.array_distinct(again)).drop(hidden + "s")
    repeats = F.col(hidden + "r")
    few = F.filter(F.transform(windows, lambda h, i: F.when(F.array_contains(repeats, h), i)), lambda i: i.isNotNull())
    df = df.withColumns({hidden + "f": F.when(F.size(repeats) <= 64, few), hidden + "p": F.when(F.size(repeats) > 64, F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))}).drop(hidden + "g")
    pairs = F.col(hidden + "p")
    many = F.flatten(F.zip_with(pairs, F.slice(pairs, 2, F.size(pairs)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
    df = df.withColumn(hidden + "i", F.coalesce(hidden + "f", many)).drop(hidden + "f", hidden + "p", hidden + "r")
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.col(hidden + "i"), lambda i: F.array(i, i + 1, i + 2)))))
    return df.withColumn("n_repeat_words", F.when(F.col(hidden + "i").isNull(), F.lit(0)).otherwise(covered).cast("long")).drop(hidden + "i")


def with_rates(counted: DataFrame) -> DataFrame:
    """The signals in whole thousandths, so that equal documents compare alike everywhere."""
    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.expr(f"1000 * {part} div {whole}")).otherwise(F.lit(0).cast("long"))

    return counted.withColumns({
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "word_length": share("word_chars", "n_words"),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })


def binomial_tail(n: int, k: int, p: float) -> float:
    """P(X <= k) of a binomial variable, exactly but for rounding."""
    if k >= n:
        return 1.0
    return min(1.0, math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)))


def proven(n: int, k: int, p: float, level: float) -> bool:
    """Whether ``k`` rejections of ``n`` prove, at error ``level``, that the rate is below ``p``: the upper Clopper-Pearson bound is at most p."""
    return n > 0 and binomial_tail(n, k, p) <= level


def over(rung: tuple[int, ...]) -> Column:
    """Whether any signal exceeds the rung's cutoff."""
    out = F.lit(False)
    for s, c in zip(SIGNALS, rung, strict=True):
        out = out | (F.col(s) > c)
    return out


def good_ids(labels: DataFrame, id_col: str) -> DataFrame:
    return labels.where("quality = 1").select(F.col(id_col).alias("_q_id")).where("_q_id is not null").distinct()


def holdout_counts(rated: DataFrame) -> DataFrame:
    """stratum, n, r0, r1, ...: for each stratum the good documents that pass the base rules, and how many of them each rung rejects."""
    return rated.where("not base_failed").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(over(r)).alias(f"r{j}") for j, r in enumerate(LADDER)))


def last_proven(n: int, rejected: list[int], risk: float, level: float) -> int | None:
    """The last rung before the first one that isn't proven."""
    at = None
    for j, k in enumerate(rejected):
        if not proven(n, k, risk, level):
            break
        at = j
    return at


def choose_cutoffs(counts: DataFrame, risk: float = RISK, error: float = ERROR) -> dict[str, tuple[int, ...]]:
    """A rung by stratum. A row for each stratum (language) comes to the driver, none for a document."""
    rows = counts.collect()
    found = {r["stratum"]: last_proven(r["n"], [r[f"r{j}"] for j in range(len(LADDER))], risk, error / max(1, len(rows))) for r in rows}
    return {s: LADDER[j] for s, j in found.items() if j is not None}


def verdict(cutoffs: dict[str, tuple[int, ...]]) -> Column:
    """Whether a document is kept: the base rules and its stratum's rung."""
    bad = F.lit(False)
    for stratum, rung in sorted(cutoffs.items()):
        bad = bad | ((F.col("stratum") == stratum) & over(rung))
    return ~F.col("base_failed") & ~bad


def _named(docs: DataFrame, id_col: str, text_col: str, stratum_col: str, *more: Column) -> DataFrame:
    """Only what is needed, under names that no column of ``docs`` can clash with."""
    return docs.select(F.col(id_col).alias("_q_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.col(text_col).alias("_q_text"), *more)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """id, the base counts, base_failed and kept for every row of ``docs``.

    Null and empty texts fail the base rules; texts of any length are read whole, in memory that grows with their
    words; a null stratum is the one of the empty name; ids that are null or not labelled are judged by cutoffs of
    their stratum; repeated rows are judged each, and equal texts alike; an empty table gives no rows, and with an
    empty table of labels only the base rules count; extra columns aren't read. Signals are written once to the
    shared folder, so that texts are read once.
    """
    require(docs, id_col, text_col, stratum_col)
    require(labels, id_col, "quality")
    rated = with_rates(materialize(signals(_named(docs, id_col, text_col, stratum_col), "_q_text").drop("_q_text"), "signals"))
    cutoffs = choose_cutoffs(holdout_counts(rated.join(good_ids(labels, id_col), "_q_id", "left_semi")), risk, error)
    return rated.select(F.col("_q_id").alias(id_col), *BASE_COLUMNS, "base_failed", verdict(cutoffs).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The rows of ``docs`` that judge() keeps, with their columns, whatever these are called.

    Cutoffs come from the good labelled documents alone (found by a broadcast of their ids; of more than
    MAX_BROADCAST_KEYS, by a join of the signals, which are narrow); one pass over the texts then filters in
    place. No text is shuffled or written; signals of the labelled documents are, to the shared folder. Rows are treated as in judge().
    """
    require(docs, id_col, text_col, stratum_col)
    require(labels, id_col, "quality")
    good = good_ids(labels, id_col)
    named = _named(docs, id_col, text_col, stratum_col)
    few = good.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS
    # written, because a filter on them would copy the signals' expressions, over and over
    held = materialize(signals(named.join(F.broadcast(good), "_q_id", "left_semi") if few else named, "_q_text").drop("_q_text"), "signals")
    cutoffs = choose_cutoffs(holdout_counts(with_rates(held if few else held.join(good, "_q_id", "left_semi"))), risk, error)
    release(held)
    # the row number keeps the optimizer from copying the signals' expressions into the filter, over and over
    whole = _named(docs, id_col, text_col, stratum_col, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_q_whole"))
    rated = with_rates(signals(whole, "_q_text")).withColumn("_q_row", F.monotonically_increasing_id())
    return rated.where(verdict(cutoffs) & (F.col("_q_row") >= 0)).select("_q_whole.*")


def oracle(risk: float = RISK, error: float = ERROR) -> str:
    """DuckDB SQL of judge() over documents and labels."""
    rungs = ", ".join(f"({j}, {', '.join(map(str, r))})" for j, r in enumerate(LADDER))
    any_over = " OR ".join(f"{s} > c{i}" for i, s in enumerate(SIGNALS))
    return f"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i+1, i+2]) AS p FROM rep) GROUP BY rid),
s AS (
  SELECT w.rid, doc_id, stratum, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         len(ls)::BIGINT AS n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (rid)),
r AS (
  SELECT *, CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbol_share, CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_line_share,
         CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeat_share, CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS word_length,
         (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM s),
rungs(j, {", ".join(f"c{i}" for i in range(len(SIGNALS)))}) AS (VALUES {rungs}),
held AS (SELECT r.* FROM r WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
k AS (SELECT stratum, j, count(*) AS n, sum(CASE WHEN {any_over} THEN 1 ELSE 0 END)::BIGINT AS k FROM held CROSS JOIN rungs GROUP BY ALL),
tail AS (
  SELECT stratum, j, least(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk!r}) + (n - i) * ln({1 - risk!r})))) AS p
  FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM k) GROUP BY ALL),
stop AS (SELECT stratum, coalesce(min(CASE WHEN p > {error!r} / (SELECT count(DISTINCT stratum) FROM held) THEN j END), {len(LADDER)}) - 1 AS j FROM tail GROUP BY stratum),
bad AS (SELECT DISTINCT rid FROM r JOIN stop USING (stratum) JOIN rungs USING (j) WHERE {any_over})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND rid NOT IN (SELECT rid FROM bad)) AS kept FROM r"""
