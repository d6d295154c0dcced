"""URL filters, in DataFrame operations only.

A URL's possible rules are its host's suffixes at label boundaries, joined with the prefixes of its
path that are as long as some rule's path.  A blocked Bloom filter of the listed canonical rules
lets possible hits through; an exact hash join with the list removes false positives, and the
longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from segrank.llm.common import ascii_lower, require, small_enough

#: The rules of the contract, as (rule, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Filter bits for each listed rule, and 64-bit blocks at most (8 MB).
BITS_PER_RULE, MOST_BLOCKS = 16, 1 << 20
#: Possible hits of one URL up to which they are looked up one after another in its row.
MOST_LOOKUPS = 12


def host_of(url: Column) -> Column:
    """What follows the first ://, up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(blocks - 1)).cast("int")


def _mask(key: Column) -> Column:
    """Four bits of one block, from a second hash."""
    h = F.xxhash64(key, F.lit(1))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))


def bloom(rules: DataFrame, n: int) -> tuple[Column, int]:
    """The filter as one literal and its number of blocks, a power of two. At most MOST_BLOCKS numbers come to the driver."""
    blocks = min(MOST_BLOCKS, 1 << max(0, (n * BITS_PER_RULE // 64 - 1).bit_length()))
    words = [0] * blocks
    for r in rules.select(_block(F.col("rule"), blocks).alias("b"), _mask(F.col("rule")).alias("m")).groupBy("b").agg(F.bit_or("m").alias("m")).collect():
        words[r["b"]] = r["m"]
    return F.expr(f"cast(split('{','.join(map(str, words))}', ',') as array<bigint>)"), blocks


def listed(spark: SparkSession, rules=RULES) -> DataFrame:
    """rule, verdict from pairs; a rule is a host and, from the first slash, a path."""
    values = ", ".join("('" + r.replace("'", "''") + f"', '{v}')" for r, v in rules)
    return spark.sql(f"SELECT * FROM VALUES {values} AS r(rule, verdict)")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule, verdict for every row of ``pages``.

    ``rules``: rule, verdict. A rule fits its host and all subdomains if the path starts with the rule's; the
    longest rule wins, of equally long ones the longer host, then the last in order; of a rule listed twice,
    block wins. URLs that no rule fits get ``default``. Null URLs and such without :// have empty host and path.
    Repeated rows get a row each; an empty list leaves the default, an empty table gives no rows; URLs of any length are
    read whole; extra columns aren't read, whatever their names. A rule without a slash is an error.

    A list that may be broadcast is looked up in the rows, the longest possible hit first, so pages aren't shuffled; else
    possible hits are joined with the list by a shuffle, once for each distinct host and path.
    """
    require(pages, id_col, url_col)
    require(rules, "rule", "verdict")
    slash = F.instr("rule", "/")
    if bad := [r[0] for r in rules.where(F.col("rule").isNull() | (slash == 0)).limit(5).collect()]:
        raise ValueError(f"rules without a slash: {bad}")
    known = rules.groupBy("rule").agg(F.max("verdict").alias("verdict"))
    n = known.count()
    rows = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not n:
        return rows.select(F.col("_id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    lengths = sorted(r[0] for r in known.select((F.length("rule") - slash + 1).alias("n")).distinct().collect())  # as many as paths have lengths
    words, blocks = bloom(known, n)

    def possible(key: Column) -> Column:
        return F.get(words, _block(key, blocks)).bitwiseAND(_mask(key)) == _mask(key)

    def with_tries(urls: DataFrame) -> DataFrame:
        """Adds _k: the possible hits, best first."""
        suffixes = F.transform(F.sequence(F.lit(1), F.size("_l")), lambda i: F.array_join(F.slice("_l", i, F.size("_l")), "."))
        urls = urls.withColumn("_l", F.split("host", r"\.")).withColumn("_s", suffixes).withColumn("_p", F.filter(F.array(*(F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths)), lambda p: p.isNotNull()))
        urls = urls.withColumn("_k", F.filter(F.flatten(F.transform("_s", lambda s: F.transform("_p", lambda p: F.concat(s, p)))), possible))
        ordered = F.sort_array(F.transform("_k", lambda k: F.struct(F.length(k).alias("n"), F.instr(k, "/").alias("h"), k.alias("k"))), False)
        return urls.withColumn("_k", F.when(F.size("_k") > 1, F.transform(ordered, lambda x: x["k"])).otherwise(F.col("_k"))).drop("_l", "_s", "_p")

    if small_enough(known, F.octet_length("rule")):
        tried = with_tries(rows)
        most = tried.agg(F.max(F.size("_k"))).first()[0] or 0
        if most <= MOST_LOOKUPS:
            for i in range(most):  # the first that is listed wins; all but the first matter for false positives alone
                one = F.broadcast(known.select(F.col("rule").alias(f"_r{i}"), F.col("verdict").alias(f"_v{i}")))
                tried = tried.join(one, F.get("_k", F.lit(i)) == F.col(f"_r{i}"), "left")
            first = lambda c, *end: F.coalesce(*(F.col(f"{c}{i}") for i in range(most)), *end)
            rule = first("_r") if most else F.lit(None).cast("string")
            return tried.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), first("_v", F.lit(default)).alias("verdict"))
    tries = with_tries(rows.select("host", "path").distinct()).select("host", "path", F.explode("_k").alias("rule"))
    hit = tries.join(known, "rule")
    order = F.struct(F.length("rule").alias("n"), F.instr("rule", "/").alias("h"), F.col("rule"))
    best = hit.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), order).alias("_b"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select(F.col("_id").alias(id_col), "host", "path", F.col("_b.rule").alias("rule"), F.coalesce("_b.verdict", F.lit(default)).alias("verdict"))


def oracle(rules=RULES, default: str = "allow") -> str:
    """DuckDB SQL of judge_urls() over pages."""
    values = ", ".join(f"('{r}', '{v}')" for r, v in rules)
    host = "translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH rules(rule, verdict) AS (VALUES {values}),
r AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rh, substr(rule, instr(rule, '/')) AS rp FROM rules),
p AS (SELECT row_number() OVER () AS rid, page_id, {host} AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
b AS (SELECT rid, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, '{default}') AS verdict FROM p LEFT JOIN b USING (rid)"""
