"""Benchmark decontamination, in DataFrame operations only.

The benchmark's word windows are a small table.  A bitmap of their hashes, of bounded size, goes
into the scan as one literal; each text's windows are hashed in place from word hashes by doubling,
and only those whose bit is set leave the row.  These are verified by an exact join on the words,
broadcast if the table of windows is small enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from segrank.llm.common import ascii_lower, keep_or_drop, materialize, require, small_enough

#: What stands between words: ASCII but for digits and letters, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Bits of the filter: 16 or more for each window, between these powers of two.
LEAST_BITS, MOST_BITS = 16, 26


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def with_window_hashes(df: DataFrame, words: str, lengths: list[int]) -> DataFrame:
    """Adds _h<L>: hashes of all windows of L consecutive words, for each L. Lists of 1, 2, 4 and 8 words are joined, one projection each."""
    most = max(lengths)
    df = df.withColumn("_p1", F.transform(F.col(words), lambda w: F.xxhash64(w)))
    have, size = [1], 1

    def joined(left: Column, right: Column, a: int, b: int) -> Column:
        n = F.greatest(F.size(words) - F.lit(a + b - 1), F.lit(0))
        return F.zip_with(F.slice(left, 1, n), F.slice(right, a + 1, n), lambda x, y: F.xxhash64(x, y))

    while size * 2 <= most:
        df = df.withColumn(f"_p{size * 2}", joined(F.col(f"_p{size}"), F.col(f"_p{size}"), size, size))
        size *= 2
        have.append(size)
    for length in lengths:
        rest, built, name = length, 0, ""
        for p in reversed(have):
            if rest >= p:
                if not built:
                    name, built = f"_p{p}", p
                else:
                    df = df.withColumn(f"_j{length}_{built + p}", joined(F.col(name), F.col(f"_p{p}"), built, p))
                    name, built = f"_j{length}_{built + p}", built + p
                rest -= p
        df = df.withColumn(f"_h{length}", F.col(name))
    return df.drop(*(c for c in df.columns if c.startswith(("_p", "_j"))))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """gram, length, hash, items: each distinct window with the items that have it. An item of fewer words, but not none, is one window; null ids and texts have none."""
    require(benchmark, id_col, text_col)
    items = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("_w")).where(F.size("_w") > 0)
    items = items.withColumn("length", F.least(F.size("_w"), F.lit(window)))
    grams = items.select("item", "length", F.explode(F.transform(F.sequence(F.lit(1), F.size("_w") - F.col("length") + 1), lambda i: F.slice("_w", i, F.col("length")))).alias("_w"))
    grams = grams.select("item", "length", "_w", F.array_join("_w", " ").alias("gram"))
    grams = grams.groupBy("gram", "length", "_w").agg(F.collect_set("item").alias("items"))
    return grams


def _bitmap(grams: DataFrame, bits: int) -> str:
    """The words of the bitmap, as a list of numbers; at most 2 to the power of MOST_BITS - 6 of them come to the driver."""
    place = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    rows = grams.select(F.shiftright(place, 6).alias("i"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit")).groupBy("i").agg(F.bit_or("bit").alias("w")).collect()
    words = [0] * (1 << (bits - 6))
    for r in rows:
        words[r["i"]] = r["w"]
    return ",".join(map(str, words))


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """_rid, _id, _tk (hash of the text), n_words, hits ARRAY<STRUCT<pos, length>>, items: one row for each row of ``docs``; pos counts words from 0."""
    require(docs, id_col, text_col)
    found = materialize(benchmark_windows(benchmark, item_col, item_text_col, window), "grams")
    n, lengths = found.count(), sorted(r[0] for r in found.select("length").distinct().collect())
    base = docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_tk"), words_of(F.col(text_col)).alias("_w")).withColumn("n_words", F.size("_w").cast("long"))
    if not n:
        return base.select("_rid", "_id", "_tk", "n_words", F.lit(None).cast("array<struct<pos:int,length:int>>").alias("hits"), F.array().cast("array<string>").alias("items"))
    hashed = None
    for length in lengths:
        part = with_window_hashes(found.where(F.col("length") == length), "_w", [length])
        part = part.select("gram", "items", F.get(f"_h{length}", F.lit(0)).alias("hash"))
        hashed = part if hashed is None else hashed.unionByName(part)
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n - 1).bit_length()))
    bitmap = F.expr(f"cast(split('{_bitmap(hashed, bits)}', ',') as array<bigint>)")  # folded into one literal
    rows = with_window_hashes(base, "_w", lengths)
    mask = F.lit((1 << (bits - 6)) - 1)

    def possible(h: Column) -> Column:
        word = F.get(bitmap, F.shiftright(h, 6).bitwiseAND(mask).cast("int"))
        return F.shiftrightunsigned(word, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))) != 0

    def placed(length: int) -> Column:
        return F.transform(f"_c{length}", lambda i: F.struct(i.alias("pos"), F.lit(length).alias("length"), F.array_join(F.slice("_w", i + 1, length), " ").alias("gram")))

    places = []
    for length in lengths:
        rows = rows.withColumn(f"_c{length}", F.filter(F.transform(f"_h{length}", lambda h, i: F.when(possible(h), i)), lambda i: i.isNotNull())).drop(f"_h{length}")
        places.append(placed(length))
    rows = rows.withColumn("_c", F.concat(*places)).select("_rid", "_id", "_tk", "n_words", F.explode_outer("_c").alias("_c"))
    # texts without a possible hit, most of all, get a key of their own that no window has
    rows = rows.select("_rid", "_id", "_tk", "n_words", "_c.pos", "_c.length", F.coalesce("_c.gram", F.concat(F.lit("\x00"), F.col("_rid").cast("string"))).alias("gram"))
    known = found.select("gram", "items")
    rows = rows.join(F.broadcast(known) if small_enough(known, F.octet_length("gram") + F.lit(32) * F.size("items")) else known, "gram", "left")
    hit = F.when(F.col("items").isNotNull(), F.struct("pos", "length"))
    return rows.groupBy("_rid", "_id", "_tk", "n_words").agg(F.collect_list(hit).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).cast("array<string>").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``.

    Null and empty texts have no words and no hits; texts of any length are scanned whole; windows of several items count
    for each; repeated rows get a row each; an empty table gives no rows, an empty benchmark hits nothing; extra columns
    aren't read, whatever their names.
    """
    h = hits(docs, benchmark, id_col, text_col, item_col, item_text_col, window)
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["pos"], x["pos"] + x["length"] - 1))))
    h = h.withColumn("n_hit", F.coalesce(F.size(covered), F.lit(0)).cast("long")).withColumn("n_hit", F.greatest("n_hit", F.lit(0).cast("long")))
    return h.select(F.col("_id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without a hit, with all columns. A row shares the fate of rows of the same id; rows without an id stay."""
    found = contamination(docs, benchmark, id_col, text_col, **how)
    bad = materialize(found.where("contaminated").select(id_col).distinct(), "contaminated")
    return keep_or_drop(docs, id_col, bad, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with hit words, and what follows each up to the next word, cut out of the text. Rows are told apart by id and text, so repeated ids do no harm; null texts stay null, other columns as they are."""
    found = hits(docs, benchmark, id_col, text_col, **how).where(F.size("hits") > 0)
    found = found.select(F.col("_id").alias("_i"), "_tk", F.flatten(F.transform("hits", lambda x: F.sequence(x["pos"], x["pos"] + x["length"] - 1))).alias("_cut"))
    found = found.groupBy("_i", "_tk").agg(F.array_distinct(F.flatten(F.collect_list("_cut"))).alias("_cut"))
    word = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
    head = F.regexp_extract("_text", rf"^[^0-9A-Za-z\x{{80}}-\x{{10FFFF}}]*", 0)
    pieces = F.regexp_extract_all(F.col("_text"), F.lit(rf"{word}+[^0-9A-Za-z\x{{80}}-\x{{10FFFF}}]*"), 0)
    kept = F.filter(F.transform(pieces, lambda p, i: F.when(~F.array_contains("_cut", i), p)), lambda p: p.isNotNull())
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_whole"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    joined = whole.join(found, whole["_id"].eqNullSafe(found["_i"]) & (whole["_hash"] == found["_tk"]), "left")
    new = F.when(F.col("_cut").isNull(), F.col("_text")).otherwise(F.concat(head, F.array_join(kept, "")))
    return joined.withColumn("_new", new).select(*(F.col("_new").alias(c) if c == text_col else F.col(f"_whole.`{c}`").alias(c) for c in docs.columns))


def oracle(window: int = WINDOW) -> str:
    """DuckDB SQL of contamination() over documents and benchmark."""
    words = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH b AS (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS gram FROM (SELECT item_id, w, least(len(w), {window}) AS l, unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM g),
d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
p AS (SELECT rid, l, i, array_to_string(w[i:i + l - 1], ' ') AS gram FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d CROSS JOIN lens WHERE len(w) >= l)),
h AS (SELECT rid, p.l, i, item_id FROM p JOIN g USING (gram)),
c AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(i, i + l)) AS q FROM (SELECT DISTINCT rid, l, i FROM h)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n, sha256(string_agg(s, ',' ORDER BY s)) AS s FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, coalesce(t.s, sha256('')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)"""
