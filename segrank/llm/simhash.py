"""SimHash near-dedup with pivot distance tables.

Every text becomes a 64-bit fingerprint; equal fingerprints form one class.  For each class a table
holds its Hamming distances to many reference fingerprints.  By the triangle inequality two
fingerprints within ``max_bits`` differ by no more than that in any of these coordinates, so pairs
with a larger difference are discarded and only survivors are verified bit by bit.  Pairs are
looked for inside blocks: of ``max_bits`` + a disjoint bit blocks at least a agree, so every link
shares the values of some a blocks.  Large blocks are cut into chunks, and chunks meet pair by
pair in different tasks.  Only links that join what isn't joined yet leave a task, so a group of
copies gives as many links as members.  Components follow by alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from segrank.llm.common import arrow_rows, materialize, release, require, small_enough, spread_join

WORDS, MAX_BITS, PIVOTS = 4, 4, 32
#: Fingerprints of one block that one task compares with each other; larger blocks are cut.
CHUNK = 2048
#: Rows that the pair search holds at a time.
HELD = 1 << 16
_BITS = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], dtype=np.int64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned SimHash of all shingles, repeats included; zero without words."""
    if not text:
        return 0
    found = text.encode("utf-8").lower().split()  # bytes: A-Z only, and the six ASCII white spaces
    if not found:
        return 0
    line, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return digest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    ones, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 16):
        hashes = np.array([digest(line[s:e], 42) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], dtype="<u8")
        octets = hashes.view(np.uint8).reshape(-1, 8)
        if len(hashes) < 400:
            ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            for k in range(8):
                ones[8 * k : 8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ _BITS
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``id_col``, fp BIGINT: the fingerprint's bits as a signed number."""
    require(docs, id_col, text_col)
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType

    def work(rows):
        for key, text in rows:
            f = fingerprint(text, words)
            yield key, f - (1 << 64) if f >> 63 else f

    return arrow_rows(docs, [id_col, text_col], f"{id_col} {kind.simpleString()}, fp long", work, [id_col, "fp"], [to_arrow_type(kind), pa.int64()])


def references(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints, as signed numbers."""
    return [int(np.uint64(xxhash.xxh64_intdigest(b"reference %d" % i)).astype(np.int64)) for i in range(n)]


def blocks_for(classes: int, max_bits: int = MAX_BITS, cap: int = 5) -> int:
    """How many blocks must agree: more make keys longer and pairs fewer, but copies of each row more."""

    def cost(a: int) -> float:
        keys, bits = comb(max_bits + a, a), 64 * a / (max_bits + a)
        return keys * (40 + classes / 2**bits)

    return min(range(1, cap + 1), key=cost)


def distance_table(classes: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """fp and its distances to all references, eight distances to a BIGINT: d0, d1, ..."""
    refs = references(pivots)
    packed = []
    for k in range(0, pivots, 8):
        c = F.lit(0).cast("long")
        for i, r in enumerate(refs[k : k + 8]):
            c = c.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(r))).cast("long"), 8 * i))
        packed.append(c.alias(f"d{k // 8}"))
    return classes.select("fp", *packed)


def block_keys(table: DataFrame, agree: int, max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each fingerprint and choice of ``agree`` blocks: combo, key, and the table's columns."""
    n = max_bits + agree
    edges = [64 * i // n for i in range(n + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(n)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    choices = F.array(*(F.struct(F.lit(k).alias("combo"), F.col("fp").bitwiseAND(F.lit(signed(sum(masks[i] for i in c)))).alias("key")) for k, c in enumerate(combinations(range(n), agree))))
    return table.withColumn("_b", F.explode(choices)).select("_b.combo", "_b.key", *table.columns)


def _links(batches: Iterator[pa.RecordBatch], max_bits: int, wide: int) -> Iterator[pa.RecordBatch]:
    """Links inside runs of equal (combo, key, lo, hi), as far as they join what this task hasn't joined yet."""
    names = ["combo", "key", "lo", "hi", "chunk", "fp", *(f"d{k}" for k in range(wide))]
    held: list[np.ndarray] | None = None

    def search(cols: list[np.ndarray]) -> pa.RecordBatch:
        combo, key, lo, hi, chunk, fp, *dist = cols
        n = len(fp)
        new = np.ones(n, bool)
        new[1:] = (combo[1:] != combo[:-1]) | (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], n)[np.cumsum(new) - 1]
        nodes, node = np.unique(fp, return_inverse=True)
        parent, label = list(range(len(nodes))), np.arange(len(nodes))
        octets = [d.view(np.uint8).reshape(-1, 8).view(np.int8) for d in dist]
        bits = fp.view(np.uint64)
        out: list[tuple[int, int]] = []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        left, shift = np.arange(n), 0
        while True:
            shift += 1
            left = left[left + shift < stop[left]]
            if not len(left):
                break
            i, j = left, left + shift
            ok = (lo[i] == hi[i]) | (chunk[i] != chunk[j])
            i, j = i[ok], j[ok]
            for o in octets:  # the largest coordinate difference
                if len(i):
                    ok = (np.abs(o[i] - o[j]) <= max_bits).all(axis=1)
                    i, j = i[ok], j[ok]
            ok = np.bitwise_count(bits[i] ^ bits[j]) <= max_bits
            a, b = node[i[ok]], node[j[ok]]
            ok = label[a] != label[b]
            if ok.any():
                for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
                    p, q = root(x), root(y)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        out.append((x, y))
                label = np.array(parent)
                while (up := label[label]) is not None and not np.array_equal(up, label):
                    label = up
                parent[:] = label.tolist()
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(nodes[pairs[:, 0]]), pa.array(nodes[pairs[:, 1]])], names=["a", "b"])

    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if len(held[0]) >= HELD:
            combo, key, lo, hi = held[:4]
            other = np.flatnonzero((combo != combo[-1]) | (key != key[-1]) | (lo != lo[-1]) | (hi != hi[-1]))
            if len(other):
                cut = other[-1] + 1
                yield search([c[:cut] for c in held])
                held = [c[cut:] for c in held]
    if held is not None and len(held[0]):
        yield search(held)


def links(classes: DataFrame, max_bits: int = MAX_BITS, pivots: int = PIVOTS, chunk: int = CHUNK, agree: int | None = None) -> DataFrame:
    """a, b: links that connect all fingerprints of ``classes`` (distinct fp) which links at ``max_bits`` or fewer bits connect."""
    wide = (pivots + 7) // 8
    agree = blocks_for(classes.count(), max_bits) if agree is None else agree
    rows = block_keys(distance_table(classes, pivots), agree, max_bits)
    # blocks are counted before their rows meet; the few large ones are known to every task
    large = rows.groupBy("combo", "key").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("parts")).where("parts > 1")
    large = materialize(large, "large")
    rows = rows.join(F.broadcast(large) if small_enough(large) else large, ["combo", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("combo", "key", F.least("chunk", "with").alias("lo"), F.greatest("chunk", "with").alias("hi"), "chunk", "fp", *(f"d{k}" for k in range(wide)))
    rows = rows.repartition("combo", "key", "lo", "hi").sortWithinPartitions("combo", "key", "lo", "hi")
    return rows.mapInArrow(lambda batches: _links(batches, max_bits, wide), "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of ``edges`` (a, b): alternating large and small stars until nothing changes.

    root is the smallest node of the component. Each round is written to the shared folder; only two numbers come to the driver.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        mark = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        old, e = e, materialize(small, "stars")
        release(old)
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, max_bits: int = MAX_BITS, pivots: int = PIVOTS, chunk: int = CHUNK, agree: int | None = None) -> DataFrame:
    """``id_col``, fingerprint (16 hex digits), component_id: the smallest id that links of ``max_bits`` or fewer differing bits reach.

    Null, empty and blank texts have fingerprint zero and are linked like others. A null id is never
    the smallest, but its row is kept and linked; repeated rows are kept each; an empty table gives no rows; texts of any
    length are read whole; extra columns aren't read, whatever their names.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, words).withColumnRenamed(id_col, "id"), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    found = components(links(classes.select("fp"), max_bits, pivots, chunk, agree))
    smallest = found.join(classes, found["node"] == classes["fp"]).groupBy("root").agg(F.min("first").alias("least"))
    named = found.join(smallest, "root").select("node", "least")
    whole = classes.join(named, classes["fp"] == named["node"], "left").select("fp", "n", F.coalesce("least", "first").alias("component_id"))
    out = spread_join(fps, whole, ["fp"], "id").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows whose id is the smallest of its component, with all columns; rows without an id stay."""
    from segrank.llm.common import keep_or_drop

    found = near_duplicates(docs, id_col, text_col, **how)
    worse = materialize(found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "worse")
    return keep_or_drop(docs, id_col, worse, "left_anti")
