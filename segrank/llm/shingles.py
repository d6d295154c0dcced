"""Near copies by exact similarity of five-word shingles, at any distance of their fingerprints.

Two documents are linked if the Jaccard similarity of their sets of shingles is 4/5 or more.  Every
such pair is found: in any one order of all shingles, the first n - ceil(4n/5) + 1 of a document's n
shingles hold one that the other document's first ones hold too.  The order takes shingles that are
rare in a sample of the documents first, so that passages in many documents make no pairs; the
sample decides on the cost, never on the result.  Exact copies go first; then the fingerprints'
links (blocks and pivots of operator 1, on five words) join groups of near copies, and only
documents that aren't joined yet are compared pair by pair.  Sketches discard pairs without loss:
bits of a sketch are parities of shingles, so two sketches differ in no more bits than the sets in
shingles, and sets of similarity 4/5 differ in a ninth of their sizes' sum at most.  Each link left
is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from segrank.llm import simhash
from segrank.llm.common import arrow_rows, keep_or_drop, materialize, release, require

WORDS = 5
#: Documents in SAMPLE give their shingles to be counted; those met FREQUENT times or more, COUNTED at most, come last in the order.
SAMPLE, FREQUENT, COUNTED = 8, 3, 200_000
#: 64-bit words of a sketch in each row, and of one that pairs are verified by first; powers of two.
WIDE, LONG = 8, 64
_ODD = [xxhash.xxh64_intdigest(b"place %d" % k) | 1 for k in range(WORDS)]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; shorter texts are one shingle, texts without words none."""
    found = (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, and the six ASCII white spaces
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 42)], np.uint64)
    digest = xxhash.xxh64_intdigest
    words = np.fromiter(map(digest, found), np.uint64, len(found))
    n = len(words) - WORDS + 1
    h = np.zeros(n, np.uint64)
    for k, c in enumerate(_ODD):
        h += words[k : k + n] * np.uint64(c)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of 4/5 or more, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def sketch(own: np.ndarray, wide: int = WIDE) -> list[int]:
    """Parities of the shingles by hash, 64 bits to a signed number."""
    bits = np.bincount((own >> np.uint64(65 - (64 * wide).bit_length())).astype(np.int64), minlength=64 * wide) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def prefix(own: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, by count in the sample and hash."""
    n = len(own)
    size = n - (4 * n + 4) // 5 + 1
    if not len(tokens):
        return own[:size]
    at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
    met = np.where(tokens[at] == own, counts[at], 0)
    return own[np.argsort(met, kind="stable")[:size]]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                yield key, shingles(text)


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in the sample, and their counts; COUNTED rows at most come to the driver."""

    def run(batches):
        for b in batches:
            out = [own for _, own in _texts(iter([b]))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["token"])

    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).mapInArrow(run, "token long")
    found = some.groupBy("token").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "token").limit(COUNTED).toArrow()
    tokens, counts = (found.column(i).to_numpy().astype(np.int64) for i in range(2))
    order = np.argsort(tokens.view(np.uint64))
    return tokens.view(np.uint64)[order], counts[order]


def _prefixes(docs: DataFrame) -> DataFrame:
    """id, size, token: a row for each shingle of each document's prefix."""
    tokens, counts = _frequent(docs)

    def run(batches):
        for b in batches:
            ids, sizes, first = [], [], []
            for key, own in _texts(iter([b])):
                if len(own):
                    p = prefix(own, tokens, counts)
                    ids.append(np.full(len(p), key, np.int64))
                    sizes.append(np.full(len(p), len(own), np.int32))
                    first.append(p)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(first).view(np.int64))], names=["id", "size", "token"])

    return docs.mapInArrow(run, "id long, size int, token long")


def _compared(pairs: DataFrame, docs: DataFrame, make: Callable[[np.ndarray], bytes], alike: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The pairs (a, b) that are alike by what is made of the sets of the documents in them."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "met")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                made = [make(shingles(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["id", "own"])

    made = materialize(keep_or_drop(docs, "id", ids, "left_semi").select("id", "text").mapInArrow(run, "id long, own binary"), "made")

    def compare(rows):
        for a, b, x, y in rows:
            if alike(x, y):
                yield a, b

    joined = pairs.join(made.select(F.col("id").alias("a"), F.col("own").alias("x")), "a").join(made.select(F.col("id").alias("b"), F.col("own").alias("y")), "b")
    out = materialize(arrow_rows(joined, ["a", "b", "x", "y"], "a long, b long", compare, ["a", "b"], [pa.int64(), pa.int64()]), "alike")
    release(ids)
    release(made)
    return out


def _long_sketch(own: np.ndarray) -> bytes:
    return len(own).to_bytes(8, "little") + np.array(sketch(own, LONG)).tobytes()


def _maybe(x: bytes, y: bytes) -> bool:
    differ = int(np.bitwise_count(np.frombuffer(x, np.uint64, offset=8) ^ np.frombuffer(y, np.uint64, offset=8)).sum())
    return 9 * differ <= int.from_bytes(x[:8], "little") + int.from_bytes(y[:8], "little")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar; long sketches come first, so that few whole sets are dealt out."""
    likely = _compared(pairs, docs, _long_sketch, _maybe)
    return _compared(likely, docs, np.ndarray.tobytes, lambda x, y: similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))


def _open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs inside runs of equal (token, lo, hi) of different groups and of sizes and sketches that can be similar."""
    names = ["token", "lo", "hi", "chunk", "id", "size", "group", *(f"s{k}" for k in range(WIDE))]
    held: list[np.ndarray] | None = None

    def search(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, lo, hi, chunk, ids, size, group, *bits = cols
        n = len(token)
        new = np.ones(n, bool)
        new[1:] = (token[1:] != token[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        stop = np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1]
        left, shift = np.arange(n), 0
        while True:
            shift += 1
            left = left[left + shift < stop[left]]
            if not len(left):
                return
            i, j = left, left + shift
            small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            ok = ((lo[i] == hi[i]) | (chunk[i] != chunk[j])) & (group[i] != group[j]) & (5 * small >= 4 * large)
            i, j = i[ok], j[ok]
            if len(i):
                ok = 9 * sum(np.bitwise_count(b[i] ^ b[j]).astype(np.int64) for b in (c.view(np.uint64) for c in bits)) <= size[i] + size[j]
                i, j = i[ok], j[ok]
            if len(i):
                x, y = ids[i], ids[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if len(held[0]) >= simhash.HELD:
            other = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1]))
            if len(other):
                cut = other[-1] + 1
                yield from search([c[:cut] for c in held])
                held = [c[cut:] for c in held]
    if held is not None and len(held[0]):
        yield from search(held)


def _grouped(edges: DataFrame) -> DataFrame:
    found = simhash.components(edges)
    return materialize(found.select(F.col("node").alias("id"), F.col("root").alias("group")), "groups")


def _possible(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches may belong to similar sets."""
    for c in ("a", "b"):
        pairs = pairs.join(seen.select(F.col("id").alias(c), F.col("size").alias(f"{c}_size"), *(F.col(f"s{k}").alias(f"{c}_s{k}") for k in range(WIDE))), c)
    differ = sum((F.bit_count(F.col(f"a_s{k}").bitwiseXOR(F.col(f"b_s{k}"))) for k in range(WIDE)), F.lit(0))
    return pairs.where(9 * differ <= F.col("a_size") + F.col("b_size")).select("a", "b")


def _links(docs: DataFrame, seen: DataFrame, chunk: int = simhash.CHUNK) -> DataFrame:
    """id, group: the members of groups of two or more that verified links connect. ``docs``: id, text of distinct contents; ``seen``: their ids, fingerprints, sizes and sketches."""
    fps = seen.select("id", "fp")
    shared = _prefixes(docs).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("n > 1")
    shared = materialize(shared, "shared")
    # a few links for each shingle and fingerprint join most of each group
    stars = shared.withColumn("a", F.min("id").over(Window.partitionBy("token"))).where("a <> id").select("a", F.col("id").alias("b"))
    classes = materialize(fps.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    ends = lambda c: classes.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_id"))
    same = fps.join(classes, "fp").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    far = simhash.links(classes.select("fp")).join(ends("a"), "a").join(ends("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = _verified(materialize(_possible(ordered(stars.unionByName(same).unionByName(far)).distinct(), seen), "pairs"), docs)
    groups = _grouped(first)
    # all other pairs of different groups
    rows = shared.join(seen.drop("size", "fp").join(groups, "id", "left"), "id").withColumn("group", F.coalesce("group", "id"))
    rows = rows.withColumns({"parts": F.ceil(F.col("n") / F.lit(chunk)).cast("int")}).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("token", F.least("chunk", "with").alias("lo"), F.greatest("chunk", "with").alias("hi"), "chunk", "id", "size", "group", *(f"s{k}" for k in range(WIDE)))
    rows = rows.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")
    rest = materialize(rows.mapInArrow(_open_pairs, "a long, b long").distinct(), "pairs")
    rest = rest.join(first, ["a", "b"], "left_anti")
    return _grouped(first.unionByName(_verified(rest, docs)))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is the smallest of those that links of similarity 4/5 or more connect, with all columns.

    ``id_col`` is a BIGINT key. Texts without words are copies of each other. Rows without an id stay and link nothing.
    """
    require(docs, id_col, text_col)
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")

    def read(rows):
        for key, text in rows:
            found = (text or "").encode("utf-8").lower().split()
            f, own = simhash.fingerprint(text, WORDS), shingles(text)
            yield key, xxhash.xxh3_128_digest(b" ".join(found)), f - (1 << 64) if f >> 63 else f, len(own), *sketch(own)

    names = ["id", "digest", "fp", "size", *(f"s{k}" for k in range(WIDE))]
    schema = ", ".join(f"{c} {'binary' if c == 'digest' else 'long'}" for c in names)
    seen = materialize(arrow_rows(named, ["id", "text"], schema, read, names, [pa.binary() if c == "digest" else pa.int64() for c in names]), "contents")
    worse = materialize(seen.groupBy("digest").agg(F.min("id").alias("least")).join(seen, "digest").where("id <> least").select("id").distinct(), "copies")
    rest = materialize(keep_or_drop(named, "id", worse, "left_anti"), "single")
    groups = _links(rest, materialize(keep_or_drop(seen.drop("digest"), "id", worse, "left_anti"), "sketches"))
    near = groups.where("id <> group").select("id")
    gone = materialize(near.unionByName(worse), "worse")
    return keep_or_drop(docs, id_col, gone, "left_anti")
