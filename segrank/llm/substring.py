"""Substring dedup: FM-indexes of shards, through which documents are streamed.

Texts are cut into runs of consecutive windows that share the smallest hash of their four-word pieces, so
equal windows always meet in the shard of that hash and every document goes only to the shards of
its own runs.  A shard's runs make a compressed FM-index over words: suffixes sorted to the depth of
a window, the Burrows-Wheeler transform in a wavelet matrix of packed bits with rank counts.  All
windows are searched backward at once, word by word; a window whose suffix interval holds a document
of a smaller id is a repeat.  Runs that a task has met before in a smaller document are repeats at
once and needn't travel; the others travel packed, a compressed block for each shard and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from segrank.llm.common import require

WINDOW = 13
#: Words of one FM-index, and runs that a task remembers.
SHARD_WORDS, SEEN = 60_000, 400_000
#: Bytes of runs that a task holds before it packs them; input bytes of a shard, more for more input, between these; shards at least.
PACK_BYTES, LEAST_SHARD, MOST_SHARD, LEAST_SHARDS = 32 << 20, 8 << 20, 64 << 20, 24
#: Tasks that search, at most; of more shards a task takes several, one after the other.
MOST_TASKS = 1 << 16


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").split()


def window_keys(words: list[bytes], window: int) -> np.ndarray:
    """For each window the smallest hash of its four neighbouring words; shorter ones would be shared by chance."""
    if window < 4:
        raise ValueError("a window has four words or more")

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            g = a * np.uint64(0x9E3779B97F4A7C15) ^ (b >> np.uint64(29)) ^ b * np.uint64(0xC2B2AE3D27D4EB4F)
            g ^= g >> np.uint64(32)
            return g * np.uint64(0xD6E8FEB86659FD93)

    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    pairs = joined(h[:-1], h[1:])
    g = joined(pairs[:-2], pairs[2:])
    span, have = window - 3, 1  # fours in a window; minima of 1, 2, 4, ... neighbours
    while have * 2 <= span:
        g = np.minimum(g[:-have], g[have:])
        have *= 2
    return np.minimum(g[: len(g) - (span - have)], g[span - have :]) if span > have else g


def merged(starts: np.ndarray, stops: np.ndarray) -> Iterator[tuple[int, int]]:
    """Sorted intervals joined where they touch."""
    a = b = -1
    for s, e in zip(starts.tolist(), stops.tolist(), strict=True):
        if s > b:
            if b >= 0:
                yield a, b
            a, b = s, e
        else:
            b = max(b, e)
    if b >= 0:
        yield a, b


def pack(columns: list[list[int]], seqs: list[bytes] | None) -> bytes:
    """doc, tk, at, stop and, for runs to be compared, half of the key's bits and the words; of words none holds a line end.

    Documents are written as differences and ends as lengths, which compress to less.
    """
    doc, tk, at, stop, *m = columns
    starts = np.array(at, np.int32)
    parts = [np.array([len(doc), seqs is not None], np.int64), np.diff(np.array(doc, np.int64), prepend=0), np.array(tk, np.int64), starts, np.array(stop, np.int32) - starts]
    if seqs is not None:
        parts.append(np.array(m[0], np.uint32))
    return zstandard.ZstdCompressor(level=6).compress(b"".join(x.tobytes() for x in parts) + (b"\n".join(seqs) if seqs is not None else b""))


def unpack(block: bytes) -> tuple[list[np.ndarray], list[bytes] | None]:
    data = zstandard.ZstdDecompressor().decompress(block)
    n, full = np.frombuffer(data, np.int64, 2).tolist()
    columns, at = [], 16
    for kind in (np.int64, np.int64, np.int32, np.int32, *([np.uint32] if full else [])):
        columns.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    columns[0], columns[3] = np.cumsum(columns[0]), columns[2] + columns[3]
    return columns, data[at:].split(b"\n") if full else None


def _cut(batches: Iterator[pa.RecordBatch], window: int, shards: int) -> Iterator[pa.RecordBatch]:
    """(shard, block): packed runs to be compared, and packed repeats already known."""
    seen: dict[int, int] = {}
    runs: dict[int, tuple[list[list[int]], list[bytes]]] = {}
    known: dict[int, list[list[int]]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for shard, (columns, seqs) in runs.items():
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([pack(columns, seqs)], pa.binary())], names=["shard", "block"])
        for shard, columns in known.items():
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([pack(columns, None)], pa.binary())], names=["shard", "block"])
        runs.clear()
        known.clear()

    for b in batches:
        for k in range(b.num_rows):
            doc, tk, words = b.column(0)[k].as_py(), b.column(1)[k].as_py(), split_words(b.column(2)[k].as_py())
            if len(words) < window:
                continue
            keys = window_keys(words, window)
            begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            stop = np.append(begin[1:], len(keys)) + window - 1  # in words
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            froms = np.concatenate(([0], ends[:-1] + 1))[begin].tolist()
            to, half = (keys[begin] % np.uint64(shards)).tolist(), (keys[begin] >> np.uint64(32)).tolist()
            old = np.zeros(len(begin), bool)
            for i, (s, e, at, until) in enumerate(zip(froms, ends[stop - 1].tolist(), begin.tolist(), stop.tolist(), strict=True)):
                seq = line[s:e]
                d = xxhash.xxh3_128_intdigest(seq)
                first = seen.get(d)
                if first is not None and first < doc:
                    old[i] = True
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen[d] = doc
                columns, seqs = runs.setdefault(to[i], ([[], [], [], [], []], []))
                for c, v in zip(columns, (doc, tk, at, until, half[i]), strict=True):
                    c.append(v)
                seqs.append(seq)
                held += e - s + 200
            if old.any():
                columns = known.setdefault(doc % shards, [[], [], [], []])
                for a, e in merged(begin[old], stop[old]):
                    for c, v in zip(columns, (doc, tk, a, e), strict=True):
                        c.append(v)
            if held >= PACK_BYTES:
                yield from flush()
                held = 0
    yield from flush()


class WaveletMatrix:
    """Ranks of symbols in prefixes of a sequence, over packed bits with a count before each 64-bit word."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level & 1).astype(np.uint8)
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.bits.append(words)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1])))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate((now[bit == 0], now[bit == 1]))
        self.start = self._walk(np.arange(size), np.zeros(size, np.int64))

    def _walk(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = places >> 6
            ones = self.before[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)))
            places = np.where(symbols >> level & 1, self.zeros[k] + ones, places - ones)
        return places

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._walk(symbols, places) - self.start[symbols]


class FMIndex:
    """Over word sequences, each followed by a 0; searches patterns of up to ``depth`` words."""

    def __init__(self, text: np.ndarray, size: int, depth: int):
        rank, step = text.astype(np.int64), 1
        while step < depth:
            ahead = np.zeros_like(rank)
            ahead[:-step] = rank[step:]
            rank = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)[1]
            step *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        self.count = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))
        self.bwt = WaveletMatrix(text[self.suffixes - 1], size)

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search, for many patterns at once."""
        return self.count[symbols] + self.bwt.rank(symbols, low), self.count[symbols] + self.bwt.rank(symbols, high)


def matching_statistics(fm: FMIndex, stream: np.ndarray, ends: np.ndarray, depth: int, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many words of ``stream`` up to each end, ``depth`` at most, the index holds in more than ``least`` places.

    All ends are searched backward together, and each drops out where its match ends. With the
    statistics come the suffix intervals (low, high) of the ends that reach ``depth``, in their order.
    """
    reached, alive = np.zeros(len(ends), np.int64), np.arange(len(ends))
    c = stream[ends]
    low, high = fm.count[c], fm.count[c + 1]
    for n in range(1, depth + 1):
        ok = high - low > least
        alive, low, high = alive[ok], low[ok], high[ok]
        reached[alive] = n
        if n == depth or not len(alive):
            break
        low, high = fm.extend(stream[ends[alive] - n], low, high)
    return reached, low, high


def repeats(runs: list[tuple[int, list[bytes]]], window: int, index_of: list[int] | None = None) -> list[np.ndarray]:
    """For each run (doc, words): the window starts whose words also start in a smaller document of the indexed runs.

    ``index_of``: the numbers of the runs that the index is built of; all if None.
    """
    ids: dict[bytes, int] = {}
    coded = [np.array([ids.setdefault(w, len(ids) + 1) for w in words], np.int64) for _, words in runs]
    zero = np.zeros(1, np.int64)
    chosen = range(len(runs)) if index_of is None else index_of
    text = np.concatenate([x for i in chosen for x in (coded[i], zero)])
    docs = np.repeat([runs[i][0] for i in chosen], [len(coded[i]) + 1 for i in chosen])
    fm = FMIndex(text, len(ids) + 1, window)
    owner = docs[fm.suffixes]
    stream = np.concatenate(coded)
    sizes = np.array([len(x) - window + 1 for x in coded])
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in coded])))[:-1]
    which = np.repeat(np.arange(len(runs)), sizes)
    local = np.arange(len(which)) - np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    place, own = offsets[which] + local, np.array([d for d, _ in runs])[which]
    least = 1 if index_of is None else 0  # an interval that holds the window itself only
    reached, low, high = matching_statistics(fm, stream, place + window - 1, window, least)
    alive = np.flatnonzero(reached == window)
    hit = np.zeros(len(which), bool)
    if len(alive):
        lows, back = np.unique(low, return_inverse=True)  # at full depth an interval is known by its beginning
        highs = np.zeros(len(lows), np.int64)
        highs[back] = high
        edges = np.column_stack((lows, highs)).ravel()
        smallest = np.minimum.reduceat(np.append(owner, np.iinfo(np.int64).max), edges)[::2]
        hit[alive] = smallest[back] < own[alive]
    return _by_run(which, local, hit, len(runs))


def _by_run(which: np.ndarray, local: np.ndarray, hit: np.ndarray, n: int) -> list[np.ndarray]:
    return np.split(local[hit], np.cumsum(np.bincount(which[hit], minlength=n))[:-1])


def _search(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Repeated intervals (doc, tk, at, stop) of blocks sorted by shard."""
    out: list[tuple] = []

    def search(chosen: list[tuple]) -> None:
        total = sum(len(r[3]) for r in chosen)
        runs = [(r[0], r[3]) for r in chosen]
        if total <= 8 * SHARD_WORDS:
            found = [repeats(runs, window)]
        else:  # one group of many different runs: an index for each part of it, all runs through each
            found, part, size = [], [], 0
            for i, (_, words) in enumerate(runs):
                part.append(i)
                size += len(words)
                if size >= 4 * SHARD_WORDS or i == len(runs) - 1:
                    for at in range(0, len(runs), 20_000):
                        some = list(range(at, min(len(runs), at + 20_000)))
                        sub = [runs[k] for k in part] + [runs[k] for k in some]
                        got = repeats(sub, window, list(range(len(part))))[len(part) :]
                        for k, starts in zip(some, got, strict=True):
                            if len(starts):
                                out.extend((chosen[k][0], chosen[k][1], chosen[k][2] + a, chosen[k][2] + b) for a, b in merged(starts, starts + window))
                    part, size = [], 0
        for result in found:
            for r, starts in zip(chosen, result, strict=True):
                if len(starts):
                    out.extend((r[0], r[1], r[2] + a, r[2] + b) for a, b in merged(starts, starts + window))

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc", "tk", "at", "stop"])
        out.clear()
        return made

    def shard(blocks: list[tuple[list[np.ndarray], list[bytes]]]) -> Iterator[pa.RecordBatch]:
        doc, tk, at, stop, m = (np.concatenate([c[i] for c, _ in blocks]) for i in range(5))
        seqs = [s for _, x in blocks for s in x]
        order = np.lexsort((doc, m))
        m, doc = m[order], doc[order]
        new = np.concatenate(([True], m[1:] != m[:-1]))
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(m)) - 1
        shared = np.repeat(doc[begin] < doc[last], last - begin + 1)  # keys of one document are no repeats
        rows: list[tuple] = []  # (doc, tk, at, words)
        group: dict[int, int] = {}  # digest to the smallest document of the group's distinct runs
        held = 0
        for i in np.flatnonzero(shared).tolist():
            if new[i]:
                if held >= SHARD_WORDS:
                    search(rows)
                    rows, held = [], 0
                group = {}
            k = int(order[i])
            seq = seqs[k]
            d = xxhash.xxh3_128_intdigest(seq)
            if group.setdefault(d, int(doc[i])) < doc[i]:
                out.append((int(doc[i]), int(tk[k]), int(at[k]), int(stop[k])))
            else:
                words = seq.split(b" ")
                rows.append((int(doc[i]), int(tk[k]), int(at[k]), words))
                held += len(words)
            if len(out) >= 4096:
                yield batch()
        if rows:
            search(rows)

    now, blocks = None, []
    for b in batches:
        for number, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            columns, seqs = unpack(block)
            if seqs is None:
                out.extend(zip(*(c.tolist() for c in columns), strict=True))
            else:
                if number != now and blocks:
                    yield from shard(blocks)
                    blocks = []
                now = number
                blocks.append((columns, seqs))
        if out:
            yield batch()
    if blocks:
        yield from shard(blocks)
    if out:
        yield batch()


def shards_for(docs: DataFrame) -> tuple[int, int]:
    """Shards, and tasks to deal them to, by the planner's estimate of the input's bytes; any numbers give the same result.

    Without an estimate there are as many tasks as the session has shuffle partitions. Estimates of joins can be far too large: write such inputs first.
    """
    size = float(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > 1e17:  # the planner doesn't know
        return 4096, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = int(min(1 << 22, max(LEAST_SHARDS, size / min(MOST_SHARD, max(LEAST_SHARD, size / 2000)))))
    return shards, min(shards, MOST_TASKS)


def repeated_intervals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc, tk, cuts ARRAY<STRUCT<at, stop>>: word intervals covered by windows that start in a smaller document too."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("text"))
    shards, tasks = shards_for(docs)
    blocks = rows.mapInArrow(lambda b: _cut(b, window, shards), "shard int, block binary")
    # by number, not by hash: no two shards meet in a task by chance, and tasks grow in number with the input
    blocks = blocks.repartitionById(tasks, F.pmod("shard", F.lit(tasks))).sortWithinPartitions("shard")
    found = blocks.mapInArrow(lambda b: _search(b, window), "doc long, tk long, at int, stop int")
    return found.groupBy("doc", "tk").agg(F.collect_list(F.struct("at", "stop")).alias("cuts"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_removed, kept (the words that stay, joined by spaces), kept_sha256 for every row of ``docs``.

    Null, empty and short texts keep all words; ids are whole numbers, rows that repeat an id are one document
    (their repeats of each other don't count), and a row without an id is kept whole and isn't held against
    others; extra columns aren't read.
    """
    require(docs, id_col, text_col)
    cuts = repeated_intervals(docs, id_col, text_col, window)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("_tk"), F.col(text_col).alias("text"))
    rows = rows.join(cuts, (F.col("id") == F.col("doc")) & (F.col("_tk") == F.col("tk")), "left").select("id", "text", "cuts")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out: list[tuple] = []
                for key, text, cut in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    words = split_words(text)
                    n = len(words)
                    if cut:
                        keep = np.ones(n, bool)
                        for c in cut:
                            keep[c["at"] : c["stop"]] = False
                        words = [words[i] for i in np.flatnonzero(keep).tolist()]
                    kept = b" ".join(words)
                    out.append((key, n, n - len(words), kept.decode("utf-8"), hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=[id_col, "n_words", "n_removed", "kept", "kept_sha256"])

    return rows.mapInArrow(finish, f"{id_col} long, n_words long, n_removed long, kept string, kept_sha256 string")


def oracle(window: int = WINDOW) -> str:
    """DuckDB SQL of the counts and digests of remove_repeats() over documents with distinct ids."""
    return f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {window - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d WHERE len(w) >= {window})),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS f FROM g) WHERE f < doc_id),
x AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + {window})) AS p FROM r)),
k AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS s, count(*) AS n FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS t FROM d) LEFT JOIN x USING (doc_id, p) WHERE x.p IS NULL GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
