"""BPE encoding and decoding as streaming transducers with bounded lookahead.

A merge list decides whether two neighbouring tokens join by looking only a bounded number of
bytes to the right: :func:`sufficient_lookahead` computes that number from the merge list.  The
encoder holds a window of bytes; a token is emitted as soon as at least that many bytes stand
behind its end, because no later byte can change it, and the window restarts at its end (the
tokens of a text behind a token boundary are those of the rest alone).  Memory is constant for
however long a pre-token.  Decoding turns ids into bytes and bytes into text with an incremental
UTF-8 state machine, block by block.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from segrank.llm.common import arrow_rows, require

#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text taken at a time, and bytes of window besides the lookahead.
CHUNK, WINDOW = 1 << 16, 4096
#: Distinct pre-tokens whose ids are remembered by one worker.
CACHE = 500_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def sufficient_lookahead(merges: list[tuple[int, int, int]], length: list[int]) -> int:
    """Bytes behind a boundary after which no byte can change whether a merge crosses it.

    The merge (x, y) of some rank depends on y not being taken from the right: y itself, or the last
    part s of what y is made of, may go into an earlier merge (s, z), and that in turn depends on z.
    Ranks fall along such a chain, so the longest one follows by dynamic programming in rank order.
    """
    made: dict[int, tuple[int, int]] = {}
    left: dict[int, tuple[list[int], list[int]]] = {}
    most = 1
    for rank, (x, y, new) in enumerate(merges):
        best, s, limit = length[y], y, rank
        while True:
            if s in left:
                ranks, reach = left[s]
                if i := bisect_left(ranks, limit):
                    best = max(best, length[y] + reach[i - 1])
            if s not in made:
                break
            limit, s = made[s]
        made.setdefault(new, (rank, y))
        ranks, reach = left.setdefault(x, ([], []))
        ranks.append(rank)
        reach.append(max(best, reach[-1]) if reach else best)
        most = max(most, best)
    return most


class Pieces(dict):
    """A chunk of text to its ids: the young half of a cache of bounded size; when it is full it becomes the old half."""

    def __init__(self, encoder: Encoder, limit: int):
        self.encoder, self.limit, self.old = encoder, limit // 2, {}

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = self.old.get(chunk)
        if ids is None:
            e = self.encoder
            parts = e.pattern.findall(chunk)
            ids = tuple(map(e.same.__getitem__, e.transduce([chunk.encode("utf-8")]))) if len(parts) < 2 else tuple(chain.from_iterable(map(self.__getitem__, parts)))
        if len(chunk) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """A byte-level BPE vocabulary with its transducers. ``path``: the tokenizer's JSON file."""

    def __init__(self, path: str, window: int = WINDOW, cache: int = CACHE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(alphabet[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.bytes[i] = token.encode("utf-8")
        self.decimal = [str(i) for i in range(size)]
        self.same = list(range(size))  # one object for each id, however often it is cached
        self.first = [0] * 256
        for c, b in alphabet.items():
            self.first[b] = vocab[c]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        #: (left << 20 | right) to (rank << 20 | new): the smallest value is the first merge
        self.merge = {}
        for rank, (a, b, new) in enumerate(merges):
            self.merge.setdefault(a << 20 | b, rank << 20 | new)
        self.lookahead = sufficient_lookahead(merges, [len(b) for b in self.bytes])
        self.window = window
        self.pattern = regex.compile(PATTERN)
        #: Where no white space follows white space, pre-tokens never cross the start of these chunks.
        self.double, self.chunk = re.compile(r"\s\s"), re.compile(r"\n| ?[^ \n]+| ")
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = Pieces(self, cache)

    def merged(self, data: bytes) -> list[int]:
        """The tokens of a bounded window: the earliest merge first, from left to right."""
        ids = [self.first[b] for b in data]
        get, none = self.merge.get, 1 << 60
        found = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        if len(found) > 64:
            return self._merged_long(ids, found)
        while found and (best := min(found)) != none:
            new, i = best & 0xFFFFF, found.index(best)
            ids[i : i + 2] = [new]
            del found[i]
            if i:
                found[i - 1] = get(ids[i - 1] << 20 | new, none)
            if i < len(found):
                found[i] = get(new << 20 | ids[i + 1], none)
        return ids

    def _merged_long(self, ids: list[int], found: list[int]) -> list[int]:
        """The same with a heap of (merge, place) over linked places, so that a window costs n log n."""
        get, none, n = self.merge.get, 1 << 60, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [m << 20 | i for i, m in enumerate(found) if m != none]
        heapify(heap)
        while heap:
            top = heappop(heap)
            best, i = top >> 20, top & 0xFFFFF
            j = after[i]
            if ids[i] < 0 or j == n or get(ids[i] << 20 | ids[j]) != best:
                continue  # a neighbour was taken in the meantime
            ids[i], ids[j] = best & 0xFFFFF, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (m := get(ids[i] << 20 | ids[k])) is not None:
                    heappush(heap, m << 20 | i)
            h = before[i]
            if h >= 0 and (m := get(ids[h] << 20 | ids[i])) is not None:
                heappush(heap, m << 20 | h)
        return [i for i in ids if i >= 0]

    def transduce(self, parts: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one pre-token that arrives in parts; holds ``window`` + ``lookahead`` + one part at most."""
        held, full = b"", self.window + self.lookahead
        for part in parts:
            held += part
            at = 0
            while len(held) - at >= full:
                ids, end = self.merged(held[at : at + full]), at
                stable = at + self.window
                for i in ids:
                    if end + len(self.bytes[i]) > stable:
                        break
                    end += len(self.bytes[i])
                    yield i
                at = end
            held = held[at:]
        yield from self.merged(held)

    def blocks(self, text: str) -> Iterator[list[int]]:
        """Ids of a text in blocks; what later characters could still change is held back."""
        at, special = 0, []
        if self.split and any(s in text for s in self.special):
            special = list(self.split.finditer(text))
        for m in special:
            yield from self._plain(text, at, m.start())
            yield [self.special[m[0]]]
            at = m.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, at: int, end: int) -> Iterator[list[int]]:
        while at < end:
            held = text[at : min(end, at + CHUNK)]
            last = at + CHUNK >= end
            pieces = (self.pattern if self.double.search(held) else self.chunk).findall(held)
            if not last and len(pieces) < 3:
                pieces = self.pattern.findall(held)
                if len(pieces) < 3:  # a pre-token that fills the chunk: it goes through the transducer part by part
                    stop = self.pattern.match(text, at, end).end()
                    yield from self._long(text, at, stop)
                    at = stop
                    continue
            if not last:  # the last two may go on: a run, or an apostrophe and its letters
                at -= len(pieces.pop()) + len(pieces.pop())
            at += len(held)
            yield list(chain.from_iterable(map(self.pieces.__getitem__, pieces)))

    def _long(self, text: str, at: int, end: int) -> Iterator[list[int]]:
        """Ids of one pre-token in blocks, whatever its length."""
        ids = map(self.same.__getitem__, self.transduce(text[i : min(end, i + CHUNK)].encode("utf-8") for i in range(at, end, CHUNK)))
        while block := list(islice(ids, CHUNK)):
            yield block

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.blocks(text)))

    def decode_blocks(self, blocks: Iterable[list[int]]) -> Iterator[str]:
        """Text of ids, block by block; bytes that don't end a character are held by the state machine."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in blocks:
            yield machine.decode(b"".join(map(self.bytes.__getitem__, ids)))
        yield machine.decode(b"", True)

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_blocks([list(ids)]))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text, in one pass."""
        ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0

        def seen() -> Iterator[list[int]]:
            nonlocal n
            for ids in self.blocks(text):
                if ids:
                    ids_hash.update(("," if n else "").encode() + ",".join(map(self.decimal.__getitem__, ids)).encode())
                    n += len(ids)
                    yield ids

        for part in self.decode_blocks(seen()):
            text_hash.update(part.encode("utf-8"))
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ids ARRAY<INT>: the ids of every text; a null text is empty. Other columns are left out."""
    require(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(rows):
        e = encoder(path)
        for key, text in rows:
            yield key, e.encode(text or "")

    return arrow_rows(docs, [id_col, text_col], f"{id_col} {kind}, ids array<int>", work, [id_col, "ids"], [_arrow(docs, id_col), pa.list_(pa.int32())], 256)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, text: the text of every list of ids; null ids give empty text."""
    require(encoded, id_col, ids_col)
    kind = encoded.schema[id_col].dataType.simpleString()

    def work(rows):
        e = encoder(path)
        for key, ids in rows:
            yield key, e.decode(ids or [])

    return arrow_rows(encoded, [id_col, ids_col], f"{id_col} {kind}, text string", work, [id_col, "text"], [_arrow(encoded, id_col), pa.string()], 256)


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, ids_sha256, decoded_sha256: each text encoded and decoded again in one streaming pass.

    Null and empty texts have no tokens; repeated rows are encoded each; extra columns are not read.
    ``path`` must name the same file on every executor.
    """
    require(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(rows):
        e = encoder(path)
        for key, text in rows:
            yield key, *e.digest(text or "")

    return arrow_rows(docs, [id_col, text_col], f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", work, [id_col, "n_tokens", "ids_sha256", "decoded_sha256"], [_arrow(docs, id_col), pa.int64(), pa.string(), pa.string()])


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
