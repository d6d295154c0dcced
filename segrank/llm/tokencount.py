"""Token counts of a unigram model by dynamic programming over a trie of distinct pre-tokens.

The best segmentation of a pre-token is that of the largest sum of piece scores.  Pre-tokens with a
common beginning share the forward scores of it: each trie node holds the best score and the number
of pieces of the best way to spell the characters from the root to it, and a terminal's count is
the pre-token's.  Only nodes that are new are computed.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame

from segrank.llm.common import arrow_rows, require

#: What stands for the space before a pre-token in the vocabulary.
MARK = "▁"
#: Nodes and distinct pre-tokens that one task's trie holds before it starts anew.
NODES = 1_500_000


def unigram_scores(path: str) -> tuple[dict[str, float], float]:
    """Scores by piece, -ln(1 + rank), from a sentencepiece model's ordinary pieces in their order; and the score of a byte of a character that no piece has."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {p: -math.log(1 + rank) for rank, p in reversed(list(enumerate(pieces, 1)))}, -math.log(1 + 2 * len(pieces))


class Trie:
    """Nodes are numbers; node 0 is the root. ``limit``: nodes before the trie is emptied."""

    def __init__(self, scores: dict[str, float], byte_score: float, limit: int = NODES):
        self.scores, self.byte, self.limit = scores, byte_score, limit
        self.longest = max(map(len, scores), default=1)
        self.ends = {p[-1] for p in scores}
        #: For each last character, the lengths of pieces that end with it.
        sizes: dict[str, set[int]] = {}
        for p in scores:
            sizes.setdefault(p[-1], set()).add(len(p))
        self.sizes = {c: sorted(s) for c, s in sizes.items()}
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.pieces = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def insert(self, word: str) -> int:
        """The number of pieces of ``word``, with ``MARK`` before it; nodes on its path that are new get their scores."""
        if (known := self.terminal.get(word)) is not None:
            return known
        if len(self.best) > self.limit:
            self.clear()
        text, child, best, pieces, scores = MARK + word, self.child, self.best, self.pieces, self.scores
        path, node = [0], 0
        long = len(text) > 4096  # a path of its own, of which only the last nodes are held
        if long:
            return self._alone(text)
        for i, c in enumerate(text, 1):
            key = (node, c)
            node = child.get(key, -1)
            if node < 0:
                top, n = best[path[i - 1]] + self.byte * len(c.encode("utf-8")), pieces[path[i - 1]] + len(c.encode("utf-8"))
                for size in self.sizes.get(c, ()):
                    if size > i:
                        break
                    s = scores.get(text[i - size : i])
                    if s is not None:
                        at = path[i - size]
                        total = best[at] + s
                        if total > top or total == top and pieces[at] + 1 < n:
                            top, n = total, pieces[at] + 1
                node = child[key] = len(best)
                best.append(top)
                pieces.append(n)
            path.append(node)
        self.terminal[word] = pieces[node]
        return pieces[node]

    def _alone(self, text: str) -> int:
        best, pieces, keep = [0.0], [0], self.longest
        first = 0  # place of best[0]
        for i, c in enumerate(text, 1):
            top, n = best[-1] + self.byte * len(c.encode("utf-8")), pieces[-1] + len(c.encode("utf-8"))
            for size in self.sizes.get(c, ()):
                if size > i:
                    break
                s = self.scores.get(text[i - size : i])
                if s is not None:
                    total = best[i - size - first] + s
                    if total > top or total == top and pieces[i - size - first] + 1 < n:
                        top, n = total, pieces[i - size - first] + 1
            best.append(top)
            pieces.append(n)
            if len(best) > 4 * keep:
                cut = len(best) - keep - 1
                del best[:cut], pieces[:cut]
                first += cut
        return pieces[-1]


_tries: dict[str, Trie] = {}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_pretokens, n_tokens for every row of ``docs``, without a shuffle.

    Pre-tokens are what ASCII white space separates. Null, empty and blank texts have none; repeated rows are
    counted each; extra columns aren't read. Equal scores: the segmentation of fewer pieces counts.
    """
    require(docs, id_col, text_col)
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType

    def work(rows):
        if path not in _tries:
            _tries[path] = Trie(*unigram_scores(path))
        trie = _tries[path]
        for key, text in rows:
            words = [w.decode() for w in (text or "").encode().split()]
            get, insert, n = trie.terminal.get, trie.insert, 0
            for w in words:
                n += get(w) or insert(w)
                get = trie.terminal.get
            yield key, len(words), n

    return arrow_rows(docs, [id_col, text_col], f"{id_col} {kind.simpleString()}, n_pretokens long, n_tokens long", work, [id_col, "n_pretokens", "n_tokens"], [to_arrow_type(kind), pa.int64(), pa.int64()])
