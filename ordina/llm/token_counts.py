"""Token counts under a unigram model, by forward scores over a trie of distinct pre-tokens."""

from __future__ import annotations

import base64
import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k"
#: Trie nodes and cached units of one worker; both start anew beyond.
NODES = 1_500_000
UNITS = 400_000
#: Bytes of a pre-token from which it is scored by itself, and characters from which a unit is not cached.
LONG = 4096
CACHED = 64


def unigram(vocabulary: str = VOCABULARY) -> dict[bytes, float]:
    """Piece -> log probability by Zipf's law on the rank in a public vocabulary; every single byte is a piece."""
    import public_tokenizers

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    norm = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: -math.log(r + 1) - norm for piece, r in ranks.items()}


class Trie:
    """Distinct pre-tokens by their bytes; each node holds the best score of its prefix and that path's pieces."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.longest = max(map(len, scores))
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best = [0.0]
        self.pieces = [0]

    def count(self, token: bytes) -> int:
        """Pieces of the best segmentation; of equally good ones, that with the longer last piece at each step."""
        if len(token) > LONG:
            return self.alone(token)
        if len(self.best) > NODES:
            self.clear()
        child, best, pieces, get = self.child, self.best, self.pieces, self.scores.get
        node, path = 0, [0]
        for j, byte in enumerate(token, 1):
            key = node << 8 | byte
            found = child.get(key)
            if found is None:
                top, least = -math.inf, 0
                for i in range(max(0, j - self.longest), j):
                    s = get(token[i:j])
                    if s is not None and best[path[i]] + s > top:
                        top, least = best[path[i]] + s, pieces[path[i]] + 1
                child[key] = found = len(best)
                best.append(top)
                pieces.append(least)
            node = found
            path.append(node)
        return pieces[node]


    def alone(self, token: bytes) -> int:
        """As ``count``, with the scores of the last ``longest`` prefixes only: the trie does not grow by a long token."""
        last: deque[tuple[float, int]] = deque([(0.0, 0)], self.longest)
        get = self.scores.get
        for j in range(1, len(token) + 1):
            top, least = -math.inf, 0
            for i, (score, pieces) in enumerate(last, j - len(last)):
                s = get(token[i:j])
                if s is not None and score + s > top:
                    top, least = score + s, pieces + 1
            last.append((top, least))
        return last[-1][1]


class Counter:
    """(pieces, pre-tokens) of whole texts, by way of distinct units: a word and the space before it."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import regex

        self.split = regex.compile(public_tokenizers.PATTERN).finditer
        self.trie = Trie(unigram(vocabulary))
        self.units: dict[str, tuple[int, int]] = {}

    def unit(self, unit: str) -> tuple[int, int]:
        pieces = tokens = 0
        for found in self.split(unit):
            pieces += self.trie.count(found[0].encode())
            tokens += 1
        return pieces, tokens

    def count(self, text: str) -> tuple[int, int]:
        if not text:
            return 0, 0
        head, *units = text.split(" ")
        if text[0].isspace() or "" in units or any(u[0].isspace() for u in units):
            return self.unit(text)
        known = self.units
        pieces, tokens = self.unit(head)
        for u in units:
            got = known.get(u)
            if got is None:
                got = self.unit(" " + u)
                if len(u) < CACHED:
                    if len(known) >= UNITS:
                        known.clear()
                    known[u] = got
            pieces += got[0]
            tokens += got[1]
        return pieces, tokens


def _count(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _WORKER.get(vocabulary)
        if counter is None:
            counter = _WORKER[vocabulary] = Counter(vocabulary)
        for batch in batches:
            rows = [counter.count(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1))], names=["doc_id", "n_tokens", "n_pretokens"])

    return run


_WORKER: dict[str, Counter] = {}


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_pretokens, of the whole text.

    Pre-tokens are those of the vocabulary's pattern; a pre-token counts as many tokens as the best path of
    the unigram model has pieces. Each worker keeps one trie, in which a prefix that pre-tokens share is scored
    once; nothing is shuffled. Trie and cache start anew at a bound, also within a text, and a pre-token of over LONG
    bytes stays out of them, so memory does not grow with the input.

    * null or empty text has no tokens; null ids and repeated rows are carried through;
    * an empty table gives an empty result; other columns are not read.
    """
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_count(vocabulary), "doc_id long, n_tokens long, n_pretokens long")
