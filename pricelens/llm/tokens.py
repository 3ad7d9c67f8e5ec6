"""Token counts by a linear longest-match automaton.

Greedy word-piece length of each word without building the pieces: a trie over
the vocabulary, where every node has a failure link and the number of pieces
that following the link pops.  A word is read once, byte by byte; the count is
the sum of what its steps pop.

The vocabulary is byte-level, so every byte is a piece and no word is unknown.
The trie has a fixed size given by the vocabulary file, is read once by the
driver and broadcast.  The text is read in one pass without a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import map_rows

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Distinct words whose counts a Python worker remembers before it starts over.
CACHE_WORDS = 400_000


def byte_alphabet() -> dict[str, int]:
    """Character that stands for a byte in byte-level vocabulary files.

    Printable bytes stand for themselves; the others, in order, for the code
    points from 256 on (a fixed rule of the public file format).
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a byte-level vocabulary file, as bytes; all 256 bytes included."""
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    of = byte_alphabet()
    pieces = {bytes(of[c] for c in n) for n in names if n and all(c in of for c in n)}
    return sorted(pieces | {bytes([b]) for b in range(256)})


class Automaton:
    """Trie with failure links and pop counts (``count`` reads a word once)."""

    def __init__(self, pieces: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            node = 0
            for b in piece:
                to = self.next[node].get(b)
                if to is None:
                    to = self.next[node][b] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                node = to
            ends[node] = node != 0
        self.fail = [0] * len(self.next)
        self.pops = [0] * len(self.next)
        level = [(0, b, v) for b, v in self.next[0].items()]
        while level:
            below = []
            for parent, b, v in level:
                if ends[v]:
                    self.fail[v], self.pops[v] = 0, 1
                else:
                    # every byte is a piece: the walk ends at the root at the latest
                    z, n = self.fail[parent], self.pops[parent]
                    while b not in self.next[z]:
                        n += self.pops[z]
                        z = self.fail[z]
                    self.fail[v], self.pops[v] = self.next[z][b], n
                below += [(v, c, w) for c, w in self.next[v].items()]
            level = below

    def count(self, word: bytes) -> int:
        nxt, fail, pops = self.next, self.fail, self.pops
        node = total = 0
        for b in word:
            to = nxt[node].get(b)
            while to is None:
                total += pops[node]
                node = fail[node]
                to = nxt[node].get(b)
            node = to
        while node:
            total += pops[node]
            node = fail[node]
        return total


def greedy_count(word: bytes, pieces: set[bytes]) -> int:
    """Brute force: cut off the longest piece again and again."""
    n = 0
    while word:
        k = next(k for k in range(len(word), 0, -1) if word[:k] in pieces)
        word, n = word[k:], n + 1
    return n


_STATE: dict[int, tuple[Automaton, dict[bytes, int]]] = {}


def _state(key: int, sent) -> tuple[Automaton, dict[bytes, int]]:
    """A Python worker's automaton and counted words, kept between its tasks."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = Automaton(sent.value), {}
    return _STATE[key]


def token_counts(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text",
                 word_prefix: bytes = b" ") -> DataFrame:
    """Count the greedy longest-match tokens of every whole text.

    Words are maximal runs without ASCII white space; each is read behind
    ``word_prefix``, which in the vocabulary marks a word's beginning.  Returns
    ``doc_id``, ``n_words``, ``n_bytes``, ``n_tokens`` and ``max_word_tokens``
    for each input row.

    Null text is empty text: all counts 0.  Null ids are kept, repeated rows
    give repeated results, an empty table gives an empty result, and other
    columns of the input are ignored whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    key = hash((tuple(vocabulary), word_prefix))

    def row(doc_id, text):
        auto, cache = _state(key, sent)
        words = (text or b"").split()
        total = most = 0
        for w in words:
            n = cache.get(w)
            if n is None:
                n = auto.count(word_prefix + w)
                if len(w) <= 64:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[w] = n
            total += n
            if n > most:
                most = n
        return doc_id, len(words), len(text or b""), total, most

    names = ["doc_id", "n_words", "n_bytes", "n_tokens", "max_word_tokens"]
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")),
                    row, ", ".join(f"{n} long" for n in names), pa.schema([(n, pa.int64()) for n in names]))
