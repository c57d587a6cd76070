"""Token counts by a linear longest-match automaton.

Greedy word pieces take, from the left, the longest vocabulary entry each time. The automaton is a trie of
the vocabulary whose nodes have a failure link and the number of pieces that following it pops, both
computed once: on a byte that the trie cannot follow, the count grows by the popped pieces and matching goes on
at the link, so a word costs time linear in its length and no piece is ever built.

The vocabulary is a byte-level one: entries that begin with the space mark start a word, others continue
it. Every byte is an entry in itself, so each word has pieces; a word that another vocabulary cannot split is
one unknown piece. Words are runs of letters, digits and underscores, and other visible characters one
by one.
"""

from __future__ import annotations

import functools
import json
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

WORD = re.compile(r"\w+|[^\w\s]")
CACHE_ENTRIES = 500_000
CACHE_CHARACTERS = 64


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: visible Latin-1 stands for itself, the rest from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(name: str) -> list[bytes]:
    """The entries of a byte-level vocabulary file as bytes; a leading space means the start of a word."""
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    alphabet = byte_alphabet()
    return [bytes(alphabet[c] for c in entry) for entry in entries if all(c in alphabet for c in entry)]


class Automaton:
    """Trie with failure links and popped-piece counts; count(word) is the number of greedy pieces."""

    def __init__(self, entries: list[bytes]):
        self.next: list[dict[int, int]] = [{}]
        whole = [False]
        for entry in entries:
            node = 0
            for b in entry:
                if b not in self.next[node]:
                    self.next[node][b] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                node = self.next[node][b]
            whole[node] = node > 0
        # breadth first: links of shorter strings are known when a longer one needs them
        self.link = [-1] * len(self.next)
        self.pops = [0] * len(self.next)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for b, node in self.next[parent].items():
                if whole[node]:
                    self.link[node], self.pops[node] = 0, 1
                else:
                    at, popped = self.link[parent], self.pops[parent]
                    while at >= 0 and b not in self.next[at]:
                        popped += self.pops[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[node], self.pops[node] = self.next[at][b], popped
                queue.append(node)

    def count(self, word: bytes) -> int:
        """Pieces of a word; -1 where some rest of it starts with no entry."""
        nodes, links, pops = self.next, self.link, self.pops
        node = total = 0
        for b in word:
            step = nodes[node].get(b)
            while step is None:
                if node == 0 or links[node] < 0:
                    return -1
                total += pops[node]
                node = links[node]
                step = nodes[node].get(b)
            node = step
        while node > 0:
            if links[node] < 0:
                return -1
            total += pops[node]
            node = links[node]
        return total


class Counter(dict):
    """word -> pieces, kept for the words seen last; words over CACHE_CHARACTERS are counted each time.

    A word that the vocabulary cannot split (none with a byte-level one) is one piece, unknown.
    """

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = abs(self.automaton.count(b" " + word.encode("utf-8")))
        if len(word) <= CACHE_CHARACTERS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = n
        return n


@functools.cache
def counter(name: str) -> Counter:
    """The worker's automaton and cache, made once."""
    return Counter(Automaton(vocabulary(name)))


def count_tokens(docs: DataFrame, name: str = "byte_bpe_50k.json") -> DataFrame:
    """documents -> (doc_id, n_words, n_pieces, longest), a row per row.

    longest is the most pieces that a word has. Null and empty texts have zero of each. Repeated rows are
    each returned; an empty table gives no rows. Columns other than doc_id and text are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = counter(name)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                counts = list(map(pieces.__getitem__, WORD.findall(text)))
                rows.append((len(counts), sum(counts), max(counts, default=0)))
            out = pd.DataFrame(rows, columns=["n_words", "n_pieces", "longest"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield out.astype({"doc_id": "Int64"})

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInPandas(run, "doc_id long, n_words long, n_pieces long, longest long")
