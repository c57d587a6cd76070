"""Cached tokenisation of whole texts by a public tokenizer file.

White space separates tokens in the lower-casing word vocabularies, so a text's ids are the ids of its
white-space chunks put together, and A-Z may be folded before chunks are looked up. Chunks recur, so their
ids are kept in two generations of bounded size: when the young one is full it becomes the old one, and
what is met again moves up. Each Python worker has one encoder, for all its tasks.

New chunks are mostly one plain word with marks around it. Plain words go to the vocabulary's merges alone,
without the normalising and splitting that cannot change them; anything else goes to the whole tokenizer.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer, normalizers, pre_tokenizers

#: A line that is a word of letters, lower case and composed already, with marks (no apostrophe) around it; or any line.
PARTS = re.compile("([\"(]*)([a-zß-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)\n|([^\n]*)\n")
WORD_END = "</w>"
BATCH_BYTES = 4_000_000


def packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def own_chunks(raw: bytes) -> bool:
    """Whether a text may be folded and cut: no special token's brackets, no combining mark (U+0300 to U+037F)."""
    return b"<|" not in raw and b"\xcc" not in raw and b"\xcd" not in raw


class Generation:
    """Chunks and their ids: a chunk's number, given when it is first asked for, finds its run in one array."""

    def __init__(self):
        self.number: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.starts, self.lengths, self.ids = (np.empty(1024, dtype=t) for t in ("i8", "i8", "<u4"))
        self.known = self.used = self.held = 0
        self.number[b""]
        self.add(np.zeros(1, dtype="i8"), np.zeros(0, dtype="<u4"), np.zeros(1, dtype="i8"))

    def add(self, numbers: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Give numbers their ids, which stand one after the other."""
        self.ids = grown(self.ids, self.used + len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts, self.lengths = (grown(x, len(self.number)) for x in (self.starts, self.lengths))
        self.starts[numbers] = self.used + np.cumsum(lengths) - lengths
        self.lengths[numbers] = lengths
        self.used += len(ids)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all numbers, one after the other, and how many each has."""
        lengths = self.lengths[numbers]
        before = np.cumsum(lengths) - lengths
        return self.ids[np.repeat(self.starts[numbers] - before, lengths) + np.arange(lengths.sum())], lengths

    def new(self) -> list[bytes]:
        """Chunks that were numbered since the last call, in order."""
        out = list(itertools.islice(reversed(self.number), len(self.number) - self.known))[::-1]
        self.known = len(self.number)
        self.held += sum(map(len, out))
        return out


def grown(x: np.ndarray, size: int) -> np.ndarray:
    return x if size <= len(x) else np.concatenate([x, np.empty(max(size - len(x), len(x)), dtype=x.dtype)])


class WordEncoder:
    """encode(texts) -> for each UTF-8 text, the bytes of its little-endian unsigned 32-bit ids, none added."""

    def __init__(self, vocabulary: str = "word_bpe_49k.json", cache_entries: int = 400_000, cache_bytes: int = 32_000_000):
        path = public_tokenizers.path(vocabulary)
        self.tokenizer, self.merges = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        known = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(known.values()) + 1, dtype=bool)
        self.ends[[i for token, i in known.items() if token.endswith(WORD_END)]] = True
        self.cache_entries, self.cache_bytes = cache_entries, cache_bytes
        self.young, self.old = Generation(), Generation()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out, held, size = [], [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= BATCH_BYTES:
                out += self._some(held)
                held, size = [], 0
        return out + self._some(held)

    def _some(self, texts: list[bytes]) -> list[bytes]:
        if len(self.young.number) > self.cache_entries or self.young.held > self.cache_bytes:
            self.young, self.old = Generation(), self.young
            self.young.new()
        number = self.young.number.__getitem__
        found = []
        for raw in texts:
            chunks = raw.lower().split() if own_chunks(raw) else ()
            found.append(np.fromiter(map(number, chunks), dtype="i8", count=len(chunks)))
        self._learn(self.young.new())
        if not found:
            return []
        ids, lengths = self.young.take(np.concatenate(found))
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([len(x) for x in found])] * 4
        whole = ids.tobytes()
        begins = [0, *ends[:-1].tolist()]
        return [whole[b:e] if own_chunks(raw) else self._direct(raw) for raw, b, e in zip(texts, begins, ends.tolist())]

    def _direct(self, raw: bytes) -> bytes:
        return packed(self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def _learn(self, chunks: list[bytes]) -> None:
        """Give each new chunk its ids: as it was in the old generation, or by its word and marks, or whole."""
        number = self.young.number.__getitem__
        fresh = self._from_old(chunks)
        words, others, made = [], [], []
        for chunk, (lead, word, trail, _) in zip(fresh, PARTS.findall(b"\n".join([*fresh, b""]).decode("utf-8", "replace"))):
            if not word:
                others.append(chunk)
            elif lead or trail:
                made.append((number(chunk), number(lead.encode()), number(word.encode()), number(trail.encode())))
            else:
                words.append(chunk)
        for part in self._from_old(self.young.new()):
            (words if part[-1:].isalpha() or part[-1] > 127 else others).append(part)
        self._learn_words(words)
        self._learn_others(others)
        if made:
            table = np.array(made, dtype="i8")
            ids, lengths = self.young.take(table[:, 1:].ravel())
            self.young.add(table[:, 0], ids, lengths.reshape(-1, 3).sum(1))

    def _from_old(self, chunks: list[bytes]) -> list[bytes]:
        """Moves up what the old generation knows; returns the rest."""
        before = np.fromiter(map(self.old.number.get, chunks, itertools.repeat(-1)), dtype="i8", count=len(chunks))
        at = np.flatnonzero(before >= 0)
        if len(at):
            self.young.add(self._numbers([chunks[i] for i in at.tolist()]), *self.old.take(before[at]))
        return [chunks[i] for i in np.flatnonzero(before < 0).tolist()]

    def _numbers(self, chunks: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.young.number.__getitem__, chunks), dtype="i8", count=len(chunks))

    def _learn_words(self, words: list[bytes]) -> None:
        """Plain words: every word's last id, and no other, is one that ends words."""
        if not words:
            return
        ids = np.array(self.merges.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            raise ValueError("a word's ids do not end with one that ends words")
        self.young.add(self._numbers(words), ids, np.diff(cuts, prepend=0))

    def _learn_others(self, chunks: list[bytes]) -> None:
        """Any chunks: one call for all; where each id began in the joined text tells whose it is."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        begins = np.fromiter((b for b, _ in found.offsets), dtype="i8", count=len(found.ids))
        cuts = np.searchsorted(begins, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        self.young.add(self._numbers(chunks), np.array(found.ids, dtype="<u4"), np.diff(cuts))


@functools.cache
def encoder(vocabulary: str) -> WordEncoder:
    """The worker's encoder: loaded once, its cache kept from task to task."""
    return WordEncoder(vocabulary)
