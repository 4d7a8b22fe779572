"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Method: contiguous rank array. A short word holds the boundaries of its parts and the merge rank of every adjacent pair
side by side; the lowest rank is found by a scan, the boundary between its two parts is deleted and the two neighbouring
ranks are looked up again, until no pair has a rank. Words longer than SHORT bytes do the same with a heap of pairs in
place of the scan, so a text without blanks stays in n log n. Words are parted by the vocabulary's own pattern, and each
task keeps the ids of the words it has seen in a memory of bounded size.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SHORT, MEMORY = 192, 1 << 18
NONE = 1 << 30

# Fixed value: the public pattern that parts a text into words before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same words in a text of ASCII characters without the separators 28-31, on which the two engines' \s differ.
ASCII_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""


class Encoder:
    """Words of bytes to ids by a vocabulary file of lines 'base64 rank'."""

    def __init__(self, path: str = VOCABULARY) -> None:
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.wide = regex.compile(PATTERN)
        self.plain = re.compile(ASCII_PATTERN, re.ASCII)
        self.memory: dict[str, tuple[int, ...]] = {}

    def short(self, word: bytes) -> tuple[int, ...]:
        """Parts by repeated scans of one array of adjacent ranks."""
        rank = self.rank
        cut = list(range(len(word) + 1))  # boundaries of the parts
        near = [rank.get(word[i : i + 2], NONE) for i in range(len(word) - 1)]  # near[i]: part i with part i + 1
        while near:
            least = min(near)
            if least == NONE:
                break
            i = near.index(least)
            del cut[i + 1], near[i]
            if i < len(near):
                near[i] = rank.get(word[cut[i] : cut[i + 2]], NONE)
            if i:
                near[i - 1] = rank.get(word[cut[i - 1] : cut[i + 1]], NONE)
        return tuple(rank[word[a:b]] for a, b in zip(cut, cut[1:]))

    def long(self, word: bytes) -> tuple[int, ...]:
        """The same merges, lowest rank and leftmost first, from a heap."""
        rank, n = self.rank, len(word)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n  # part i: word[i:after[i]]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not live[i] or after[i] >= n or after[after[i]] != end:
                continue
            j = after[i]
            live[j], after[i] = False, end
            if end < n:
                before[end] = i
                if (r := rank.get(word[i : after[end]], NONE)) != NONE:
                    heapq.heappush(heap, (r, i, after[end]))
            if (p := before[i]) >= 0 and (r := rank.get(word[p:end], NONE)) != NONE:
                heapq.heappush(heap, (r, p, end))
        return tuple(rank[word[i : after[i]]] for i in range(n) if live[i])

    def word(self, text: str) -> tuple[int, ...]:
        raw = text.encode("utf-8", "surrogatepass")
        whole = self.rank.get(raw)
        ids = (whole,) if whole is not None else self.short(raw) if len(raw) <= SHORT else self.long(raw)
        if len(text) <= 64:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of the text; none for null and empty texts. Special tokens' strings are ordinary text."""
        if not text:
            return []
        plain = text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f")
        words = (self.plain if plain else self.wide).findall(text)
        get, word = self.memory.get, self.word
        return list(chain.from_iterable([get(w) or word(w) for w in words]))


def encode_corpus(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (array of int) of every document; null and empty texts have an empty array.

    Rows stay where they are, so there is no shuffle; a text of any length is encoded whole. Repeated documents are
    encoded each. Further columns are ignored. The vocabulary's path must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            encoded = [encoder.encode(t) for t in batch.column("text").to_pylist()]
            lengths = np.fromiter((len(e) for e in encoded), np.int64, len(encoded))
            flat = np.fromiter(chain.from_iterable(encoded), np.int32, int(lengths.sum()))
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "ids"])

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")
