"""Evaluation passages that stand in training documents.

Method: a broadcast hash set of the normalised n-grams of the test items. A run of 20 words with at most two replaced
holds at least six in a row that are untouched, so every leaked run shares a 6-gram with its item: token windows of the
documents are hashed and looked up, every hit gives an alignment of document and item, and the alignment is verified
word by word. Spans are reported, and removed from the documents (without_spans), or the documents dropped (without_leaks).
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN, REPLACED, GRAM = 20, 2, 6  # GRAM = ceil((RUN - REPLACED) / (REPLACED + 1)): six untouched words in a row
SLICE_WORDS = 1 << 21  # words of the test items broadcast at once; a word takes 20 bytes of arrays, and about 150 more where it is new

_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_LINE_START = re.compile(r"(?m)^[ \t]*(?:(?:[^\w\s]+|\d{1,3}[.)](?=[ \t]))[ \t]*)+")
_LINE_END = re.compile(r"(?<=[^\W_])[-‐­][ \t]*[\r\n]+[ \t]*(?=[^\W_])")
_UNSEEN = re.compile("[­​‌‍⁠﻿]")
_WORD = re.compile(r"[^\W_]+(?:\x01[^\W_]+)*")
JOIN = "\x01"


def words(text: str) -> list[str]:
    """Words of letters and digits in lower case, without markup and marks at line starts; JOIN stands in a word that a
    hyphen at a line end parts, as only the reader knows whether the parts are one word."""
    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "\n" in text or "\r" in text:
        text = _LINE_START.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
        text = _LINE_END.sub(JOIN, text)
    if not text.isascii():
        text = _UNSEEN.sub("", text)
    return _WORD.findall(text.lower())


class Items:
    """The test items as word ids, and the hashes of their n-grams with where they stand, as sorted arrays."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.ids: dict[str, int] = {}
        self.item_ids = np.array([i for i, _ in items], np.int64)
        lists = [np.array([self.ids.setdefault(p, len(self.ids) + 1) for w in words(text or "") for p in w.split(JOIN)], np.int32) for _, text in items]
        self.starts = np.cumsum([0] + [len(w) for w in lists])
        self.words = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        grams = [self.hashes(w) if len(w) >= RUN else np.zeros(0, np.uint64) for w in lists]
        h = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = h.argsort(kind="stable")
        self.grams = h[order]
        self.gram_item = np.repeat(np.arange(len(lists), dtype=np.int32), [len(g) for g in grams])[order]
        self.gram_place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams] or [np.zeros(0, np.int32)])[order]

    def bytes(self) -> int:
        """What the arrays and the words take, roughly."""
        return sum(a.nbytes for a in (self.item_ids, self.starts, self.words, self.grams, self.gram_item, self.gram_place)) + 150 * len(self.ids)

    @staticmethod
    def hashes(ids: np.ndarray) -> np.ndarray:
        """Hash of each window of GRAM ids."""
        n = len(ids) - GRAM + 1
        out = np.zeros(max(n, 0), np.uint64)
        for i in range(GRAM):
            out = (out + ids[i : i + max(n, 0)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def number(self, text: str) -> list[int]:
        """Ids of the text's words, 0 for words in no item. A parted word is one if an item has it whole."""
        get, out = self.ids.get, []
        for w in words(text):
            if JOIN in w:
                parts, i = w.split(JOIN), 0
                while i < len(parts):
                    whole = get(parts[i] + parts[i + 1]) if i + 1 < len(parts) else None
                    out.append(whole if whole else get(parts[i], 0))
                    i += 2 if whole else 1
            else:
                out.append(get(w, 0))
        return out

    def lines(self, docs: list[list[int]]) -> np.ndarray:
        """(document's place, item's place, shift between both) of every n-gram that a document and an item share; each once."""
        none = np.zeros((0, 3), np.int64)
        if not len(self.grams) or not docs:
            return none
        starts = np.cumsum([0] + [len(d) + 1 for d in docs])  # a 0 between documents
        ids = np.zeros(starts[-1], np.int64)
        for a, d in zip(starts, docs):
            ids[a : a + len(d)] = d
        if len(ids) < GRAM:
            return none
        h = self.hashes(ids)
        at = np.flatnonzero(np.convolve(ids == 0, np.ones(GRAM, np.int64), "valid") == 0)
        first = np.searchsorted(self.grams, h[at])
        n = np.searchsorted(self.grams, h[at], "right") - first
        at, first, n = at[n > 0], first[n > 0], n[n > 0]
        found = [none]
        for k in range(0, len(at), 4096):  # a gram that very many items share gives as many rows, a stretch at a time
            m = n[k : k + 4096]
            where = np.repeat(first[k : k + 4096] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            of = np.repeat(at[k : k + 4096], m)
            doc = np.searchsorted(starts, of, "right") - 1
            found.append(np.unique(np.stack([doc, self.gram_item[where], of - starts[doc] - self.gram_place[where]], 1), axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def runs(self, docs: list[list[int]]) -> Iterator[tuple[int, int, int, int]]:
        """(document's place, item_id, first word, words) of every leaked run."""
        for d, n, shift in self.lines(docs).tolist():
            w = self.words[self.starts[n] : self.starts[n + 1]]
            lo, hi = max(0, -shift), min(len(w), len(docs[d]) - shift)
            if hi - lo < RUN:
                continue
            same = np.array(docs[d][lo + shift : hi + shift]) == w[lo:hi]
            good = np.convolve(same, np.ones(RUN, np.int64), "valid") >= RUN - REPLACED
            edges = np.flatnonzero(np.diff(np.concatenate([[0], good, [0]])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                yield d, int(self.item_ids[n]), a + lo + shift, b - a + RUN - 1

    def find(self, docs: list[list[int]]) -> list[tuple[int, int, int, int]]:
        """(document's place, item_id, first word, words) of the longest leaked run of each pair, the first of equally long ones."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for d, item_id, first, length in self.runs(docs):
            best[d, item_id] = max(best.get((d, item_id), (0, 0)), (length, -first))
        return [(d, i, -start, length) for (d, i), (length, start) in sorted(best.items())]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Start and end in the text of each leaked run, overlapping ones as one."""
        places = located(text, self)
        out: list[tuple[int, int]] = []
        for a, b in sorted((places[first][0], places[first + n - 1][1]) for _, _, first, n in self.runs([self.number(text)])):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out


class _Traced:
    """A text under replacement that knows where in the original each of its characters begins and ends."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, [(i, i + 1) for i in range(len(text))]

    def sub(self, pattern: re.Pattern, new) -> None:
        parts, at, end = [], [], 0
        for m in pattern.finditer(self.text):
            put = new(m.group()) if callable(new) else new
            parts += [self.text[end : m.start()], put]
            whole = (self.at[m.start()][0], self.at[m.end() - 1][1]) if m.end() > m.start() else None
            at += self.at[end : m.start()] + [whole] * len(put)
            end = m.end()
        self.text, self.at = "".join(parts) + self.text[end:], at + self.at[end:]


_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_CLUSTER = re.compile(r"[^\x00-\x7f]|[\s\S][\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a]+")


def located(text: str, items: Items) -> list[tuple[int, int]]:
    """Start and end in the text of each word that Items.number numbers, in the same order."""
    t = _Traced(text)
    t.sub(_TAG, "")
    t.sub(_ENTITY, html.unescape)
    t.sub(_CLUSTER, lambda c: unicodedata.normalize("NFKC", c))
    if "\n" in t.text or "\r" in t.text:
        t.sub(re.compile("\r\n|\r"), "\n")
        t.sub(_LINE_START, "")
        t.sub(_LINE_END, JOIN)
    t.sub(_UNSEEN, "")
    t.sub(re.compile(r"[^\x00-\x7f]|[A-Z]"), str.lower)
    out = []
    for m in _WORD.finditer(t.text):
        parts, at, i = m.group().split(JOIN), m.start(), 0
        while i < len(parts):
            whole = i + 1 < len(parts) and bool(items.ids.get(parts[i] + parts[i + 1]))
            size = len(parts[i]) + (1 + len(parts[i + 1]) if whole else 0)
            out.append((t.at[at][0], t.at[at + size - 1][1]))
            at, i = at + size + 1, i + 1 + whole
    return out


def _slices(items: DataFrame) -> Iterator[Items]:
    """The test set, in slices of about SLICE_WORDS words, so that what is broadcast stays bounded however large the set."""
    held = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").distinct()
    n = held.agg(F.sum(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")))).first()[0] or 0
    slices = max(1, -(-int(n) // SLICE_WORDS))
    for k in range(slices):
        part = held.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k) if slices > 1 else held
        yield Items([(r["item_id"], r["text"]) for r in part.orderBy("item_id").collect()])


def leaked_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, n_words: the longest leaked run of each document and item that share one.

    Every document is read whole and, for each slice of the test set, once; there is no shuffle before the last distinct.
    The test set goes to all executors in slices bounded by its words. Null and empty texts hold nothing; items under 20
    words are found in nothing; repeated rows of a document or an item give one row.
    """
    spark = documents.sparkSession

    def scan(known: Items) -> DataFrame:
        sent = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for at in range(0, len(ids), 500):
                    docs = [known.number(t) if t else [] for t in batch.column("text").slice(at, 500).to_pylist()]
                    rows = known.find(docs)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([ids[at + r[0]] for r in rows], pa.int64()),
                            "item_id": pa.array([r[1] for r in rows], pa.int64()),
                            "first_word": pa.array([r[2] for r in rows], pa.int32()),
                            "n_words": pa.array([r[3] for r in rows], pa.int32()),
                        }
                    )

        return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, item_id bigint, first_word int, n_words int")

    found = None
    for known in _slices(items):
        got = scan(known)
        found = got if found is None else found.unionByName(got)
    return found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("first_word", "n_words"), F.struct("n_words", (-F.col("first_word")).alias("f"))).alias("s")).select("doc_id", "item_id", "s.first_word", "s.n_words")


def without_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """documents without those that hold a passage of an item; rows with a null doc_id stay."""
    return documents.join(leaked_spans(documents, items).select("doc_id").distinct(), "doc_id", "left_anti")


def without_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """documents, all rows, with every leaked run cut out of text, each by one blank; other columns and texts stay as they are.

    The rows stay where they are, nothing is shuffled. Where cutting brings two halves of a passage together, the next slice
    of the test set or a second call sees them.
    """
    spark = documents.sparkSession
    out = documents

    def scan(rows: DataFrame, known: Items) -> DataFrame:
        sent = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for batch in batches:
                texts = batch.column("text").to_pylist()
                for at in range(0, len(texts), 500):
                    docs = [known.number(t) if t else [] for t in texts[at : at + 500]]
                    for d in sorted({d for d, *_ in known.find(docs)}):
                        text = texts[at + d]
                        for a, b in reversed(known.spans(text)):
                            text = text[:a] + " " + text[b:]
                        texts[at + d] = text
                yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, batch.schema.field("text").type))

        return rows.mapInArrow(run, rows.schema)

    for known in _slices(items):
        out = scan(out, known)
    return out
