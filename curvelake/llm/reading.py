"""Reading level of documents, by propagation of difficulty over the document-word graph.

Method: documents and words are the nodes of a bipartite graph; an edge weighs a word's share of a document's sentences,
each sentence counting alike. Graded documents are clamped to their grade; in distributed harmonic rounds every word
takes the mean of its documents and every other document the mean of its words, until no word moves by TOLERANCE any
more. The rounds follow an Anderson-accelerated path to the same fixed point. A document's level is then that whose graded
documents lie nearest most of its sentences, by the words' values at the fixed point.

The language goes along the same edges: graded documents are in the language looked for; so is a document of which a share
of KNOWN is words of that language, and a word of which a share of SPOKEN is in such documents.

Word nodes live in SLOTS hash slots, so what a round gathers and sends out is bounded by a constant whatever the corpus.
"""

from __future__ import annotations

import hashlib
import html
import logging
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.session import cut

SLOTS = 1 << 19
LEVELS = (1, 2, 3, 4)
ROUNDS, TOLERANCE, HISTORY = 200, 1e-3, 5  # a safety bound, of which a warning tells; change of a word at which rounds end; steps kept for acceleration
LEAST_WORDS = 60
COMMON = 0.004  # a sentence of up to COMMON_WORDS words that stands in this share of all distinct texts is a footer
COMMON_WORDS = 15
COPY = 0.5  # texts with this share of common lines among their distinct sentences are near copies of one another
SPOKEN = 0.25  # share of a word's weight that must be in documents of that language for it to be of it
KNOWN = 0.6  # share of a sentence's words that must be of the graded documents' language for it to count as such

_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_TITLE = re.compile(r"[ \t]*(?:#|@|=+[ \t]|\[\d+\])")
_MARK = re.compile(r"[ \t]*(?:[>*+|•–/-]+[ \t]+)+")
_END = re.compile(r"[.!?;…][\"')\]]*\s+")
_LETTERS = re.compile(r"\((?:[A-Za-z], ?)*[A-Za-z]\)")
_HYPHEN = re.compile(r"[-\u00ad](?<=[^\W\d_][-\u00ad])\n[ \t]*(?:[>*+|•–/#-]+[ \t]+)*(?=[a-zß-ÿ])")
_AROUND = "()[]\"'“”‘’.,;:!?…"


def _words(tokens: list[str]) -> list[str]:
    """The words among tokens: letters with inner hyphens or apostrophes, marks around them; of single letters only a and i."""
    out = []
    for token in tokens:
        w = token.strip(_AROUND)
        if w.isalpha():
            if len(w) > 1 or w in "ai":
                out.append(w)
        elif w and w[0] != "-" and w[-1] != "-" and w.replace("-", "").replace("'", "").replace("’", "").isalpha():
            out.append(w)
    return out


def sentences(text: str) -> list[list[str]]:
    """The words of the sentences of a text."""
    return [words for words, _ in counted(text)]


def counted(text: str) -> list[tuple[list[str], int]]:
    """The sentences of a text as (lower-case words, number of tokens between blanks), without titles, markup, lists of letters, logs and tables.

    Wrapped lines are joined where one goes on in lower case, but for lines set off by dashes. A stretch counts as a sentence if at least 60 % of its
    tokens are words, which rows of numbers aren't.
    """
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "(" in text:
        text = _LETTERS.sub(" ", text)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\n" in text:
        text = _HYPHEN.sub("", text)
    units: list[str] = []
    for line in text.split("\n"):
        if not (bare := line.strip()):
            continue
        if _TITLE.match(line) and len(bare.split()) <= 12:
            units.append("")
            continue
        bare = _MARK.sub("", bare + " ", count=1).strip()
        if not bare:
            continue
        if units and units[-1] and bare[0].islower() and not line.lstrip().startswith("--"):
            units[-1] += " " + bare
        else:
            units.append(bare)
    out = []
    for unit in units:
        for sentence in _END.split(unit.lower()):
            tokens = sentence.split()
            if len(tokens) > 1 and len(words := _words(tokens)) >= 0.6 * len(tokens):
                out.append((words, len(tokens)))
    return out


def _slot(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % SLOTS


def parsed(documents: DataFrame) -> DataFrame:
    """doc_id, slots (word nodes, sentence by sentence), lengths (words of each sentence), tokens (with numbers and the like),
    lines (of short sentences the hash of the whole sentence, else -1), body (hash of all sentences); documents without a sentence are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            keep, slots, lengths, sizes, lines, bodies = [], [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = counted(text) if text else []
                if doc_id is None or not found:
                    continue
                own: list[int] = []
                for s, _ in found:
                    for w in s:
                        n = known.get(w)
                        if n is None:
                            if len(known) > 1 << 18:
                                known.clear()
                            n = known[w] = _slot(w)
                        own.append(n)
                keep.append(doc_id)
                slots.append(own)
                lengths.append([len(s) for s, _ in found])
                sizes.append([n for _, n in found])
                lines.append([_slot(" ".join(s)) if len(s) <= COMMON_WORDS else -1 for s, _ in found])
                bodies.append(int.from_bytes(hashlib.blake2b("\n".join(" ".join(s) for s, _ in found).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(slots, ints), pa.array(lengths, ints), pa.array(sizes, ints), pa.array(lines, ints), pa.array(bodies, pa.int64())], ["doc_id", "slots", "lengths", "tokens", "lines", "body"])

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, slots array<int>, lengths array<int>, tokens array<int>, lines array<int>, body bigint")


def grades(labels: DataFrame) -> DataFrame:
    """doc_id, grade: the median of a document's distinct grades per grader; nulls and levels outside 1 to 4 don't count."""
    kept = labels.where(F.col("doc_id").isNotNull() & F.col("reading_level").isin(*LEVELS)).select("doc_id", "grader", "reading_level").distinct()
    return kept.groupBy("doc_id").agg(F.percentile("reading_level", F.lit(0.5)).alias("grade"))


class _Batch:
    """A record batch as flat arrays: for each word its sentence, for each sentence its document."""

    def __init__(self, batch: pa.RecordBatch, common: np.ndarray) -> None:
        self.docs = len(batch)
        self.grade = batch.column("grade").to_numpy(zero_copy_only=False).astype(float) if batch.schema.get_field_index("grade") >= 0 else np.full(self.docs, np.nan)
        lengths = batch.column("lengths")
        per = lengths.value_lengths().to_numpy(zero_copy_only=False).astype(int)
        self.length = lengths.flatten().to_numpy().astype(int)
        self.tokens = batch.column("tokens").flatten().to_numpy().astype(int)
        self.slot = batch.column("slots").flatten().to_numpy()
        self.doc = np.repeat(np.arange(self.docs), per)  # of a sentence
        self.sentence = np.repeat(np.arange(len(self.length)), self.length)  # of a word
        self.line = batch.column("lines").flatten().to_numpy()
        self.prose = ~np.isin(self.line, common) if len(common) else np.ones(len(self.length), bool)

    def means(self, score: np.ndarray) -> np.ndarray:
        """Mean score of each sentence's words; words no grade has reached (NaN) don't count."""
        s = score[self.slot]
        ok = ~np.isnan(s)
        n = np.bincount(self.sentence[ok], minlength=len(self.length))
        return np.bincount(self.sentence[ok], s[ok], len(self.length)) / np.where(n > 0, n, np.nan)

    def of_docs(self, score: np.ndarray) -> np.ndarray:
        """Mean over each document's prose sentences."""
        m = self.means(score)
        ok = self.prose & ~np.isnan(m)
        n = np.bincount(self.doc[ok], minlength=self.docs)
        return np.bincount(self.doc[ok], m[ok], self.docs) / np.where(n > 0, n, np.nan)


def _footers(corpus: DataFrame) -> np.ndarray:
    """Hashes of the short sentences that stand in a COMMON share of all distinct texts; at most COMMON_WORDS / COMMON a text's length each, so few.

    Copies of a text count once, or a text copied often would lose its own sentences. Near copies are known by being made of common lines for the most
    part, which texts with a footer aren't: they count for none of their lines, so a footer is common among other texts as well.
    """
    texts = corpus.groupBy("body").agg(F.first("lines").alias("lines"))  # texts of one hash have the same lines
    least = max(3.0, COMMON * texts.count())
    own = texts.select(F.array_except(F.array_distinct("lines"), F.array(F.lit(-1))).alias("own"), F.size(F.filter("lines", lambda n: n < 0)).alias("long"))
    counts = lambda rows: {r["line"] for r in rows.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()}
    found = counts(own.select(F.explode("own").alias("line")))
    if not found:
        return np.array([], np.int64)
    sent = corpus.sparkSession.sparkContext.broadcast(np.array(sorted(found), np.int64))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("own")
            flat = lists.flatten().to_numpy()
            doc = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
            common = np.isin(flat, sent.value)
            n = np.bincount(doc, minlength=len(batch)) + batch.column("long").to_numpy()
            copy = np.bincount(doc[common], minlength=len(batch)) >= COPY * np.maximum(n, 1)
            line, times = np.unique(flat[common & ~copy[doc]], return_counts=True)
            yield pa.RecordBatch.from_pydict({"line": line.astype(np.int32), "n": times.astype(np.int64)})

    kept = own.mapInArrow(part, "line int, n bigint").groupBy("line").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()
    sent.unpersist()
    return np.array(sorted(r["line"] for r in kept), np.int64)


def _edges(corpus: DataFrame, common: np.ndarray) -> DataFrame:
    """grade, slots, weights: the edges of each document, a word of it once, from its sentences of prose."""
    sent = corpus.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _Batch(batch, sent.value)
            ok = b.prose[b.sentence]
            at = b.doc[b.sentence][ok].astype(np.int64) * SLOTS + b.slot[ok]
            edge, back = np.unique(at, return_inverse=True)
            weight = np.bincount(back, 1.0 / b.length[b.sentence][ok], len(edge)).astype(np.float32)
            ends = pa.array(np.searchsorted(edge, np.arange(b.docs + 1, dtype=np.int64) * SLOTS), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((edge % SLOTS).astype(np.int32), weight)]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), *lists], ["grade", "slots", "weights"])

    return cut(corpus.mapInArrow(run, "grade double, slots array<int>, weights array<float>"), "edges")


def _ahead(xs: list[np.ndarray], fs: list[np.ndarray]) -> np.ndarray:
    """The next point of a fixed-point iteration from its last points and their images (Anderson's mixing)."""
    if len(xs) < 2:
        return fs[-1]
    rests = np.stack([f - x for x, f in zip(xs, fs)])
    steps = np.diff(rests, axis=0).T
    mix, *_ = np.linalg.lstsq(steps, rests[-1], rcond=1e-8)
    return np.clip(fs[-1] - np.diff(np.stack(fs), axis=0).T @ mix, LEVELS[0], LEVELS[-1])


def propagate(corpus: DataFrame, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value of every word slot at the fixed point, NaN where no grade reaches; whether the slot is of the graded documents' language).

    What a round gathers and sends out is bounded by SLOTS, whatever the corpus.
    """
    spark = corpus.sparkSession
    edges = _edges(corpus, common)
    score, known = np.full(SLOTS, np.nan), np.zeros(SLOTS, bool)
    used = None
    xs: list[np.ndarray] = []
    fs: list[np.ndarray] = []
    for n in range(ROUNDS):
        sent = spark.sparkContext.broadcast((score.astype(np.float32), known))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, own = sent.value
            value_of, there = np.nan_to_num(now).astype(float), (~np.isnan(now)).astype(float)
            sums = np.zeros((5, SLOTS))
            for batch in batches:
                grade = batch.column("grade").to_numpy(zero_copy_only=False).astype(float)
                slot, w = batch.column("slots").flatten().to_numpy(), batch.column("weights").flatten().to_numpy().astype(float)
                doc = np.repeat(np.arange(len(batch)), batch.column("slots").value_lengths().to_numpy(zero_copy_only=False))
                per = lambda x: np.bincount(doc, x, len(batch))
                reached = per(w * there[slot])
                value = np.where(np.isnan(grade), per(w * value_of[slot]) / np.where(reached > 0, reached, np.nan), grade)  # graded documents stay clamped
                english = ~np.isnan(grade) | (per(w * own[slot]) >= KNOWN * np.maximum(per(w), 1e-9))
                ok = ~np.isnan(value[doc])
                for row, x in enumerate((np.where(ok, w * np.nan_to_num(value[doc]), 0.0), w * ok, w * ~np.isnan(grade[doc]), w * english[doc], w)):
                    sums[row] += np.bincount(slot, x, SLOTS)
            some = np.flatnonzero(sums[4])
            yield pa.RecordBatch.from_pydict({"slot": some.astype(np.int32), **{c: s[some] for c, s in zip("twgea", sums)}})

        schema = "slot int, t double, w double, g double, e double, a double"
        got = edges.mapInArrow(part, schema).groupBy("slot").agg(*[F.sum(c).alias(c) for c in "twgea"]).toPandas()  # at most SLOTS rows
        sent.unpersist()
        slot = got["slot"].to_numpy()
        new, kept = np.full(SLOTS, np.nan), known
        new[slot] = (got["t"] / got["w"].where(got["w"] > 0)).to_numpy()
        used = slot[got["g"].to_numpy() > 0] if used is None else used
        known = np.zeros(SLOTS, bool)
        known[used] = True
        if n:
            known[slot[(got["e"] >= SPOKEN * got["a"]).to_numpy()]] = True
        some = ~np.isnan(new)
        if not some.any():
            break
        same = np.array_equal(some, ~np.isnan(score)) and np.array_equal(known, kept)
        if same and np.abs(new[some] - score[some]).max() < TOLERANCE:
            score = new
            break
        if same:
            xs, fs = [*xs, score[some]][-HISTORY:], [*fs, new[some]][-HISTORY:]
            new[some] = _ahead(xs, fs)
        else:
            xs, fs = [], []
        score = new
    else:
        logging.getLogger(__name__).warning("word values still moved after %d rounds", ROUNDS)
    return score, known


def _final(corpus: DataFrame, score: np.ndarray, used: np.ndarray, common: np.ndarray, centres: np.ndarray | None) -> DataFrame:
    """Without centres: grade, score of graded documents. With: doc_id, reading_level, score of documents of prose."""
    sent = corpus.sparkSession.sparkContext.broadcast((score.astype(np.float32), used, common, centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, lines, mid = sent.value
        for batch in batches:
            b = _Batch(batch, lines)
            share = np.bincount(b.sentence, seen[b.slot], len(b.length)) / np.maximum(b.length, 1)
            prose = b.prose & (b.length >= 3)
            b.prose = english = prose & (share >= KNOWN)
            mean = b.of_docs(now)
            if mid is None:
                ok = ~np.isnan(b.grade) & ~np.isnan(mean)
                yield pa.RecordBatch.from_pydict({"grade": b.grade[ok], "score": mean[ok]})
                continue
            words = np.bincount(b.doc[english], b.tokens[english], b.docs)
            rest = np.bincount(b.doc[prose], b.tokens[prose], b.docs)
            m = b.means(now)
            ok = english & ~np.isnan(m)
            near = np.abs(m[:, None] - mid[None, :]).argmin(1) if len(m) else np.zeros(0, int)
            votes = np.zeros((b.docs, len(LEVELS)))
            np.add.at(votes, (b.doc[ok], near[ok]), 1)
            # Most sentences decide; on a tie the level nearer the document's own score.
            pull = np.abs(np.nan_to_num(mean, nan=mid.mean())[:, None] - mid[None, :])
            level = (votes - pull / (1 + pull.max(1, keepdims=True))).argmax(1)
            keep = (words >= LEAST_WORDS) & (words >= 0.5 * rest) & (votes.sum(1) > 0)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").filter(pa.array(keep)), "reading_level": np.array(LEVELS, np.int32)[level[keep]], "score": mean[keep]})

    return corpus.mapInArrow(run, "grade double, score double" if centres is None else "doc_id bigint, reading_level int, score double")


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, reading_level, score of every document with at least LEAST_WORDS words (stretches between blanks) of prose in the graded documents'
    language (English, whatever lang says).

    Null and empty texts, other languages, logs and junk have no row. A document's repeated row gives a row each. Without
    grades, or without documents, there are no rows. A level no grade stands for takes its place between its neighbours.
    """
    corpus = cut(parsed(documents).join(grades(labels), "doc_id", "left"), "corpus")
    common = _footers(corpus)
    score, used = propagate(corpus, common)
    if np.isnan(score).all():
        return corpus.sparkSession.createDataFrame([], "doc_id bigint, reading_level int, score double")
    graded = _final(corpus, score, used, common, None)
    found = {int(r["grade"]): r["m"] for r in graded.where(F.col("grade") == F.floor("grade")).groupBy("grade").agg(F.percentile_approx("score", 0.5, 10_000).alias("m")).collect()}
    if not found:
        return corpus.sparkSession.createDataFrame([], "doc_id bigint, reading_level int, score double")
    centres = np.interp(LEVELS, sorted(found), np.maximum.accumulate([found[k] for k in sorted(found)]))
    return _final(corpus, score, used, common, centres)
