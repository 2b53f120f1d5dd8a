"""Language ID by word-first backoff.

A word of the model is scored by its log frequency in each language. A word that the model does not know falls back to
its character n-grams, the longest first: the first length of which the model knows any n-gram scores the word. Words
that nothing is known of give no evidence. All words of a text count.

The model is fitted on a bounded sample of the training rows, so it fits into memory and is sent to all tasks.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cohortspark.llm import bpe, common as C

#: Bytes of text that the model is fitted on, drawn by a hash of the id; the bound on the fit.
FIT_BYTES = 6 << 20
#: Words and n-grams of the model, the most frequent ones.
MODEL_WORDS, MODEL_GRAMS = 60_000, 120_000
#: Longest character n-gram.
LONGEST = 5
#: The words whose evidence makes up a score: longer texts are not surer than that.
EVIDENCE = 20
#: Bytes of text scored at once, and distinct words that a worker remembers: what a task holds beside its Arrow batch.
CHUNK_BYTES, REMEMBERED = 1 << 18, 250_000
UNKNOWN = "und"


@dataclass
class Model:
    """Log odds of the languages for words and n-grams: rows that sum to one as probabilities."""

    langs: list[str]
    words: dict[str, tuple[float, ...]] = field(default_factory=dict)
    grams: dict[str, tuple[float, ...]] = field(default_factory=dict)

    def word(self, word: str) -> tuple[float, ...]:
        found = self.words.get(word)
        if found is not None:
            return found
        edged = f"<{word}>"
        for n in range(min(LONGEST, len(edged)), 0, -1):
            known = [g for i in range(len(edged) - n + 1) if (g := self.grams.get(edged[i:i + n])) is not None]
            if known:
                return tuple(sum(x) / len(known) for x in zip(*known))
        return (0.0,) * len(self.langs)


def _log_odds(counts: dict[str, list[float]], most: int, totals: list[float]) -> dict[str, tuple[float, ...]]:
    kept = sorted(counts, key=lambda k: (-sum(counts[k]), k))[:most]
    out = {}
    for key in kept:
        logs = [math.log((n + 0.5) / (t + 1.0)) for n, t in zip(counts[key], totals)]
        top = max(logs)
        norm = top + math.log(sum(math.exp(x - top) for x in logs))
        out[key] = tuple(x - norm for x in logs)
    return out


def fit(train: DataFrame, fit_bytes: int = FIT_BYTES, max_words: int = MODEL_WORDS, max_grams: int = MODEL_GRAMS) -> Model:
    """The model of a table with doc_id, text and a lang that is not null.

    At most about `fit_bytes` of text are used: a share of the rows by a hash of the id, the same in each run.
    """
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(1.0, fit_bytes / size) if size else 1.0
    drawn = train.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < F.lit(round(share * (1 << 20))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(bpe.regex.findall(r"\p{L}+", (text or "").lower()))
        rows = [(lang, w, n) for lang, words in found.items() for w, n in words.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())],
            ["lang", "word", "n"])

    counted = drawn.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(
        count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    langs = sorted(r[0] for r in drawn.select(F.col("lang").cast("string").alias("lang")).distinct().collect())
    at = {x: i for i, x in enumerate(langs)}
    words: dict[str, list[float]] = {}
    grams: dict[str, list[float]] = {}
    # as long as the sample has distinct words; fit_bytes bounds it
    for lang, word, n in counted.orderBy("lang", "word").toArrow().to_pandas().itertuples(index=False):
        words.setdefault(word, [0.0] * len(langs))[at[lang]] += n
        edged = f"<{word}>"
        for size in range(1, min(LONGEST, len(edged)) + 1):
            for i in range(len(edged) - size + 1):
                gram = edged[i:i + size]
                row = grams.get(gram)
                if row is None:
                    row = grams[gram] = [0.0] * len(langs)
                row[at[lang]] += n
    totals = [sum(w[i] for w in words.values()) for i in range(len(langs))]
    # words seen once say less than their n-grams
    often = {w: c for w, c in words.items() if sum(c) > 1}
    return Model(langs, _log_odds(often, max_words, totals), _log_odds(grams, max_grams, totals))


class Scorer:
    """Scores whole batches of texts; remembers a bounded number of words."""

    def __init__(self, model: Model):
        self.model = model
        self.cache: dict[int, int] = {}  # hash of a word: its row of log odds in `rows`
        self.rows = array("d")

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the summed log odds and the number of words."""
        texts = [t.lower() for t in texts]
        joined = "\n".join(texts) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        letter = np.concatenate([[0], (bpe.classes()[code] == bpe.LETTER).view(np.int8), [0]]).astype(np.int8)
        edge = np.diff(letter)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        first_word = np.searchsorted(start, begin)
        n = np.diff(first_word)
        total = np.zeros((len(texts), len(self.model.langs)))
        if len(start) and self.model.langs:
            hashes = C.range_hash(C.prefix_sums(C.mix(code.astype(np.uint64) + np.uint64(77)), C.BYTE_BASE), start, end, C.BYTE_BASE)
            kinds, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            if len(self.cache) > REMEMBERED:
                self.cache, self.rows = {}, array("d")
            cache, score, own = self.cache, self.model.word, []
            for key, i in zip(kinds.tolist(), first.tolist()):
                row = cache.get(key)
                if row is None:
                    row = cache[key] = len(cache)
                    self.rows.extend(score(joined[start[i]:end[i]]))
                own.append(row)
            odds = np.frombuffer(self.rows).reshape(-1, len(self.model.langs))[own]
            some = n > 0
            total[some] = np.add.reduceat(odds[inverse.ravel()], first_word[:-1][some], axis=0)
        return total, n

    def choose(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text the number of the likeliest language, -1 without a letter, and its probability."""
        best, score = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        for a, b in C.chunks(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), CHUNK_BYTES):
            total, n = self.of([t or "" for t in texts.slice(a, b - a).to_pylist()])
            if not self.model.langs:
                n[:] = 0
                total = np.zeros((len(n), 1))
            odds = total * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None]
            odds = np.exp(odds - odds.max(axis=1, keepdims=True))
            odds /= odds.sum(axis=1, keepdims=True)
            best.append(np.where(n > 0, odds.argmax(axis=1), -1))
            score.append(np.where(n > 0, odds.max(axis=1), 0.0))
        return np.concatenate(best), np.concatenate(score)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id with lang_pred and score; reads doc_id and text only, in one narrow pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the numbers of words and n-grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        names = np.asarray([*sent.value.langs, UNKNOWN], dtype=object)
        for batch in batches:
            best, score = scorer.choose(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~C.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")


def identify(docs: DataFrame, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document.

    Learns from text and lang of rows whose id is not held out and whose lang is not null. `score`: the probability
    of lang_pred among the learned languages, on the evidence of at most EVIDENCE words.

    One row for each input row, repeated ids included. Text that is null or has no letter: `und`, score 0. Ties go to
    the language first in the alphabet. Words of an unknown script give no evidence (all languages alike). Without
    any training row, and in an empty table, nothing is learned: `und`. Other columns are not read.
    """
    return predict(docs, fit(training_rows(docs), fit_bytes)).withColumn("held_out", C.held_out()).select(
        "doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """The documents whose language is identified: a letter in the text, and one language likelier than all others."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs), fit_bytes))

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(sent.value)
        for batch in texts:
            yield pa.array(scorer.choose(batch)[1])

    return docs.where(score(F.col("text").cast("string")) >= least)
