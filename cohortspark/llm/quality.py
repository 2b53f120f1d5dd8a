"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a bag of *shapes*: runs of lower-case letters, capitals, digits and white space count as one sign each, other
signs stand for themselves, and four signs in a row are a term. One more term tells how often words repeat. Terms are
weighted by log frequency and rarity and projected on the leading directions of a bounded sample of labelled rows.
The sample's vectors are sent to all tasks; every document is compared with all of them, block by block, and the
labels of its nearest neighbours vote with the weight of their cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortspark.llm import bpe, common as C

#: Labelled rows that are compared with: the bound on the fit, drawn by a hash of the id.
FIT_ROWS = 4000
#: Hashed terms, latent directions, neighbours that vote, and the power of their cosine.
TERMS, DIRECTIONS, NEIGHBOURS, POWER = 4096, 64, 25, 8
THRESHOLD = 0.7
#: The last terms tell the share of words that repeat, in steps.
STEPS = 16
_SIGNS: list[np.ndarray] = []


def signs() -> np.ndarray:
    """Sign of every code point: 1 lower case and other letters, 2 capitals, 3 numbers, 4 white space, 5 line end, else 6 to 63."""
    if not _SIGNS:
        kind = bpe.classes()
        out = (np.arange(0x110000) % 58 + 6).astype(np.uint8)
        out[kind == bpe.LETTER] = 1
        upper = np.fromiter((chr(c).isupper() for c in range(0x3000)), dtype=bool, count=0x3000)
        out[:0x3000][upper & (kind[:0x3000] == bpe.LETTER)] = 2
        out[kind == bpe.NUMBER], out[kind == bpe.SPACE], out[0x0A] = 3, 4, 5
        _SIGNS.append(out)
    return _SIGNS[0]


def term_counts(texts: list[str]) -> np.ndarray:
    """Log frequencies of the terms, one row for each text."""
    out = np.zeros((len(texts), TERMS), dtype=np.float32)
    joined = "\0\0\0\0".join(texts) + "\0\0\0\0"
    code = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    sizes = np.fromiter((len(t) + 4 for t in texts), dtype=np.int64, count=len(texts))
    doc = np.repeat(np.arange(len(texts)), sizes)
    sign = signs()[code]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    inside = np.arange(len(code)) - begin[doc] < sizes[doc] - 4
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (sign[1:] != sign[:-1]) | (sign[1:] > 5)
    keep &= inside
    s, d = sign[keep].astype(np.int64), doc[keep]
    if len(s) > 3:
        same = d[3:] == d[:-3]
        term = (s[:-3] << 18 | s[1:-2] << 12 | s[2:-1] << 6 | s[3:])[same]
        term = (C.mix(term.astype(np.uint64)) % np.uint64(TERMS - STEPS)).astype(np.int64)
        np.add.at(out.reshape(-1), d[3:][same] * TERMS + term, 1.0)
    words = C.Joined([t.encode() for t in texts])
    if len(words.start):
        key = words.word_hashes() ^ C.mix(words.doc.astype(np.uint64))
        kinds, first = np.unique(key, return_index=True)
        n = np.diff(words.word_begin)
        distinct = np.bincount(words.doc[first], minlength=len(texts))
        some = n > 0
        share = (1 - distinct[some] / n[some]) * (STEPS - 1)
        out[np.flatnonzero(some), TERMS - STEPS + share.astype(np.int64)] += np.minimum(n[some], 50)
    return np.log1p(out)


@dataclass
class Model:
    """What scores a text: rarity of terms, the projection, unit vectors of the sample and their labels."""

    rarity: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = counts * self.rarity
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        x = x @ self.directions
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def vote(self, vectors: np.ndarray, leave_out: bool = False) -> np.ndarray:
        """Weighted share of label 1 among the nearest neighbours; a zero vector gets the prior."""
        out = np.full(len(vectors), self.prior)
        k = min(NEIGHBOURS, len(self.labels) - leave_out)
        if k < 1:
            return out
        for a in range(0, len(vectors), 256):
            block = vectors[a:a + 256]
            cosine = block @ self.vectors.T
            if leave_out:
                cosine[np.arange(len(block)), np.arange(a, a + len(block))] = -1
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0.0).astype(np.float64) ** POWER
            total = weight.sum(axis=1)
            some = total > 1e-9
            out[a:a + 256][some] = (weight * self.labels[near]).sum(axis=1)[some] / total[some]
        return np.clip(out, 0.0, 1.0)


def _leading(x: np.ndarray, k: int) -> np.ndarray:
    """The k leading right singular directions, by subspace iteration from a fixed start."""
    q = np.random.default_rng(7).standard_normal((x.shape[1], k + 16)).astype(np.float32)
    for _ in range(6):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    u, s, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :k]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """The model of the documents with a label, at most about `fit_rows` of them, without those held out."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~C.held_out()).groupBy(
        F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    n = known.count()
    share = min(1.0, fit_rows / n) if n else 1.0
    drawn = known.where(F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1 << 20)) < F.lit(round(share * (1 << 20))))
    rows = docs.join(F.broadcast(drawn), F.col("doc_id").cast("long") == F.col("_id"))  # about fit_rows rows

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            data = []
            for a, b in C.chunks([len(t) for t in texts], bpe.BATCH_CHARS // 2):
                for row in (x for c in range(a, b, 128) for x in term_counts(texts[c:min(c + 128, b)])):
                    at = np.flatnonzero(row)
                    data.append(at.astype("<u2").tobytes() + row[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["id", "label", "data"])

    found = rows.select(F.col("_id").alias("id"), F.col("_label").alias("label"), F.col("text").cast("string")).mapInArrow(
        sparse, "id long, label int, data binary").toPandas().sort_values(["id", "label"], kind="stable")
    x = np.zeros((len(found), TERMS), dtype=np.float32)
    for i, data in enumerate(found["data"]):
        m = len(data) // 6
        x[i, np.frombuffer(data[:2 * m], dtype="<u2")] = np.frombuffer(data[2 * m:], dtype="<f4")
    y = found["label"].to_numpy(dtype=np.float64)
    used = (x > 0).any(axis=1)
    x, y = x[used], y[used]
    if not len(x):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    rarity = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    model = Model(rarity, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, float(y.mean()))
    scaled = x * rarity
    scaled /= np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-12)
    model.directions = _leading(scaled, min(DIRECTIONS, len(x), TERMS)).astype(np.float32)
    model.vectors = model.project(x).astype(np.float32)
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, in one narrow pass over doc_id and text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FIT_ROWS vectors and the projection

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            scores = [np.zeros(0)]
            for a, b in C.chunks([len(t) for t in texts], bpe.BATCH_CHARS // 2):
                for c in range(a, b, 128):
                    scores.append(own.vote(own.project(term_counts(texts[c:min(c + 128, b)]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, score double").select(
        "doc_id", C.held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def rate_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): score 0 to 1, higher where label 1 is likelier.

    Learns from `labels.quality` of rows that are not held out; a doc_id with several labels has the largest.

    One row for each input row, repeated ids included. Text without any term (null, empty, a few signs) and text unlike
    every labelled one get the share of label 1. Without labels every score is 0.5. Ties between neighbours of
    equal cosine are broken by the order of their ids. An empty table gives no rows. Other columns are not read.
    """
    return score(docs, fit(docs, labels, "quality", fit_rows), threshold)
