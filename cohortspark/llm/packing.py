"""Best-fit packing by patterns: non-negative least squares on the histogram of lengths.

The plan depends on the histogram alone, which has at most `capacity` entries whatever the corpus.

1. Lengths are put into bins of `capacity / BINS` tokens. Patterns of one, two or three bins that fill a sequence are
   enumerated, repeat counts are fitted to the bin counts by non-negative least squares, and rounded down.
2. What the patterns leave over is packed best-fit decreasing, again on the histogram: all pieces of one length
   are placed at once into the sequences with the least room that takes them.
3. Every step yields intervals: the pieces of a length with ranks r0 to r1 go to consecutive sequences, at one position.
   Ranks come from running sums over (length, salt) counts, so a length with a third of all pieces is spread.

Offsets are running sums over the few pieces of one sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cohortspark.llm import bpe, common as C
from cohortspark.session import stable

CAPACITY = 2048
#: Bins of lengths for the patterns: the size of the least squares problem.
BINS = 128
#: Pieces of one rank group.
GROUP = 20_000


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: full ones, the first possibly shorter."""
    return ([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)


def tokenised_pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and a final 0, cut if longer than `capacity`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in C.slices(whole, 1)):
            rows: list[tuple[int, int, int, int, int]] = []
            ids, begin = bpe.ids().of([t or "" for t in batch.column(1).to_pylist()])
            for i in range(batch.num_rows):
                own = ids[begin[i]:begin[i + 1]].tobytes() + b"\0\0\0\0"
                at = 0
                for k, n in enumerate(cut_lengths(len(own) // 4, capacity)):
                    rows.append((i, k, at, n, C.crc(own[4 * at:4 * (at + n)])))
                    at += n
            cols = np.asarray(rows, dtype=np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), *map(pa.array, cols[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(bins: int) -> np.ndarray:
    """All ways to fill `bins` with one, two or three bins, as rows of (large, middle, small); 0 is nothing."""
    out = [(bins, 0, 0)]
    for a in range(bins - 1, 0, -1):
        for b in range(min(a, bins - a), 0, -1):
            c = bins - a - b
            if c <= b:
                out.append((a, b, c))
    return np.asarray(out)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 with the least |ax - b|, by the active-set method: columns enter by their gradient, negative ones leave."""
    x = np.zeros(a.shape[1])
    inside = np.zeros(a.shape[1], dtype=bool)
    for _ in range(rounds or 3 * a.shape[0]):
        gradient = a.T @ (b - a @ x)
        gradient[inside] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        inside[best] = True
        while True:
            trial = np.zeros_like(x)
            trial[inside] = np.linalg.lstsq(a[:, inside], b, rcond=None)[0]
            bad = inside & (trial <= 0)
            if not bad.any():
                x = trial
                break
            step = np.min(x[bad] / np.maximum(x[bad] - trial[bad], 1e-300))
            x = x + step * (trial - x)
            drop = inside & (x <= 1e-12)
            drop |= bad & (x <= x[bad].min())
            inside &= ~drop
            x[~inside] = 0
    return x


class Plan:
    """Placement of a histogram: rows of (length, r0, r1, sequence of rank r0, position)."""

    def __init__(self, counts: np.ndarray, capacity: int, bins: int = BINS):
        """counts[n]: pieces of length n."""
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.used = np.zeros(capacity + 1, dtype=np.int64)  # ranks handed out, by length
        self.counts, self.capacity = counts.astype(np.int64), capacity
        if counts.sum():
            if capacity % bins == 0 and capacity > bins:
                self._patterns(bins)
            self._best_fit()

    def _place(self, length: int, n: int, sequence: int, position: int) -> None:
        r = int(self.used[length])
        self.rows.append((length, r, r + n, sequence, position))
        self.used[length] += n

    def _patterns(self, bins: int) -> None:
        width = self.capacity // bins
        per_bin = np.add.reduceat(self.counts[1:], np.arange(0, self.capacity, width))
        kinds = patterns(bins)
        a = np.zeros((bins, len(kinds)))
        for place in range(3):
            some = kinds[:, place] > 0
            np.add.at(a, (kinds[some, place] - 1, np.flatnonzero(some)), 1.0)
        repeats = np.floor(nnls(a, per_bin.astype(float)) + 1e-6).astype(np.int64)
        left = per_bin.copy()
        for kind in np.argsort(-repeats, kind="stable"):
            parts, need = np.unique(kinds[kind][kinds[kind] > 0], return_counts=True)
            n = min(int(repeats[kind]), int((left[parts - 1] // need).min()))
            if n <= 0:
                continue
            position = 0
            for part, times in zip(parts[::-1], need[::-1]):
                left[part - 1] -= n * times
                for _ in range(times):
                    self._take_from_bin(int(part), width, n, position)
                    position += 1
            self.sequences += n

    def _take_from_bin(self, part: int, width: int, n: int, position: int) -> None:
        """The longest pieces left in a bin go to the next n sequences."""
        sequence = self.sequences
        for length in range(part * width, (part - 1) * width, -1):
            m = min(n, int(self.counts[length] - self.used[length]))
            if m:
                self._place(length, m, sequence, position)
                sequence, n = sequence + m, n - m
            if not n:
                return

    def _best_fit(self) -> None:
        room: dict[int, list[tuple[int, int, int]]] = {}  # room left -> (first sequence, how many, pieces in each)
        for length in range(self.capacity, 0, -1):
            n = int(self.counts[length] - self.used[length])
            space = length
            while n:
                while space <= self.capacity and not room.get(space):
                    space += 1
                if space > self.capacity:
                    fresh = -(-n // (self.capacity // length))
                    room.setdefault(self.capacity, []).append((self.sequences, fresh, 0))
                    self.sequences += fresh
                    space = self.capacity
                first, many, inside = room[space].pop()
                m = min(n, many)
                if m < many:
                    room[space].append((first + m, many - m, inside))
                self._place(length, m, first, inside)
                n -= m
                if space > length:
                    room.setdefault(space - length, []).append((first, m, inside + 1))
                    space = min(space, max(length, space - length))


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (each with a length of 1 to capacity) with sequence_id and offset.

    `pieces` is read twice; give a stored table.
    """
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[r["length"]] = r["count"]
    rows = Plan(counts, capacity).rows
    plan = spark.createDataFrame(rows, "_length long, _r0 long, _r1 long, _first long, _position int")
    salts = C.n_buckets(int(counts.sum()), GROUP)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = sizes.select("length", "_salt", (F.sum("_n").over(
        W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")).alias("_before"))
    order = W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_row", F.row_number().over(order) - 1).join(before, ["length", "_salt"])
    rank = F.col("_before") + F.col("_row")
    # the plan is as long as the capacity allows, not the corpus
    placed = ranked.withColumn("_rank", rank).join(
        F.broadcast(plan), F.expr("length = _length and _rank >= _r0 and _rank < _r1"))
    sequence = F.col("_first") + F.col("_rank") - F.col("_r0")
    inside = W.partitionBy("sequence_id").orderBy("_position").rowsBetween(W.unboundedPreceding, W.currentRow)
    return placed.withColumn("sequence_id", sequence).withColumn(
        "offset", F.sum("length").over(inside) - F.col("length")).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all documents in sequences of at most `capacity`.

    A document is its ids under the public byte-level BPE and a final 0. Longer ones are cut into pieces of
    `capacity`, the first possibly shorter; nothing else is cut. Null or empty text: the final 0 alone. Repeated rows
    are packed once for each row. An empty table gives no rows. Other columns are not read.
    """
    return packed(stable(tokenised_pieces(docs, capacity)), capacity)
