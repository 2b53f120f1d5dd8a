"""Periodic runs of words, found with a run-length grammar made by recompression.

*Grammar.* The words of a batch of texts, a separator of its own before and after each text, are compressed in turns:
blocks of equal symbols become one symbol each, then symbols are dealt to two sides and every pair of a left and a
right one becomes one symbol. Equal stretches get equal symbols but for a few at their edges, so every level is a
locally consistent parse of the words.

*Extensions.* How far the words from two places agree is read off the levels: a query climbs as long as it agrees, at most
a few symbols on each level, then comes down to the first word that differs. Read from right to left, the same levels
answer how far the words before two places agree. No suffix array is needed.

*Candidates.* A run of period p and at least 4p words holds four places in a row of the grid of multiples of p with the
same word. All grids together have n ln n places. Of the places in a row that pass, the first is asked; what
lies in the run it finds needs no further question.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortspark.llm import common as C

#: Fixed values of the definition: a run has at least LEAST words and EXPONENT periods.
LEAST, EXPONENT = 6, 4
#: Bytes of texts that share one grammar.
BATCH = 4 << 20
#: Rounds of compression at most; a round leaves at most three quarters of the symbols on average.
ROUNDS = 64


class Level:
    """One level of the parse: symbols, where each begins (in words), and `upper_end`, the end of the next level's symbol over each."""

    def __init__(self, symbol: np.ndarray, start: np.ndarray):
        self.symbol, self.start = symbol, start

    def reversed(self, n: int) -> Level:
        end = np.append(self.start[1:], n)
        return Level(self.symbol[::-1], n - end[::-1])


class Grammar:
    """Levels of the parse of a sequence whose first and last symbol occur once; `blocks[h]` tells whether level h + 1 joins blocks."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        rng = np.random.default_rng(len(words))
        symbol, start = words.astype(np.int64), np.arange(len(words))
        self.levels, self.blocks = [Level(symbol, start)], []
        names = int(symbol.max()) + 1 if len(symbol) else 1
        for _ in range(ROUNDS):
            symbol, start, names, joined = self.join_blocks(symbol, start, names)
            if joined:
                self.levels.append(Level(symbol, start))
                self.blocks.append(True)
            symbol, start, names, paired = self.join_pairs(symbol, start, names, rng)
            if paired:
                self.levels.append(Level(symbol, start))
                self.blocks.append(False)
            if len(symbol) <= 3:
                break

    @staticmethod
    def join_blocks(symbol: np.ndarray, start: np.ndarray, names: int) -> tuple[np.ndarray, np.ndarray, int, bool]:
        at = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
        if len(at) == len(symbol):
            return symbol, start, names, False
        count = np.diff(np.append(at, len(symbol)))
        out = symbol[at]
        many = np.flatnonzero(count > 1)
        number, kinds = pd.factorize(out[many] * (int(count.max()) + 1) + count[many])
        out[many] = names + number
        return out, start[at], names + len(kinds), True

    @staticmethod
    def join_pairs(symbol: np.ndarray, start: np.ndarray, names: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, int, bool]:
        present, number = np.unique(symbol, return_inverse=True) if names > 8 * len(symbol) else (None, symbol)
        left = (rng.random(names if present is None else len(present)) < 0.5)[number]
        head = np.flatnonzero(left[:-1] & ~left[1:])
        if not len(head):
            return symbol, start, names, False
        joined, kinds = pd.factorize(symbol[head] * names + symbol[head + 1])
        out = symbol.copy()
        out[head] = names + joined
        keep = np.ones(len(symbol), dtype=bool)
        keep[head + 1] = False
        return out[keep], start[keep], names + len(kinds), True

    def reversed(self) -> Grammar:
        """The same parse read from right to left."""
        out = object.__new__(Grammar)
        out.n, out.blocks = self.n, self.blocks
        out.levels = [x.reversed(self.n) for x in self.levels]
        return out

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from x on are the same as from y on; x and y differ, and the words differ somewhere before the end."""
        begin, x, y = x, x.copy(), y.copy()
        failed = np.full(len(x), len(self.levels) - 1)  # the highest level at which the places were compared and differed
        top = len(self.levels) - 1
        todo = np.arange(len(x))
        for h in range(top):
            active = todo
            while len(active):  # until both places are where a symbol of the next level begins
                upper = self.levels[h + 1].start
                i, j = (np.searchsorted(upper, p[active], side="right") - 1 for p in (x, y))
                active = active[(upper[i] != x[active]) | (upper[j] != y[active])]
                differ = self.step(h, x, y, active)
                failed[active[differ]] = h
                active = active[~differ]
            todo = todo[failed[todo] == top]
        for h in range(top, -1, -1):
            active = np.flatnonzero(failed >= h)
            while len(active):
                active = active[~self.step(h, x, y, active)]
        return x - begin

    def step(self, h: int, x: np.ndarray, y: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Where the symbols at both places are equal, move both over them; a block is passed at once as far as both have it."""
        level = self.levels[h]
        i, j = (np.searchsorted(level.start, p[active]) for p in (x, y))
        differ = level.symbol[i] != level.symbol[j]
        go, i, j = active[~differ], i[~differ], j[~differ]
        if not len(go):
            return differ
        if h < len(self.blocks) and self.blocks[h]:
            end = np.append(self.levels[h + 1].start[1:], self.n)
            rest = [end[np.searchsorted(self.levels[h + 1].start, p[go], side="right") - 1] - p[go] for p in (x, y)]
            move = np.minimum(*rest)
        else:
            move = np.append(level.start[1:], self.n)[i] - level.start[i]
        x[go] += move
        y[go] += move
        return differ


def grid_places(words: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(p, places): grid places of each period with the same word at the next three; `longest`: words of the longest text."""
    for p in range(1, longest // EXPONENT + 1):
        grid = words[::p]
        same = grid[1:] == grid[:-1]
        four = same[:-2] & same[1:-1] & same[2:]
        at = np.flatnonzero(four)
        if len(at):
            yield p, at * p


def runs_of(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of a sequence whose texts are set apart by symbols that occur once."""
    none = np.zeros(0, dtype=np.int64)
    found = [(none, none, none)]
    waiting = [(np.full(len(at), p), at) for p, at in grid_places(words, longest)]
    if waiting:
        grammar = Grammar(words)
        back = grammar.reversed()
        n = len(words)
        period, place = (np.concatenate(x) for x in zip(*waiting))
        # places in a row on one grid form a chain; the first of each chain is asked, then 2, 4, ... of what is left of it
        chain = np.cumsum(np.append(True, (period[1:] != period[:-1]) | (place[1:] != place[:-1] + period[1:])))
        many = 1
        while len(place):
            rank = np.arange(len(place)) - np.searchsorted(chain, chain)
            ask = rank < many
            x, p = place[ask], period[ask]
            ahead = grammar.extension(x, x + p)
            behind = back.extension(n - x, n - (x + p))
            start, end = x - behind, x + p + ahead
            good = end - start >= np.maximum(LEAST, EXPONENT * p)
            found.append((start[good], end[good], p[good]))
            # a place whose four words lie inside the run found from the place asked before it finds the same run
            last = np.searchsorted(chain[ask], chain, side="right") - 1
            covered = good[last] & (place >= start[last]) & (place + EXPONENT * period - period < end[last])
            stay = ~ask & ~covered
            period, place, chain = period[stay], place[stay], chain[stay]
            many *= 2
    start, end, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])  # of a stretch only the smallest period counts
    return start[new], end[new], period[new]


def repeated_from_id(doc_id: int, n: int) -> np.ndarray:
    """The word that stands at each place of a text of n words, when texts whose id says so repeat a stretch of theirs."""
    h = zlib.crc32(str(doc_id).encode())
    at = np.arange(n)
    if h % 10 == 0 and n > 0:
        g = h // 10
        a = g % n
        at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def find_runs(docs: DataFrame, edit: Callable[[int, int], np.ndarray] | None = None, kept: bool = True) -> DataFrame:
    """(doc_id, n_words, runs, collapsed, runs_sha256, collapsed_sha256): the periodic runs of words of each whole text.

    Words are runs of anything but ASCII white space. runs: array of (start, length, period) by start, then period, in
    words from 0. A run has at least 6 words and 4 periods and cannot be extended. collapsed: the text's words without
    those that a run repeats after its first period, joined by one space; null if `kept` is false. The digests are those of
    `runs` as lines of start,length,period and of `collapsed`.
    edit: gives for an id and a number of words the word that is to stand at each place (None: the text as it is).

    One row for each input row, repeated ids included; one narrow pass without a shuffle. Null, empty and blank texts have
    no words and no runs; a row without an id is not edited. Ties need no rule: all runs are returned. A very long text is a batch of
    its own. An empty table gives no rows. Other columns are not read.
    """

    def batch_rows(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        words = [t.split() for t in texts]  # exactly the ASCII white space
        if edit is not None:
            for i, (doc_id, own) in enumerate(zip(ids, words)):
                if doc_id is not None and own:
                    at = edit(doc_id, len(own))
                    if not np.array_equal(at, np.arange(len(own))):
                        words[i] = [own[k] for k in at.tolist()]
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        begin = np.concatenate([[0], np.cumsum(size + 1)]) + 1  # a separator before each text
        flat = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode()
        kinds = len(flat.dictionary)
        sequence = np.empty(int(begin[-1]), dtype=np.int64)
        is_word = np.ones(len(sequence), dtype=bool)
        is_word[begin - 1] = False
        sequence[is_word] = flat.indices.to_numpy(zero_copy_only=False)
        sequence[begin - 1] = kinds + np.arange(len(begin))
        start, end, period = runs_of(sequence, int(size.max(initial=0)))
        edges = np.searchsorted(start, begin)
        counts = np.zeros(len(sequence) + 1, dtype=np.int64)
        np.add.at(counts, start + period, 1)
        np.add.at(counts, end, -1)
        dropped = np.cumsum(counts) > 0
        out_runs, lines, left = [], [], []
        for i, own in enumerate(words):
            lo, hi, first = int(edges[i]), int(edges[i + 1]), int(begin[i])
            rows = list(zip((start[lo:hi] - first).tolist(), (end[lo:hi] - start[lo:hi]).tolist(), period[lo:hi].tolist()))
            rows.sort(key=lambda r: (r[0], r[2]))
            out_runs.append([dict(zip(("start", "length", "period"), r)) for r in rows])
            lines.append("".join(f"{s},{n},{p}\n" for s, n, p in rows).encode())
            if rows:
                gone = dropped[first:first + len(own)].tolist()
                own = [w for w, x in zip(own, gone) if not x]
            left.append(b" ".join(own))
        run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        sha = lambda parts: pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(size), pa.array(out_runs, run_type),
             pa.array([x.decode() for x in left] if kept else [None] * len(left), pa.string()), sha(lines), sha(left)],
            ["doc_id", "n_words", "runs", "collapsed", "runs_sha256", "collapsed_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), C.binary(batch.column(1))
            for a, b in C.chunks([len(t) for t in texts], BATCH):
                yield batch_rows(ids[a:b], texts[a:b])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string, "
             "runs_sha256 string, collapsed_sha256 string")


def longest_run(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) from the rows of find_runs().

    The run with the most periods by exact fractions; ties go to the smallest start, then the smallest period. Without a
    run its four columns are null.
    """
    more = lambda a, b: (
        F.when(a.length * b.period != b.length * a.period, a.length * b.period > b.length * a.period)
        .when(a.start != b.start, a.start < b.start).otherwise(a.period <= b.period))
    best = F.when(F.size("runs") > 0, F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.element_at("runs", 1),
                                                  lambda a, b: F.when(more(a, b), a).otherwise(b)))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
