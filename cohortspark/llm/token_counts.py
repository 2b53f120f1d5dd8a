"""Token counts by finite-state transducers.

*Pieces.* The split of a text into pieces is a finite-state rule over character classes (bpe.py).

*Merges.* Inside a piece, byte pair encoding is compiled to a deterministic transducer. Its transitions carry the
change of the token count. After i bytes the last token of the encoding is the one suffix token that may stand next to
the encoding's last token before it; so a state needs the longest suffix that begins some token, and for each place
in it the last token and the count there, relative to the current one. Both are bounded by the longest token, so the
transducer is finite; states are compiled when a text first reaches them and kept up to a bound.

*Composition.* The start of a piece leads every state to the initial one. The state map of a chunk that begins with
a piece is therefore constant in the state and additive in the count, and maps of all pieces of a batch compose by one
parallel prefix sum, from which each text reads its count.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortspark.llm import bpe, common as C

#: Tokens beyond which a text is over the limit.
LIMIT = 512
#: Compiled states and transitions that a worker keeps.
STATES = 150_000


class Merges:
    """Vocabulary and merge ranks of a byte-level BPE file."""

    def __init__(self, name: str):
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            model = json.load(f)["model"]
        # fixed rule of byte-level files: printable bytes stand for themselves, the others for 256 and up
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(own))}
        raw = lambda token: bytes(byte[c] for c in token)
        self.tokens = {raw(t) for t in model["vocab"]}
        self.rank, self.split = {}, {}
        for i, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            pair = raw(a), raw(b)
            self.rank[pair], self.split[pair[0] + pair[1]] = i, pair
        self.prefixes = {t[:n] for t in self.tokens for n in range(len(t) + 1)}
        self.edges: tuple[dict, dict] = {}, {}

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand at one side of a token while it is merged, and the rank at which each is merged away."""
        found = self.edges[side].get(token)
        if found is None:
            found, part, until = [], token, 1 << 30
            while True:
                found.append((part, until))
                if part not in self.split:
                    break
                part, until = self.split[part][side], self.rank[self.split[part]]
            self.edges[side][token] = found
        return found

    def adjacent(self, a: bytes, b: bytes) -> bool:
        """Whether two tokens may stand next to each other: no merge across the border comes first.

        Of equal ranks the merge further left comes first.
        """
        rank = self.rank
        for x, x_until in self.edge(a, 1):
            for y, y_until in self.edge(b, 0):
                r = rank.get((x, y))
                if r is not None and r < x_until and r <= y_until:
                    return False
        return True


class CountTransducer:
    """Counts the tokens of one piece byte by byte. `next` maps (state, byte) to (state, change of the count)."""

    def __init__(self, name: str = bpe.NAME):
        self.merges = Merges(name)
        self.reset()

    def reset(self) -> None:
        # a state: the suffix that begins a token, and (last token, relative count) at each place in it
        self.keys: list[tuple[bytes, tuple]] = [(b"", ((None, 0),))]
        self.number = {self.keys[0]: 0}
        self.next: dict[int, tuple[int, int]] = {}

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        suffix, places = self.keys[state]
        text = suffix + bytes((byte,))
        merges = self.merges
        for n in range(len(text), 0, -1):
            token = text[-n:]
            if token in merges.tokens:
                last, count = places[len(text) - n]
                if last is None or merges.adjacent(last, token):
                    break
        change = count + 1
        keep = len(text)
        while text[len(text) - keep:] not in merges.prefixes:
            keep -= 1
        after = tuple((t, c - change) for t, c in places[len(text) - keep:]) + ((token, 0),)
        key = (text[len(text) - keep:], after)
        target = self.number.get(key)
        if target is None:
            target = self.number[key] = len(self.keys)
            self.keys.append(key)
        self.next[state << 8 | byte] = (target, change)
        return target, change

    def count(self, piece: bytes) -> int:
        if len(self.keys) > STATES:
            self.reset()
        state = total = 0
        step = self.next
        for byte in piece:
            found = step.get(state << 8 | byte)
            if found is None:
                found = self.compile(state, byte)
            state, change = found
            total += change
        return total


class Counter:
    """Token counts of texts, with a bounded memory of pieces."""

    def __init__(self, name: str):
        self.transducer = CountTransducer(name)
        self.cache: dict[int, int] = {}

    def of(self, texts: list[str]) -> np.ndarray:
        pieces = bpe.Pieces(texts)
        kinds, first, inverse = pieces.distinct()
        cache, count = self.cache, self.transducer.count
        own = []
        for key, i in zip(kinds, first.tolist()):
            n = cache.get(key)
            if n is None:
                piece = pieces.piece(i)
                n = cache[key] = 1 if piece == bpe.SPECIAL else count(piece.encode())
            own.append(n)
        if len(cache) > bpe.CACHE:
            cache.clear()
        scan = np.concatenate([[0], np.cumsum(np.asarray(own, dtype=np.int64)[inverse])])
        return np.diff(scan[pieces.doc_begin])


_LOADED: dict[str, Counter] = {}


def counter(name: str) -> Counter:
    """The worker's own instance."""
    if name not in _LOADED:
        _LOADED[name] = Counter(name)
    return _LOADED[name]


def token_counts(docs: DataFrame, name: str = bpe.NAME, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each whole text, as the tokenizers library counts them.

    `name`: a byte-level BPE file of public_tokenizers with that library's usual split. No begin, end or padding; the
    string of the added token inside a text counts as that token. One narrow pass without a shuffle.

    One row for each input row, repeated ids included. Null or empty text: no bytes and no tokens. A very long text
    is one batch of its own. An empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [counter(name).of(texts[a:b]) for a, b in C.chunks([len(t) for t in texts], bpe.BATCH_CHARS)]
            n = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
            size = np.fromiter((len(t.encode()) for t in texts), dtype=np.int64, count=len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
