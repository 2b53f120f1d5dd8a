"""Pieces of texts under the public byte-level BPE, found for whole batches at once.

The tokenizer's file splits a text into pieces (words with their leading space, numbers, other signs, white space)
and merges bytes inside each piece only. The split is a finite-state rule over character classes, so it is computed
on arrays; pieces are told apart by 64-bit hashes, and each distinct piece of a batch is looked at once.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import public_tokenizers
import regex

from cohortspark.llm import common as C

NAME = "byte_bpe_50k.json"
#: The endings that the tokenizer splits off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Fixed value: the one added token of the file; its string in a text is that token.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Characters of one batch, and distinct pieces that a worker remembers.
BATCH_CHARS, CACHE = 1 << 21, 500_000
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_CLASS: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point."""
    if not _CLASS:
        every = "".join(map(chr, range(0xD800))) + " " * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
        out = np.full(0x110000, OTHER, dtype=np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                out[m.start():m.end()] = kind
        _CLASS.append(out)
    return _CLASS[0]


class Pieces:
    """The pieces of several texts: start and end in the joined text, `doc_begin` with the first piece of each text."""

    def __init__(self, texts: list[str]):
        self.text = "".join(texts)
        code = np.frombuffer(self.text.encode("utf-32-le"), dtype="<u4")
        self.code, n = code, len(code)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begin = np.concatenate([[0], np.cumsum(sizes)])
        if not n:
            self.start = self.end = np.zeros(0, dtype=np.int64)
            self.doc_begin = np.zeros(len(texts) + 1, dtype=np.int64)
            return
        kind = classes()[code]
        first = np.zeros(n + 1, dtype=bool)  # of a text
        first[begin] = True
        # around a special token the text is split as if it ended and began there
        special = [m.span() for m in regex.finditer(regex.escape(SPECIAL), self.text)] if SPECIAL in self.text else []
        special = [x for x in special if not first[x[0] + 1:x[1]].any()]
        for x in special:
            first[list(x)] = True
        cut = np.ones(n + 1, dtype=bool)
        cut[1:n] = kind[1:] != kind[:-1]
        space = np.append(kind == SPACE, True)
        plain = np.append(code == 0x20, False)
        # the last white space before other characters stands alone, or leads the next piece if it is a space
        last = space[:n] & ~space[1:] & ~first[1:]
        cut[:n][last] = True
        cut[1:][last & plain[:n]] = False
        cut |= first
        quote = np.flatnonzero(code == 0x27)
        if len(quote):
            before = np.where(first[quote], SPACE, kind[quote - 1])
            stands = first[quote] | (before == LETTER) | (before == NUMBER) | ((before == SPACE) & ~plain[quote - 1])
            edge = np.flatnonzero(first)
            ends = edge[np.searchsorted(edge, quote[stands], side="right")]
            for at, end in zip(quote[stands].tolist(), ends.tolist()):
                tail = self.text[at + 1:min(at + 3, end)]
                for ending in ENDINGS:
                    if tail.startswith(ending):
                        cut[at + 1:at + 1 + len(ending)] = False
                        cut[at + 1 + len(ending)] = True
                        break
        for low, high in special:
            cut[low + 1:high] = False
        self.start = np.flatnonzero(cut[:n])
        self.end = np.append(self.start[1:], n)
        self.doc_begin = np.searchsorted(self.start, begin)

    def hashes(self) -> np.ndarray:
        values = C.mix(self.code.astype(np.uint64) + np.uint64(0x1234567))
        return C.range_hash(C.prefix_sums(values, C.BYTE_BASE), self.start, self.end, C.BYTE_BASE)

    def distinct(self) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Hashes of the distinct pieces, the first place of each, and for each piece its number among them."""
        kinds, first, inverse = np.unique(self.hashes(), return_index=True, return_inverse=True)
        return kinds.tolist(), first, inverse.ravel()

    def piece(self, i: int) -> str:
        return self.text[self.start[i]:self.end[i]]


class Ids:
    """Ids of texts; equal to what the tokenizers library gives for the file of the same vocabulary."""

    def __init__(self):
        import tiktoken

        path = public_tokenizers.path(NAME.replace(".json", ".tiktoken"))
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[int, bytes] = {}  # little-endian unsigned 32-bit ids

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and where each text's ids begin."""
        pieces = Pieces(texts)
        kinds, first, inverse = pieces.distinct()
        cache, merge = self.cache, self.encoding._encode_single_piece
        own = []
        for key, i in zip(kinds, first.tolist()):
            ids = cache.get(key)
            if ids is None:
                piece = pieces.piece(i)
                ids = cache[key] = array("I", (SPECIAL_ID,) if piece == SPECIAL else merge(piece)).tobytes()
            own.append(ids)
        if len(cache) > CACHE:
            cache.clear()
        size = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 4
        flat = np.frombuffer(b"".join(own), dtype="<u4")
        offset = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(own) else size
        n = size[inverse]
        at = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.repeat(offset[inverse] - at[:-1], n) + np.arange(at[-1])] if len(n) else flat
        return out, at[pieces.doc_begin]


_LOADED: list[Ids] = []


def ids() -> Ids:
    """The worker's own instance."""
    if not _LOADED:
        _LOADED.append(Ids())
    return _LOADED[0]
