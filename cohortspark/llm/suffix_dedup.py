"""Suffix-array dedup: repeated byte strings by a depth-limited radix sort, most significant digit first.

A full suffix array is not needed to find strings of `length` bytes that occur twice: it is enough to order the
suffixes by their first `length` bytes, and of those only the groups that are still tied matter. The sort
therefore runs digit by digit; after each pass, suffixes that are alone with their digits drop out.

* *Runs.* The digits of a suffix are hashes of byte ranges that its first `length` bytes determine. The first one
  is the smallest hash of a `gram` inside those bytes. Neighbouring suffixes mostly share it, so a document is a
  sequence of runs of suffixes with equal first digit (about one run for 35 bytes), and a pass handles runs. The digit
  is mixed once more: smallest hashes crowd near zero, where one bucket would get nearly all of them.
* *Pass 1 and 2* order runs by the first digit and then by the content of the whole run. Equal runs repeat suffix
  by suffix: all but the first are repeats. A first digit with one content is done.
* *Pass 3* orders, at full depth, the suffixes of the runs whose first digit has several contents (a repeat begins
  or ends inside them) or that repeat inside themselves. Equal groups are exactly the repeated windows.

Documents are dealt to blocks of neighbouring ids. A block sorts locally, sends one entry for each kind to buckets
(ranges of the leading digit), and gets bits back. A string that a third of all documents share is one entry for
each block. Strings of different blocks are compared by 64-bit hashes, runs by two of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortspark.llm import common as C
from cohortspark.llm.substring_dedup import first_block_flags
from cohortspark.session import stable

LENGTH, GRAM = 100, 32
BLOCK_BYTES = 3 << 20
BUCKET_BYTES = 32 << 20


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbouring values, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


class Runs:
    """The runs of one block's suffixes, locally ordered.

    lo, hi: first and last suffix of a run, as places in the buffer; kind: number of its (digit, content) among the
    sorted kinds; first: whether no earlier run of the block has its kind; own: whether it may repeat inside itself.
    """

    def __init__(self, joined: C.Joined, length: int, gram: int):
        self.joined, self.length = joined, length
        self.sums = C.byte_sums(joined.buf)
        n, width = len(joined.buf), length - gram + 1
        empty = np.zeros(0, dtype=np.int64)
        self.lo = self.hi = self.kind = empty
        self.first = self.own = empty.astype(bool)
        self.digit = self.content = empty.astype(np.uint64)
        if n < length:
            return
        # as range_hash() of neighbouring places, on slices
        grams = C.mix((self.sums[gram:] - self.sums[:-gram]) * C.powers(C.BYTE_BASE, n)[1][:n - gram + 1])
        least = sliding_min(grams, width)  # one for each suffix with `length` bytes in the buffer
        # the last suffix of a document is the one that ends with it; the separator follows
        valid = np.zeros(len(least) + 1, dtype=np.int8)
        begin, end = joined.begin[:-1], joined.begin[1:] - length
        some = end > begin
        np.add.at(valid, begin[some], 1)
        np.add.at(valid, end[some], -1)
        valid = np.cumsum(valid[:-1]) > 0
        starts = np.zeros(len(least), dtype=bool)
        starts[begin[some]] = True
        same = np.zeros(len(least), dtype=bool)
        same[1:] = (least[1:] == least[:-1]) & valid[1:] & valid[:-1] & ~starts[1:]
        self.lo = np.flatnonzero(valid & ~same)
        if not len(self.lo):
            return
        follows = np.append(same[1:], False)
        self.hi = np.flatnonzero(valid & ~follows)
        again = np.concatenate([[0], np.cumsum(grams[:len(least)] == least)])
        self.own = again[self.hi] > again[self.lo]
        # minima crowd near zero; mixed (one to one) they spread evenly over the buckets
        digit = C.mix(least[self.lo])
        content = C.range_hash(self.sums, self.lo, self.hi + length, C.BYTE_BASE)
        order = np.lexsort((self.lo, content, digit))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (digit[order][1:] != digit[order][:-1]) | (content[order][1:] != content[order][:-1])
        self.kind = np.empty(len(order), dtype=np.int64)
        self.kind[order] = np.cumsum(new) - 1
        self.first = np.zeros(len(order), dtype=bool)
        self.first[order[new]] = True
        self.digit, self.content = digit[order[new]], content[order[new]]

    def suffixes(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes of the chosen runs in their order, and their full-depth digits."""
        lo, n = self.lo[runs], self.hi[runs] - self.lo[runs] + 1
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(lo) else lo
        return at, C.range_hash(self.sums, at, at + self.length, C.BYTE_BASE)


def _bits(data: list[bytes], buckets: list[int], edges: np.ndarray) -> np.ndarray:
    """The bits of all buckets in the order of the block's sorted keys; a missing bucket's are false."""
    out = np.zeros(edges[-1], dtype=bool)
    for bucket, bits in zip(buckets, data):
        low, high = edges[bucket], edges[bucket + 1]
        out[low:high] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=high - low).view(bool)
    return out


def _first_passes(buckets: int, length: int, gram: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        runs = Runs(C.Joined(C.block_texts(table)[2]), length, gram)
        edges = C.by_bucket(runs.digit, buckets)
        full = np.flatnonzero(np.diff(edges))
        part = [slice(edges[b], edges[b + 1]) for b in full]
        return pa.table({
            "bucket": pa.array(full, pa.int32()), "block": pa.array(np.full(len(full), key[0].as_py()), pa.int32()),
            "digit": pa.array([C.pack_sorted(runs.digit[p]) for p in part], pa.binary()),
            "content": pa.array([C.pack_values(runs.content[p]) for p in part], pa.binary())})

    return run


def _order_runs(table: pa.Table) -> pa.Table:
    """Bits for each run kind: an earlier block has it; its first digit has several contents."""
    blocks = table.column("block").to_numpy()
    order = np.argsort(blocks, kind="stable")
    digits = [C.unpack_sorted(table.column("digit")[int(i)].as_py()) for i in order]
    contents = np.concatenate([C.unpack_values(table.column("content")[int(i)].as_py(), "<u8") for i in order])
    cuts = np.cumsum([len(d) for d in digits])[:-1]
    digits = np.concatenate(digits)
    by = np.lexsort((contents, digits))  # stable: ties stay in the order of the blocks
    d, c = digits[by], contents[by]
    same_digit = np.append(False, d[1:] == d[:-1])
    same = same_digit & np.append(False, c[1:] == c[:-1])
    group = np.cumsum(~same_digit) - 1
    several = np.bincount(group, weights=~same)[group] > 1
    later, tied = np.empty(len(by), dtype=bool), np.empty(len(by), dtype=bool)
    later[by], tied[by] = same, several
    pack = lambda x: pa.array([np.packbits(p).tobytes() for p in np.split(x, cuts)], pa.binary())
    return pa.table({"block": pa.array(blocks[order], pa.int32()),
                     "bucket": pa.array(table.column("bucket").to_numpy()[order], pa.int32()),
                     "later": pack(later), "tied": pack(tied)})


def _tied(table: pa.Table, flags: pa.Table, buckets: int, length: int, gram: int):
    ids, known, texts = C.block_texts(table)
    runs = Runs(C.Joined(texts), length, gram)
    edges = C.by_bucket(runs.digit, buckets)
    where = flags.column("bucket").to_pylist()
    later = _bits(flags.column("later").to_pylist(), where, edges)[runs.kind]
    tied = _bits(flags.column("tied").to_pylist(), where, edges)[runs.kind]
    chosen = np.flatnonzero(runs.first & ~later & (tied | runs.own))
    return ids, known, runs, later | ~runs.first, chosen


def _last_pass(buckets: int, length: int, gram: int):
    def run(key: tuple, table: pa.Table, flags: pa.Table) -> pa.Table:
        _, _, runs, _, chosen = _tied(table, flags, buckets, length, gram)
        keys = C.distinct(runs.suffixes(chosen)[1])
        edges = C.by_bucket(keys, buckets)
        full = np.flatnonzero(np.diff(edges))
        return pa.table({
            "bucket": pa.array(full, pa.int32()), "block": pa.array(np.full(len(full), key[0].as_py()), pa.int32()),
            "data": pa.array([C.pack_sorted(keys[edges[b]:edges[b + 1]]) for b in full], pa.binary())})

    return run


def _remove(buckets: int, length: int, gram: int):
    def run(key: tuple, table: pa.Table, both: pa.Table) -> pa.Table:
        is_run = both.column("flags").is_null()
        ids, known, runs, whole, chosen = _tied(table, both.filter(is_run), buckets, length, gram)
        at, keys = runs.suffixes(chosen)
        kinds, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        flags = both.filter(pa.compute.invert(is_run))
        before = _bits(flags.column("flags").to_pylist(), flags.column("bucket").to_pylist(), C.by_bucket(kinds, buckets))
        inverse = inverse.ravel()
        gone = before[inverse]
        again = np.ones(len(at), dtype=bool)
        again[first] = False  # runs and their suffixes are in the order of the documents
        at = at[gone | again]
        buf = runs.joined.buf
        cover = np.zeros(len(buf) + 1, dtype=np.int32)
        np.add.at(cover, runs.lo[whole], 1)
        np.add.at(cover, runs.hi[whole] + length, -1)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        removed = np.cumsum(cover[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(removed)])
        edge = np.concatenate([[0], np.cumsum(removed & ~np.append(False, removed[:-1]))])
        begin, end = runs.joined.begin[:-1], runs.joined.begin[1:] - 1
        n_removed = total[end] - total[begin]
        kept = [buf[b:e][~removed[b:e]].tobytes() if n else t
                for t, b, e, n in zip(runs.joined.texts, begin, end, n_removed)]
        return pa.table({
            "doc_id": pa.array(np.where(known, ids, 0), pa.int64(), mask=~known),
            "n_bytes": pa.array(end - begin, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "n_spans": pa.array(edge[end] - edge[begin], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            "kept": pa.array([C.squeeze(k) if n else None for k, n in zip(kept, n_removed)], pa.binary())})

    return run


def remove_repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES,
                            bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): documents without bytes of repeated strings.

    Each byte goes that is covered by a string of `length` bytes which also starts earlier: in a document with a
    smaller doc_id, or in the same document at a smaller place (overlaps count). Strings are judged on the input and
    never cross documents; they may begin inside a character. `kept` holds the compressed remaining bytes of changed
    documents, else null.

    One row for each input row. Null or empty text: no bytes. Rows with equal doc_id follow each other in the order
    of their content, so the second of two equal rows is a repeat; a null doc_id counts as the largest. An empty
    table gives no rows. Other columns are not read.
    """
    total = C.text_bytes(docs)
    buckets = C.n_buckets(total, bucket_bytes)
    blocks = C.range_blocks(docs, C.n_buckets(total, block_bytes))
    entries = blocks.groupBy("block").applyInArrow(
        _first_passes(buckets, length, gram), "bucket int, block int, digit binary, content binary")
    runs = stable(entries.groupBy("bucket").applyInArrow(_order_runs, "block int, bucket int, later binary, tied binary"))
    windows = blocks.groupBy("block").cogroup(runs.groupBy("block")).applyInArrow(
        _last_pass(buckets, length, gram), "bucket int, block int, data binary")
    flags = stable(first_block_flags(windows))
    both = runs.unionByName(flags, allowMissingColumns=True)
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(
        _remove(buckets, length, gram),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
