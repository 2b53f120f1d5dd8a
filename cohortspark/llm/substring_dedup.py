"""Substring dedup: recurring word passages are confirmed, compiled into automata and located in every document.

1. *Blocks.* Documents are dealt to blocks of neighbouring ids (a few MB of text each).
2. *Confirm.* Each block sends the sorted distinct hashes of its 13-word windows to buckets, which are ranges of
   the hash. A bucket answers each block with one bit for each hash: an earlier block has it too. A window that a
   third of all documents share is one entry for each block, whatever the number of copies.
3. *Compile and stream.* Each block compiles an Aho-Corasick automaton of phrases of the windows that are confirmed
   there (the block is the shard: an automaton holds only what can occur in its documents): of each window the
   six-word phrase with the least hash, which neighbouring windows mostly share. It streams all its documents
   through the automaton; the windows around the hits are looked up among the confirmed ones, which locates every
   occurrence. A word is one symbol of the automaton.

Blocks rise with doc_id, so "an earlier block has it" means "a smaller doc_id has it"; inside a block the
order of the documents tells the first one. Windows of different blocks are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortspark.llm import common as C
from cohortspark.session import stable

#: Words of a window, and of a phrase of the automaton.
WINDOW = 13
PHRASE = 6
#: Text of one block and windows of one bucket, in bytes of text; both bound the memory of a task.
BLOCK_BYTES = 3 << 20
BUCKET_BYTES = 8 << 20


def _entries(buckets: int, length: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, _, texts = C.block_texts(table)
        joined = C.Joined(texts)
        keys = C.distinct(joined.windows(joined.word_hashes(), length)[0])
        edges = C.by_bucket(keys, buckets)
        full = np.flatnonzero(np.diff(edges))
        return pa.table({
            "bucket": pa.array(full, pa.int32()), "block": pa.array(np.full(len(full), key[0].as_py()), pa.int32()),
            "data": pa.array([C.pack_sorted(keys[edges[b]:edges[b + 1]]) for b in full], pa.binary())})

    return run


def first_block_flags(entries: DataFrame) -> DataFrame:
    """(block, bucket, flags): for each sorted hash of a block's part of a bucket, whether an earlier block has it."""

    def run(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_numpy()
        order = np.argsort(blocks, kind="stable")
        data = table.column("data").to_pylist()
        keys = [C.unpack_sorted(data[i]) for i in order]
        sizes = [len(k) for k in keys]
        merged = np.concatenate(keys)
        by_key = np.argsort(merged, kind="stable")
        later = np.zeros(len(merged), dtype=bool)
        later[by_key[1:]] = merged[by_key[1:]] == merged[by_key[:-1]]
        parts = np.split(later, np.cumsum(sizes)[:-1])
        return pa.table({
            "block": pa.array(blocks[order], pa.int32()),
            "bucket": pa.array(table.column("bucket").to_numpy()[order], pa.int32()),
            "flags": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())})

    return entries.groupBy("bucket").applyInArrow(run, "block int, bucket int, flags binary")


def _symbols(hashes: np.ndarray, wanted: np.ndarray) -> str:
    """One character for each word: equal words of the wanted ones get equal characters, all others the first one."""
    kinds = C.distinct(hashes[wanted])
    if len(kinds) > 0x10F000:
        raise ValueError("a block has more distinct recurring words than there are characters; use smaller blocks")
    code = np.arange(2, len(kinds) + 2, dtype=np.uint32)
    code[code >= 0xD800] += 0x800  # no surrogates
    place = np.minimum(np.searchsorted(kinds, hashes), len(kinds) - 1)
    ids = np.where(kinds[place] == hashes, code[place], np.uint32(1))
    return ids.astype("<u4").tobytes().decode("utf-32-le")


def anchors(phrases: np.ndarray, windows: np.ndarray, room: int) -> np.ndarray:
    """For each window (the word it starts at), the word at which its least phrase starts.

    `phrases`: hashes of the phrases by the word they start at; a window has `room` of them. Overlapping windows mostly
    share their least phrase, so a passage has few.
    """
    best, where = phrases[windows], windows.copy()
    for k in range(1, room):
        value = phrases[windows + k]
        less = value < best
        best[less], where[less] = value[less], windows[less] + k
    return where


def covered_words(joined: C.Joined, ids: np.ndarray, seen_before: np.ndarray, length: int = WINDOW) -> np.ndarray:
    """For each word of the block, whether a window covers it that also starts in a document with a smaller id.

    `ids`: of the documents, ascending. `seen_before`: sorted hashes of the windows that an earlier block holds.
    The automaton holds the least phrase of each confirmed window; every occurrence of the window holds that phrase, so
    the windows around the hits are all there are.
    """
    hashes = joined.word_hashes()
    keys, at = joined.windows(hashes, length)
    cover = np.zeros(len(hashes) + 1, dtype=np.int32)
    if not len(keys):
        return cover[:-1] > 0
    kinds, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    inverse = inverse.ravel()
    earlier = np.isin(kinds, seen_before, assume_unique=True)
    first_id = ids[joined.doc[at[first]]]
    many = np.zeros(len(kinds), dtype=bool)
    many[inverse[ids[joined.doc[at]] > first_id[inverse]]] = True
    confirmed = earlier | many
    if not confirmed.any():
        return cover[:-1] > 0
    phrase = min(PHRASE, length)
    room = length - phrase + 1
    starts = np.arange(len(hashes) - phrase + 1)
    phrases = C.range_hash(C.prefix_sums(hashes, C.WORD_BASE), starts, starts + phrase, C.WORD_BASE)
    held = C.distinct(anchors(phrases, at[first[confirmed]], room))
    held = held[np.unique(phrases[held], return_index=True)[1]]
    text = _symbols(hashes, (held[:, None] + np.arange(phrase)).ravel())
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for start in held.tolist():
        automaton.add_word(text[start:start + phrase])
    automaton.make_automaton()
    hits = np.fromiter((end for end, _ in automaton.iter(text)), dtype=np.int64) - phrase + 1
    near = np.zeros(len(hashes) + room, dtype=np.int32)
    np.add.at(near, np.maximum(hits - room + 1, 0), 1)
    np.add.at(near, hits + 1, -1)
    met = np.flatnonzero(np.cumsum(near)[at] > 0)  # windows that hold a phrase of the automaton
    kind = inverse[met]
    gone = at[met[earlier[kind] | (many[kind] & (ids[joined.doc[at[met]]] > first_id[kind]))]]
    np.add.at(cover, gone, 1)
    np.add.at(cover, gone + length, -1)
    return np.cumsum(cover[:-1]) > 0


def _clean(buckets: int, length: int):
    def run(key: tuple, table: pa.Table, flags: pa.Table) -> pa.Table:
        ids, known, texts = C.block_texts(table)
        joined = C.Joined(texts)
        keys = C.distinct(joined.windows(joined.word_hashes(), length)[0])
        edges = C.by_bucket(keys, buckets)
        before = []
        for bucket, bits in zip(flags.column("bucket").to_pylist(), flags.column("flags").to_pylist()):
            part = keys[edges[bucket]:edges[bucket + 1]]
            before.append(part[np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=len(part)).view(bool)])
        gone = covered_words(joined, ids, np.sort(np.concatenate(before)) if before else keys[:0], length)
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[joined.word_begin[1:]] - total[joined.word_begin[:-1]]
        kept = []
        for d, text in enumerate(texts):
            words = text.split()
            if removed[d]:
                words = compress(words, (~gone[joined.word_begin[d]:joined.word_begin[d + 1]]).tolist())
            kept.append(b" ".join(words))
        return pa.table({
            "doc_id": pa.array(np.where(known, ids, 0), pa.int64(), mask=~known),
            "n_words": pa.array(np.diff(joined.word_begin), pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            "kept": pa.array([C.squeeze(k) if r else None for k, r in zip(kept, removed)], pa.binary()),
            "text_sha256": pa.array([hashlib.sha256(t).hexdigest() if r else None for t, r in zip(texts, removed)], pa.string())})

    return run


def _removals(docs: DataFrame, length: int, block_bytes: int, bucket_bytes: int) -> DataFrame:
    """remove_repeated_passages with text_sha256, the input text's digest where words were removed."""
    total = C.text_bytes(docs)
    buckets = C.n_buckets(total, bucket_bytes)
    blocks = C.range_blocks(docs, C.n_buckets(total, block_bytes))
    entries = blocks.groupBy("block").applyInArrow(_entries(buckets, length), "bucket int, block int, data binary")
    flags = stable(first_block_flags(entries))
    return blocks.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(
        _clean(buckets, length), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary, text_sha256 string")


def remove_repeated_passages(docs: DataFrame, length: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                             bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): documents without words that an earlier document's window covers.

    Words are runs of anything but ASCII white space and are compared byte by byte. A window is `length`
    neighbouring words of one document; a word goes if a window that covers it also starts in a document with a
    smaller doc_id, judged on the input. `kept` holds the compressed remaining words joined by a space where
    words were removed, else null.

    One row for each input row. Null or empty text: no words. Fewer than `length` words: nothing is removed. Rows
    with equal doc_id are no smaller than each other, so they don't remove each other's words; a null doc_id
    counts as the largest. An empty table gives no rows. Other columns are not read.
    """
    return _removals(docs, length, block_bytes, bucket_bytes).drop("text_sha256")


def remaining_documents(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """The documents with repeated passages removed; a document that loses all its words goes.

    Changed texts are the kept words joined by a space, n_chars follows the text; all else stays. Rows with equal or null
    doc_id are judged as by remove_repeated_passages, each on its own: rows with one doc_id and one text fare alike, so
    results are joined by both.
    """

    @F.pandas_udf("string")
    def text_of(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else C.unsqueeze(bytes(x)).decode())

    # text_sha256 names the text that the result belongs to: rows of one id and one text have one result
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    changed = _removals(docs, length, BLOCK_BYTES, BUCKET_BYTES).where("n_removed > 0").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("n_words").alias("_words"),
        F.col("n_removed").alias("_removed"), F.col("kept").alias("_kept")).dropDuplicates(["_id", "_sha"])
    rows = docs.select(C.whole_row(docs), F.col("doc_id").cast("long").alias("_doc"), digest.alias("_digest"))
    out = rows.join(changed, F.expr("_doc <=> _id and _digest = _sha"), "left").where("_removed is null or _removed < _words")
    same = F.col("_removed").isNull()
    kind = {c: docs.schema[c].dataType for c in docs.columns}
    new = {"text": F.when(same, F.col("_row.text")).otherwise(text_of("_kept").cast(kind["text"]))}
    if "n_chars" in kind:
        new["n_chars"] = F.when(same, F.col("_row.n_chars")).otherwise(F.char_length(text_of("_kept")).cast(kind["n_chars"]))
    return C.columns_of(out, docs, new)
