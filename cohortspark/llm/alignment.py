"""Alignment of two public tokenizers over a corpus, each distinct text tokenised once.

*Distinct texts.* Texts are shuffled by their full content and counted. Each distinct text is tokenised by both
libraries' vocabularies and aligned on byte offsets: where tokens of both end, a group ends; each stretch between
neighbouring ends of either kind is one link of an A token with a B token.

*Counts.* A block of texts names its distinct id pairs once, with their links weighted by how often the texts occur. Spark adds
them up by pair, finds the largest count of each B id, and joins the counts back to the blocks' pairs.

*Documents.* Measures go back to doc_ids by the text's SHA-256. Texts that hold more than 1 / HOT_TEXTS of all documents are at
most HOT_TEXTS many and are broadcast; all others share the shuffle.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohortspark.llm import bpe, common as C
from cohortspark.session import stable

A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of texts that are aligned at once, and that share one list of pairs.
CHUNK, BLOCK = 2 << 20, 16 << 20
#: A text of more than this share of all documents is hot.
HOT_TEXTS = 1000
#: A pair is the number b * 2**A_BITS + a.
A_BITS = 16

MEASURES = "n_a long, n_b long, n_groups long, n_links long"


class Tokens:
    """Ids of both tokenizers and the byte length of every id."""

    def __init__(self, a_name: str, b_name: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.plain = bpe.ids()
        self.library = Tokenizer.from_file(public_tokenizers.path(a_name))
        self.library.encode_special_tokens = True  # their strings are ordinary text here
        with open(public_tokenizers.path(a_name.replace(".json", ".tiktoken")), "rb") as lines:
            ranks = {int(n): len(base64.b64decode(t)) for t, n in map(bytes.split, lines)}
        self.a_size = np.zeros(self.library.get_vocab_size(with_added_tokens=True), dtype=np.int64)
        self.a_size[list(ranks)] = list(ranks.values())
        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b_name))
        self.b_bytes = [self.bytes_of(i) for i in range(self.model.get_piece_size())]
        self.b_size = np.fromiter(map(len, self.b_bytes), dtype=np.int64)
        # decimal ids with what may follow them in the description of groups
        self.words = [f"{i}{end}" for end, n in ((",", len(self.a_size)), ("|", len(self.a_size)), (",", len(self.b_size)), (";", len(self.b_size)))
                      for i in range(n)]

    def bytes_of(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes((int(piece[3:5], 16),)) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def a_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with a leading space, and where each text's ids begin."""
        odd = [i for i, t in enumerate(texts) if bpe.SPECIAL in t]
        ids, begin = self.plain.of([" " + t for t in texts])
        if odd:
            parts = [ids[a:b] for a, b in zip(begin, begin[1:])]
            for i in odd:
                parts[i] = np.asarray(self.library.encode(" " + texts[i], add_special_tokens=False).ids, dtype=ids.dtype)
            ids, begin = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids.astype(np.int64), begin

    def b_ids(self, texts: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the texts whose pieces spell a space and the text, where they begin, and which texts these are."""
        lists = self.model.encode(texts, num_threads=1)
        spell = self.b_bytes.__getitem__
        fine = np.fromiter((b"".join(map(spell, x)) == b" " + t for x, t in zip(lists, raw)), dtype=bool, count=len(raw))
        lists = [x for x, good in zip(lists, fine.tolist()) if good]
        begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)))])
        return np.fromiter((i for x in lists for i in x), dtype=np.int64, count=begin[-1]), begin, fine


class Aligned:
    """Groups and links of a chunk of texts whose A and B tokens spell the same bytes."""

    def __init__(self, tokens: Tokens, a: np.ndarray, a_begin: np.ndarray, b: np.ndarray, b_begin: np.ndarray):
        self.tokens, self.a, self.b = tokens, a, b
        a_end, b_end = np.cumsum(tokens.a_size[a]), np.cumsum(tokens.b_size[b])
        n = int(a_end[-1]) + 1 if len(a_end) else 1
        in_a, in_b = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        in_a[a_end], in_b[b_end] = True, True
        self.a_last, self.b_last = in_b[a_end], in_a[b_end]  # the last token of a group
        self.n_a, self.n_b = np.diff(a_begin), np.diff(b_begin)
        self.groups = np.concatenate([[0], np.cumsum(self.a_last)])[a_begin]  # groups before each text
        self.n_groups = np.diff(self.groups)
        ends = np.flatnonzero(in_a | in_b)
        at_a, at_b = in_a[ends], in_b[ends]
        # the tokens over each stretch are the ones that end next
        self.key = (b[np.cumsum(at_b) - at_b] << A_BITS) | a[np.cumsum(at_a) - at_a]
        self.n_links = self.n_a + self.n_b - self.n_groups
        self.a_begin, self.b_begin = a_begin, b_begin

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each text in order, how often each links, and where each text's begin."""
        text = np.repeat(np.arange(len(self.n_links)), self.n_links)
        both = np.sort((text << 32) | self.key)
        new = np.ones(len(both), dtype=bool)
        new[1:] = both[1:] != both[:-1]
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(both)))
        begin = np.searchsorted(both[at] >> 32, np.arange(len(self.n_links) + 1))
        return both[at] & 0xFFFFFFFF, times, begin

    def descriptions(self) -> list[str]:
        """The groups of each text in decimal ids."""
        n, m = len(self.tokens.a_size), len(self.tokens.b_size)
        group_a, group_b = np.cumsum(self.a_last) - self.a_last, np.cumsum(self.b_last) - self.b_last
        ends_a, ends_b = np.flatnonzero(self.a_last) + 1, np.concatenate([[0], np.flatnonzero(self.b_last) + 1])
        word = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        word[np.arange(len(self.a)) + ends_b[group_a]] = self.a + n * self.a_last
        word[np.arange(len(self.b)) + ends_a[group_b]] = self.b + 2 * n + m * self.b_last
        begin, spell = (self.a_begin + self.b_begin).tolist(), self.tokens.words.__getitem__
        return ["".join(map(spell, word[x:y].tolist()))[:-1] for x, y in zip(begin, begin[1:])]


_LOADED: dict[tuple[str, str], Tokens] = {}


def tokens(a_name: str, b_name: str) -> Tokens:
    """The worker's own instance."""
    if (a_name, b_name) not in _LOADED:
        _LOADED[a_name, b_name] = Tokens(a_name, b_name)
    return _LOADED[a_name, b_name]


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(text, copies) of all texts with any character."""
    return docs.select(F.col("text").cast("string").alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))


def aligned_texts(docs: DataFrame, a_name: str = A_NAME, b_name: str = B_NAME, groups: bool = False) -> DataFrame:
    """Rows of two kinds by block of texts: one for each distinct text that aligns, with its measures and its own pairs
    packed, and one with the pairs of the block (`keys`, `links`)."""
    fields = (f"block long, digest binary, copies long, {MEASURES}, groups_sha256 string, groups string, pairs binary, times binary, "
              "keys array<int>, links array<long>")
    kinds = [pa.int64(), pa.binary()] + [pa.int64()] * 5 + [pa.string()] * 2 + [pa.binary()] * 2 + [pa.list_(pa.int32()), pa.list_(pa.int64())]
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 32
        both, held, held_bytes = tokens(a_name, b_name), [], 0

        def pair_row() -> pa.RecordBatch:
            keys, links = add_up(*(np.concatenate(x) for x in zip(*held)))
            row = [block] + [None] * (len(names) - 3) + [keys.astype(np.int32), links]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names)

        for batch in batches:
            column, copies = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for x, y in C.chunks([len(t) for t in column], CHUNK):
                texts = column[x:y]
                raw = [t.encode() for t in texts]
                b, b_begin, fine = both.b_ids(texts, raw)
                if not fine.any():
                    continue
                texts = [t for t, good in zip(texts, fine) if good]
                raw = [t for t, good in zip(raw, fine) if good]
                times_there = copies[x:y][fine]
                found = Aligned(both, *both.a_ids(texts), b, b_begin)
                described = found.descriptions()
                keys, times, begin = found.pairs()
                edges = list(zip(begin.tolist(), begin[1:].tolist()))
                rows = [
                    [block] * len(texts), [hashlib.sha256(t).digest() for t in raw], times_there,
                    found.n_a, found.n_b, found.n_groups, found.n_links,
                    [hashlib.sha256(t.encode()).hexdigest() for t in described], described if groups else [None] * len(texts),
                    [C.pack_values(keys[p:q].astype("<u4")) for p, q in edges], [C.pack_values(times[p:q].astype("<u4")) for p, q in edges],
                    [None] * len(texts), [None] * len(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds)], names)
                held.append(add_up(keys, times * np.repeat(times_there, np.diff(begin))))
                held_bytes += sum(map(len, raw))
                if held_bytes >= BLOCK:
                    yield pair_row()
                    block, held, held_bytes = block + 1, [], 0
        if held:
            yield pair_row()

    return distinct_texts(docs).mapInArrow(run, fields)


def block_pairs(aligned: DataFrame) -> DataFrame:
    """(block, key, links) of every block's distinct pairs."""
    return (aligned.where("keys IS NOT NULL")
            .select("block", F.explode(F.arrays_zip("keys", "links")).alias("x")).select("block", F.col("x.keys").alias("key"), F.col("x.links").alias("links")))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(key, count, best): links of each id pair corpus-wide, and whether no other pair of the same B id has more.

    A B id meets at most as many A ids as A has, so a window over one B id is bounded by the vocabulary.
    """
    total = pairs.groupBy("key").agg(F.sum("links").alias("count"))
    same_b = Window.partitionBy(F.shiftright("key", A_BITS))
    return total.withColumn("best", F.col("count") == F.max("count").over(same_b))


def align(docs: DataFrame, a_name: str = A_NAME, b_name: str = B_NAME, groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each whole text; with `groups` also their list.

    a_name: a byte-level BPE file of public_tokenizers that has a list of ranks beside it; the text is given a leading space.
    b_name: a sentencepiece file, which adds the space itself. Strings of special tokens are ordinary text.

    One row for each input row, repeated ids included. Null and empty texts, and texts that the B pieces don't spell,
    have no tokens: zeros and '' (groups null); they count nowhere. Equal texts are aligned once and count as often as they
    occur; of pairs with equal counts all are the best. A very long text is a chunk of its own. An empty table gives
    no rows. Other columns are not read.
    """
    aligned = stable(aligned_texts(docs, a_name, b_name, groups))
    pairs = block_pairs(aligned)
    looked = pairs.drop("links").join(pair_counts(pairs), "key").select(F.col("block").alias("of"), "key", "count", "best")
    shown = [f.split(" ")[0] for f in MEASURES.split(", ")]

    def measure(texts: pa.Table, counts: pa.Table) -> pa.Table:
        key = counts.column("key").to_numpy()
        order = np.argsort(key)
        key, total, best = key[order].astype(np.int64), counts.column("count").to_numpy()[order], counts.column("best").to_numpy()[order]
        n_best, count_sum = [], []
        for own, times in zip(texts.column("pairs").to_pylist(), texts.column("times").to_pylist()):
            at = np.searchsorted(key, C.unpack_values(own, "<u4"))
            n = C.unpack_values(times, "<u4").astype(np.int64)
            n_best.append(int(n[best[at]].sum()))
            count_sum.append(int((n * total[at]).sum()))
        out = texts.select(["digest", "copies", *shown, "groups_sha256", "groups"])
        return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    texts = aligned.where("digest IS NOT NULL").drop("keys", "links")
    measures = stable(texts.groupBy("block").cogroup(looked.groupBy("of")).applyInArrow(
        measure, f"digest binary, copies long, {MEASURES}, groups_sha256 string, groups string, n_best long, count_sum long"))
    every = measures.agg(F.sum("copies")).first()[0] or 0
    hot = F.broadcast(measures.where(F.col("copies") > every // HOT_TEXTS))  # at most HOT_TEXTS rows
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.when(text != "", F.unhex(F.sha2(text.cast("binary"), 256))).alias("digest"))
    common = rows.join(hot, "digest", "left").where("digest IS NULL OR copies IS NOT NULL")
    others = (rows.where("digest IS NOT NULL").join(hot.select("digest"), "digest", "left_anti")
              .join(measures.where(F.col("copies") <= every // HOT_TEXTS), "digest", "left"))
    numbers = [*shown, "n_best", "count_sum"]
    return common.unionByName(others).select(
        "doc_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
        *(["groups"] if groups else []))
