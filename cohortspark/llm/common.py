"""What the operators of this subpackage share: reading, sizes, hashing of bytes and words, range blocks.

Everything that runs inside a task works on NumPy arrays of one Arrow batch or one block of documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The words of the contracts: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes that separate words (fixed values: space, tab, newline, vertical tab, form feed, carriage return).
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: A null doc_id counts as the largest one.
NULL_ID = np.iinfo(np.int64).max

#: Bytes of text that a narrow pass works on at once: what its task holds beside the Arrow batch.
CHUNK_BYTES = 1 << 18

#: A value of more than this share of all rows is hot; its rows are spread over so many keys.
HOT_VALUES, HOT_SALTS = 1000, 64

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[np.frombuffer(SPACES, dtype=np.uint8)] = True
_TABLE = np.random.default_rng(20240229).integers(0, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 3, 0xD6E8FEB86659FD93
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_row(docs: DataFrame) -> Column:
    """All columns in one struct `_row`, so that helper columns beside it clash with none of them."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in docs.columns]).alias("_row")


def columns_of(rows: DataFrame, docs: DataFrame, new: dict[str, Column] | None = None) -> DataFrame:
    """The columns of `docs` out of `_row`, those in `new` by their new values."""
    return rows.select(*[(new or {}).get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def spread_join(rows: DataFrame, groups: DataFrame, key: str, by: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with groups (`key`, `_m`, values) on `key`, a value that many rows have in many tasks.

    `groups`: one row for each value with the number `_m` of its rows. Values of more than 1/1000 of the `total` rows, so
    at most 1000, are hot: they are broadcast, and their rows spread by a hash of `by`.
    """
    hot = F.col("_m") > max(total // HOT_VALUES, 100)
    groups = groups.withColumn("_hot", hot)
    names = F.broadcast(groups.where("_hot").select(F.col(key).alias("_hot_key")))  # at most HOT_VALUES rows
    salted = rows.join(names, F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_salt", F.when(F.col("_hot_key").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.lit(HOT_SALTS))).cast("int")).drop("_hot_key")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = groups.withColumn("_salt", F.explode(salts)).drop("_hot", "_m")
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_bytes(docs: DataFrame) -> int:
    """Size of all texts in bytes; one narrow pass over the text column."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = (both[0], both[1])
        if size <= 1 << 24:  # larger ones only serve one very long text
            _POWERS[base] = have
    return have[0][: n + 1], have[1][: n + 1]


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values. np.unique without further results hashes, which takes ten times as long on 64-bit hashes."""
    x = np.sort(x)
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    """Running sums of values[i] * base**i, with a leading zero; range_hash() reads hashes of ranges from them."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values))[0][:-1], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of the values in [start, end), independent of where the range lies."""
    return mix((sums[end] - sums[start]) * powers(base, len(sums) - 1)[1][start])


def byte_sums(buf: np.ndarray) -> np.ndarray:
    return prefix_sums(_TABLE[buf], BYTE_BASE)


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    word = np.zeros(len(buf) + 2, dtype=np.int8)
    word[1:-1] = ~IS_SPACE[buf]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Joined:
    """Texts of several documents in one buffer, a newline between them, with their words and word hashes."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.start, self.end = word_bounds(self.buf)
        self.word_begin = np.searchsorted(self.start, self.begin)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.word_begin))

    def word_hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), dtype=np.uint64)
        # some words at a time: sums and powers take 32 bytes for each byte of text
        cuts = np.searchsorted(self.start, np.arange(0, len(self.buf), CHUNK_BYTES)).tolist() + [len(self.start)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a < b:
                low = self.start[a]
                out[a:b] = range_hash(byte_sums(self.buf[low:self.end[b - 1]]), self.start[a:b] - low, self.end[a:b] - low, BYTE_BASE)
        return out

    def windows(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of `length` words inside one document, and the word each starts at."""
        n = len(hashes)
        if n < length:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.doc[: n - length + 1] == self.doc[length - 1:])
        return range_hash(prefix_sums(hashes, WORD_BASE), at, at + length, WORD_BASE), at


def binary(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring items that together hold about `most` bytes; a larger item stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def slices(batch: pa.RecordBatch, *columns: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of neighbouring rows whose strings or bytes in `columns` are about `most` bytes; nothing is copied."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    for a, b in chunks(sizes.tolist(), most):
        yield batch.slice(a, b - a)


def ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    size = end - begin
    return np.repeat(end - np.cumsum(size), size) + np.arange(size.sum())


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as compressed differences, one plane for each byte."""
    step = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return squeeze(step.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_values(values: np.ndarray) -> bytes:
    size = values.dtype.itemsize
    return squeeze(values.view(np.uint8).reshape(-1, size).T.tobytes())


def unpack_values(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(unsqueeze(data), dtype=np.uint8).reshape(size, -1).T).view(dtype).ravel()


def n_buckets(total_bytes: int, per_bucket: int) -> int:
    return max(1, math.ceil(total_bytes / per_bucket))


def range_blocks(docs: DataFrame, n_blocks: int) -> DataFrame:
    """(block, doc_id, data): documents dealt to blocks of neighbouring ids, texts compressed.

    Block numbers rise with doc_id; equal ids share a block; null ids come last. The block edges are
    approximate quantiles of the ids, a list as long as the number of blocks.
    """
    cuts: list[int] = []
    if n_blocks > 1:
        shares = [i / n_blocks for i in range(1, n_blocks)]
        found = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * n_blocks))).first()[0]
        cuts = sorted(set(found or []))
    edges = np.asarray(cuts, dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            ids = batch.column(0).fill_null(int(NULL_ID))
            block = np.searchsorted(edges, ids.to_numpy(zero_copy_only=False), side="right").astype(np.int32)
            data = [squeeze(t) for t in binary(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block), batch.column(0), pa.array(data, pa.binary())], ["block", "doc_id", "data"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        deal, "block int, doc_id long, data binary")


def block_texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids (null as the largest), their validity and texts of one block, ordered by id, then by content."""
    ids = table.column("doc_id").combine_chunks()
    known = np.asarray(ids.is_valid())
    ids = ids.fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)
    data = table.column("data").to_pylist()
    if len(distinct(ids)) == len(ids):
        order = np.argsort(ids)
    else:
        order = np.asarray(sorted(range(len(ids)), key=lambda i: (ids[i], not known[i], data[i])))
    return ids[order], known[order], [unsqueeze(data[i]) for i in order]


def by_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of sorted keys begins; a bucket is a range of the upper 32 bits."""
    edges = (np.arange(1, buckets, dtype=np.uint64) * np.uint64(2**32 // buckets)) << np.uint64(32)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def crc(data: bytes) -> int:
    return zlib.crc32(data)
