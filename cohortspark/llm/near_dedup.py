"""Near-duplicate classes by order min-hash and banded alignment.

1. *Copies.* Equal texts are one class before anything else; only one of them goes on.
2. *Sketches.* A k-mer is five neighbouring words (letters and digits, without regard to case), labelled with its
   occurrence in the text. For each of `SAMPLES` random orders a text's two smallest labelled k-mers are kept *in
   text order*. With one word in five changed few or no k-mers of five words stay whole, so `SHORT_SAMPLES` orders of
   three-word k-mers (two-word ones in short texts) are sketched likewise. Texts of high edit similarity agree in such a sample far more often than texts that share a
   passage or the same words in another order.
3. *Star links.* Texts that agree in a sample are compared with the smallest id of that sample's group, not with each
   other. Comparing is a banded alignment of the words: the pair is similar if the edit distance is at most a fifth of
   the longer text.
4. *Components* of the links, by alternating stars.
5. *The rest.* In groups that hold several components the texts are compared among themselves, in tasks of bounded
   size (large groups are cut into a grid of parts that meet in pairs), except inside a component: such a pair could
   only link what is linked. A pair is looked at under the least key that both texts have, and aligned only if counts
   of its words and of its neighbouring words allow the similarity. The new links join components.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortspark.llm import bpe, common as C
from cohortspark.session import stable

WORDS, SAMPLES, SIMILARITY = 5, 16, 0.8
#: Random orders of the shorter k-mers, which find what is similar though few runs of five words are left whole, and
#: the number of words from which they have three words and not two.
SHORT_SAMPLES, LONG = 48, 48
#: Words that are sketched at a time.
SKETCH_WORDS = 16_000
#: Texts of a group that one task compares.
PART = 1000
#: Dimensions of the counts of word pairs and of words that rule out most dissimilar pairs.
COUNTED = 1024
COUNTED_WORDS = 4096
#: Links of one task in the rounds that find components.
ROUND_ROWS = 200_000
#: Repeated ids that are sent to all tasks.
FEW = 100_000
_SEEDS = np.random.default_rng(99).integers(0, 2**63, size=256, dtype=np.uint64)
_FACTORS = np.random.default_rng(100).integers(0, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words:
    """Word hashes of several texts, one array with the begin of each text."""

    def __init__(self, texts: list[str]):
        texts = [t.lower() for t in texts]
        code = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), dtype="<u4")
        kind = bpe.classes()[code]
        word = np.zeros(len(code) + 2, dtype=np.int8)
        word[1:-1] = (kind == bpe.LETTER) | (kind == bpe.NUMBER)
        edge = np.diff(word)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.begin = np.searchsorted(start, begin)
        self.hash = C.range_hash(C.prefix_sums(C.mix(code.astype(np.uint64) + np.uint64(5)), C.BYTE_BASE), start, end, C.BYTE_BASE)

    def codes(self) -> list[bytes]:
        """Each text's words as compressed 32-bit numbers."""
        low = (self.hash & np.uint64(0xFFFFFFFF)).astype("<u4")
        return [C.squeeze(low[a:b].tobytes()) for a, b in zip(self.begin[:-1], self.begin[1:])]

    def sketches(self, samples: int, words: int, which: np.ndarray | None = None) -> np.ndarray:
        """One row of sample keys for each text; texts without words, or not in `which`, have zeros, which stand for nothing."""
        n = np.diff(self.begin)
        out = np.zeros((len(n), samples), dtype=np.uint64)
        some = np.flatnonzero(n > 0 if which is None else which & (n > 0))
        sums = C.prefix_sums(self.hash, C.WORD_BASE)
        # a few texts at a time, whose arrays stay in the processor's cache
        for low, high in C.chunks(n[some].tolist(), SKETCH_WORDS):
            out[some[low:high]] = self._sketches(sums, some[low:high], n[some[low:high]], samples, words)
        return out

    def _sketches(self, sums: np.ndarray, some: np.ndarray, n: np.ndarray, samples: int, words: int) -> np.ndarray:
        # a text of fewer words than a k-mer is one k-mer
        grams = np.maximum(n - words + 1, 1)
        first = np.concatenate([[0], np.cumsum(grams)])
        doc = np.repeat(np.arange(len(some)), grams)
        at = self.begin[some][doc] + np.arange(first[-1]) - first[doc]
        gram = C.range_hash(sums, at, at + np.minimum(n[doc], words), C.WORD_BASE)
        order = np.lexsort((at, gram, doc))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (gram[order][1:] != gram[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        place = np.arange(len(order))
        label = np.empty(len(order), dtype=np.uint64)
        label[order] = place - np.maximum.accumulate(np.where(new, place, 0))
        labelled = C.mix(gram + label * np.uint64(0x9E3779B97F4A7C15))
        # the upper half of a value orders the k-mers, the lower half says which one it is
        upper, lower, most = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF), np.uint64(2**64 - 1)
        place = place.astype(np.uint64)
        value = np.empty_like(labelled)
        ones, twos = np.empty((2, samples, len(some)), dtype=np.uint64)
        for j in range(samples):
            # labels are mixed already: one multiplication gives another order
            np.bitwise_xor(labelled, _SEEDS[j], out=value)
            value *= _FACTORS[j]
            value &= upper
            value |= place
            one = np.minimum.reduceat(value, first[:-1], out=ones[j])
            value[one & lower] = most
            np.minimum.reduceat(value, first[:-1], out=twos[j])
        one = (ones & lower).astype(np.int64)
        two = np.where(twos == most, one, (twos & lower).astype(np.int64))
        left = np.where(one == two, np.uint64(0), gram[np.minimum(one, two)])
        out = C.mix(C.mix(left + np.uint64(words)) * np.uint64(3) + gram[np.maximum(one, two)] + _SEEDS[:samples, None]) | np.uint64(1)
        return out.T

    def keys(self) -> list[np.ndarray]:
        """All keys of each text: SAMPLES of five-word k-mers, and SHORT_SAMPLES of shorter ones by the text's length.

        Texts of LONG words and more have keys of three-word k-mers, texts up to LONG / 0.8 words keys of two words; those between have
        both, so two texts whose lengths allow a similarity of 0.8 always have a kind in common.
        """
        n = np.diff(self.begin)
        sets = [self.sketches(SAMPLES, WORDS), self.sketches(SHORT_SAMPLES, 3, n >= LONG),
                self.sketches(SHORT_SAMPLES, 2, n <= LONG / SIMILARITY)]
        return [C.distinct(row[row > 0]).view(np.int64) for row in np.concatenate(sets, axis=1)]


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences if it is at most `most`, else most + 1.

    Leading and trailing equal words are set aside; the rest is aligned inside the band of diagonals -most to most. The
    band's column is two bit vectors (Hyyro's banded form of the bit-parallel algorithm), which move down by one.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    m = len(b)
    differ = np.flatnonzero(a[:m] != b)
    if not len(differ):
        return len(a) - m
    front = int(differ[0])
    a, b = a[front:], b[front:]
    tail = np.flatnonzero(a[len(a) - len(b):][::-1] != b[::-1])
    back = int(tail[0]) if len(tail) else len(b)
    a, b = a[:len(a) - back], b[:len(b) - back]
    if not len(b):
        return len(a) if len(a) <= most else most + 1
    if most < 1:
        return most + 1
    most_here = min(most, len(a))
    width = 2 * most_here + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    vp = full ^ ((1 << (width - most_here - 1)) - 1)
    vn = 0
    distance, shift = most_here, most_here + 1 - width
    level = top >> 1
    down = len(a) - most_here
    # what the rest of the row can still take off
    hopeless = most + len(b) - down
    for i, x in enumerate(b.tolist()):
        bits = where.get(x, 0)
        match = (bits >> shift if shift >= 0 else bits << -shift) & full
        d0 = ((((match & vp) + vp) & full) ^ vp) | match | vn
        hp = vn | (full ^ (d0 | vp))
        hn = d0 & vp
        if i < down:
            distance += not d0 & top
        else:
            distance += bool(hp & level) - bool(hn & level)
            level >>= 1
        if distance > hopeless:
            return most + 1
        half = d0 >> 1
        vp = hn | (full ^ (half | hp))
        vn = half & hp
        shift += 1
    return distance if distance <= most else most + 1


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether 1 - edit distance / longer length is `least` or more."""
    longest = max(len(a), len(b))
    most = math.floor((1 - least) * longest + 1e-9)
    return edit_distance(a, b, most) <= most


def pair_counts(codes: np.ndarray) -> np.ndarray:
    """Hashed counts of neighbouring words. An edit touches two pairs of either text, so it moves them by four at most."""
    pair = (codes[:-1] * np.uint32(2654435761)) ^ (codes[1:] * np.uint32(2246822519))
    return np.minimum(np.bincount((pair >> np.uint32(7)) % np.uint32(COUNTED), minlength=COUNTED), 32_000).astype(np.int16)


def word_counts(codes: np.ndarray) -> np.ndarray:
    """Hashed counts of words. The edit distance is at least what one text has beyond the other's counts."""
    word = codes * np.uint32(2654435761)
    return np.minimum(np.bincount((word >> np.uint32(7)) % np.uint32(COUNTED_WORDS), minlength=COUNTED_WORDS), 32_000).astype(np.int16)


def _read(data: bytes) -> np.ndarray:
    return np.frombuffer(C.unsqueeze(data), dtype="<u4")


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in C.slices(batch, 1):
            words = Words([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(words.begin).astype(np.int32)), pa.array(words.keys(), pa.list_(pa.int64()))],
                ["doc_id", "n", "keys"])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in C.slices(batch, 1):
            words = Words([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.codes(), pa.binary())], ["doc_id", "codes"])


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, x = [], None, None
            for part in C.slices(batch, 2, 3):
                for leader, a, b in zip(*(part.column(i).to_pylist() for i in (0, 2, 3))):
                    if leader != last:
                        last, x = leader, _read(a)
                    keep.append(similar(x, _read(b), least))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components_of(codes: list[np.ndarray], least: float, known: list[int] | None = None, part: np.ndarray | None = None,
                  keys: list[np.ndarray] | None = None, key: int = 0) -> list[tuple[int, int]]:
    """Links (i, j) that join the similar ones of a few sequences; a pair inside a component is not compared.

    `known`: for each sequence the component it is already in. `part`: only sequences of different parts are compared.
    `keys`: the keys of each sequence; a pair with a common key below `key` is left to that one.
    """
    first: dict[int, int] = {}
    label = np.asarray([first.setdefault(k, i) for i, k in enumerate(known)] if known is not None else range(len(codes)))
    links = []
    size = np.asarray([len(c) for c in codes])
    pairs = np.stack([pair_counts(c) for c in codes])
    words: dict[int, np.ndarray] = {}

    def counts(i: int) -> np.ndarray:
        if i not in words:
            words[i] = word_counts(codes[i])
        return words[i]

    for i in range(len(codes) - 1):
        most = np.floor((1 - least) * np.maximum(size[i], size) + 1e-9).astype(np.int64)
        near = (np.abs(size[i] - size) <= most) & (label != label[i])
        near[:i + 1] = False
        if part is not None:
            near &= part != part[i]
        near = np.flatnonzero(near)
        near = near[np.abs(pairs[i] - pairs[near]).sum(axis=1, dtype=np.int64) <= 4 * most[near]]
        for j in near.tolist():
            if label[i] == label[j] or keys is not None and np.intersect1d(keys[i], keys[j], assume_unique=True).min(initial=key) < key:
                continue
            more = counts(i) - counts(j)
            up = int(more[more > 0].sum(dtype=np.int64))
            if max(up, up - int(more.sum(dtype=np.int64))) <= most[j] and similar(codes[i], codes[j], least):
                label[label == label[j]] = label[i]
                links.append((i, j))
    return links


def _among(least: float):
    def run(table: pa.Table) -> pa.Table:
        """Several whole cells, one after the other."""
        table = table.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("doc_id", "ascending")])
        ids, roots, keys = (table.column(c).to_pylist() for c in ("doc_id", "root", "keys"))
        part = table.column("p").to_numpy()
        cell = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")])
        cuts = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1
        data = table.column("codes").to_pylist()
        links = []
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
            found = components_of(
                [_read(x) for x in data[low:high]], least, roots[low:high], part[low:high] if cell[1, low] != cell[2, low] else None,
                [np.asarray(k) for k in keys[low:high]], int(cell[0, low]))
            links += [(roots[low + i], roots[low + j]) for i, j in found]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def connected(edges: DataFrame) -> DataFrame:
    """(id, root) for every id of `edges` (a, b): root is the smallest id of its component, and has no row itself.

    Alternating stars: every id points its larger neighbours, then its smaller ones, at the smallest neighbour. The
    number of rounds grows with the logarithm of the longest path; each is written to the checkpoint folder.
    """
    now = stable(edges.where("a <> b").select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("root")).distinct())
    parts = max(4, C.n_buckets(now.count(), ROUND_ROWS))
    while True:
        # done if every id points at one root, and no root points on
        ends = now.select(F.col("id").alias("x"), F.lit(1).alias("out")).union(now.select("root", F.lit(0)))
        if not ends.groupBy("x").agg(F.sum("out").alias("out"), F.min("out").alias("low")).where(
                "out > 1 or (out = 1 and low = 0)").limit(1).count():
            return now
        both = now.union(now.select("root", "id")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("id"), F.col("m").alias("root")).distinct()
        down = large.groupBy("id").agg(F.min("root").alias("m"))
        small = large.join(down, "id")
        now = stable(small.where("root <> m").select(F.col("root").alias("id"), F.col("m").alias("root")).union(
            down.select("id", F.col("m").alias("root"))).distinct().coalesce(parts))


def near_duplicate_classes(docs: DataFrame, least: float = SIMILARITY, part: int = PART) -> DataFrame:
    """(doc_id, class_id): documents with equal class_id are near duplicates; class_id is the smallest doc_id of the class.

    Two texts are linked if their word sequences (letters and digits, lower case) have an edit similarity of `least`
    or more, 1 - distance / longer length; classes are the components of the links. Pairs are found if they agree in one
    sketch. By measurement on random words with replaced words at random or evenly spaced places, at least 0.95 of the pairs of
    similarity 0.9 and 0.9 of those of 0.8 do, with 5 to 300 words; classes still join through other members.

    One row for each input row with a doc_id. Texts without words (null, empty, signs only) are in one class only with
    equal texts. Rows with equal doc_id have one class. Rows with a null doc_id can't be named: class null, and no part
    in other classes. An empty table gives no rows. Other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = own.where("doc_id is not null")
    digest = stable(named.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest")))
    copies = digest.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("_m"))
    member = stable(C.spread_join(digest, copies, "digest", "doc_id", digest.count()).select("doc_id", "rep").distinct())
    alone = member.where("doc_id = rep").select("doc_id").distinct()
    # stored with one row for each text: a row for each key takes five times the space
    keys = stable(named.mapInArrow(_sketch, "doc_id long, n int, keys array<bigint>").where("n > 0").join(alone, "doc_id"))
    rows = keys.select(F.explode("keys").alias("key"), "doc_id", "n")
    leaders = rows.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("l"), F.count("*").alias("_m")).where("_m > 1")
    met = stable(C.spread_join(rows, stable(leaders), "key", "doc_id", rows.count()).select("key", "doc_id", F.col("l.doc_id").alias("leader"), "n", F.col("l.n").alias("leader_n")))
    lengths = F.least("n", "leader_n") >= F.greatest("n", "leader_n") * least - 1e-6
    pairs = stable(met.where((F.col("doc_id") != F.col("leader")) & lengths).select("leader", "doc_id").distinct())
    met = met.select("key", "doc_id")
    owned = met.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    codes = stable(named.mapInArrow(_encode, "doc_id long, codes binary").dropDuplicates(["doc_id"]).join(owned, "doc_id"))
    encoded = codes.select("doc_id", "codes")
    both = pairs.join(encoded.toDF("leader", "leader_codes"), "leader").join(encoded, "doc_id").select(
        "leader", "doc_id", "leader_codes", "codes")
    linked = stable(both.mapInArrow(_verify(least), "a long, b long"))
    roots = connected(linked)
    rest = met.join(roots.toDF("doc_id", "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    # a group inside one component has nothing to tell; groups of the same texts under several keys tell it once
    groups = rest.groupBy("key").agg(
        F.count("*").alias("m"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("sum"),
        F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").groupBy("m", "sum").agg(F.min("key").alias("key"))
    parts = F.ceil(F.col("m") / F.lit(part)).cast("int")
    cell = rest.join(groups.select("key", "m"), "key").withColumn("parts", parts).withColumn(
        "p", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "key", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "p", "doc_id", "root")
    cell = stable(cell)
    tasks = C.n_buckets(cell.count(), 2 * part)
    bundle = F.pmod(F.xxhash64("key", "i", "j"), F.lit(tasks)).alias("bundle")
    among = cell.join(codes, "doc_id").groupBy(bundle).applyInArrow(_among(least), "a long, b long")
    more = connected(among)
    classes = member.join(roots.toDF("rep", "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep")).join(
        more.toDF("root", "top"), "root", "left").groupBy("doc_id").agg(F.min(F.coalesce("top", "root")).alias("class_id"))
    return own.select("doc_id").join(classes, "doc_id", "left")


def first_of_each_class(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each class: that of the smallest id, and of rows with that id the least one (by text, then the rest).

    Documents without an id take part under keys above all ids, so they go where a document with an id is like them. Null and
    empty texts are alike, so one of all of them stays. An empty table gives no rows. Other columns may have any names and types.
    """
    top = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0
    rows = docs.select(F.col("doc_id").cast("long").alias("_key"), F.col("text").cast("string").alias("_text"), C.whole_row(docs))
    # the keys are stored: they would differ if the rows were read again
    nameless = stable(rows.where("_key is null").withColumn("_key", F.monotonically_increasing_id() + F.lit(top + 1)))
    keyed = rows.where("_key is not null").unionByName(nameless)
    later = stable(near_duplicate_classes(keyed.select(F.col("_key").alias("doc_id"), F.col("_text").alias("text")), least).distinct().where(
        "doc_id <> class_id").select(F.col("doc_id").alias("_key")))
    again = stable(keyed.groupBy("_key").count().where("count > 1").select("_key").join(later, "_key", "left_anti"))
    # whole rows are shuffled once, and only where ids repeat a second time
    out = keyed.select("_key", "_row").join(later.unionByName(again), "_key", "left_anti").select("_row")
    if n := again.count():
        repeated = keyed.join(F.broadcast(again) if n <= FEW else again, "_key").groupBy("_key").agg(
            F.min_by("_row", F.struct("_text", F.to_json("_row"))).alias("_row"))
        out = out.unionByName(repeated.select("_row"))
    return C.columns_of(out, docs)
