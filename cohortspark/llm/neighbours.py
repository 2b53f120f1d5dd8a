"""Nearest neighbours by largest inner product with randomly rotated one-bit codes.

*Codes.* A vector is the centre of its list plus a rest. The rest's direction, padded with zeros, is rotated by one random
orthogonal matrix and only the signs are kept, packed eight to a byte, with two correction scalars: with them the sign vector estimates the
inner product of any query with the rest without bias, and its error has a known spread (ERROR_WIDTH of its standard
deviations are taken as the bound).

*Search.* Codes, scalars and original vectors lie in stored blocks by list. A query first looks at the list of its best
centre; its k-th best score there is a floor. In the other lists that it probes only vectors whose estimate plus error bound
reaches the floor are reranked, in double precision on the original vectors. Query blocks meet vector blocks by an
equality join on (list, part); every block is shuffled once for each list it belongs to and pairs of blocks are
worked through as a stream, so nothing grows with the square of the input but the bits compared.

*Lists.* Centres are fitted on at most FIT_ROWS rows. How many lists a query probes is measured on the same rows: as
many as hold PROBE_RECALL of the true neighbours. Where vectors have no clusters, that is nearly all lists, so recall holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortspark.session import stable

#: Rows on which centres and the number of probes are fitted, and queries among them that measure recall.
FIT_ROWS, FIT_QUERIES = 20_000, 300
#: Rows for each list, lists at most, and the share of true neighbours that the probed lists must hold.
LIST_ROWS, MAX_LISTS, PROBE_RECALL = 4096, 1024, 0.99
#: Bits for each component of a vector (vectors are padded with zeros before the rotation; the error falls with the
#: square root), and standard deviations of the estimate's error that its bound allows.
BITS, ERROR_WIDTH = 4, 3.0
#: Bytes of vectors and number of queries in one block, and bytes of blocks that a task holds back.
BLOCK_BYTES, BLOCK_QUERIES, HELD_BYTES = 2 << 20, 512, 48 << 20
#: Answers that a task gathers before it gives them out.
HELD_ANSWERS = 2_000_000
#: Parts over which the lists are spread; a list has parts in proportion to its share of the rows.
PARTS = 256
SEED = 20240713

RESULT = "qkey long, query_id long, copies long, vec_id long, score double, same boolean"


@dataclass
class Model:
    """Centres of the lists, the rotation, parts of each list and lists that a query probes."""

    centres: np.ndarray
    rotation: np.ndarray
    parts: np.ndarray
    probes: int

    def nearest_list(self, v: np.ndarray) -> np.ndarray:
        c = self.centres
        return (v @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)

    def ranked_lists(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")

    def encode(self, v: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs of the rotated rests, the factor that turns a sign product into an estimate, and the error bound
        for a query of length one."""
        rest = v - self.centres[which]
        norm = np.sqrt((rest * rest).sum(axis=1))
        turned = (rest / np.where(norm > 0, norm, 1)[:, None]) @ self.rotation.T
        size = turned.shape[1]
        cosine = np.abs(turned).sum(axis=1) / np.sqrt(size)  # of the direction and its sign vector
        cosine = np.where(norm > 0, np.clip(cosine, 1e-9, 1), 1)
        factor = norm / (cosine * np.sqrt(size))
        error = ERROR_WIDTH * norm * np.sqrt(np.maximum(1 - cosine * cosine, 0)) / cosine / np.sqrt(max(size - 1, 1))
        length = norm + np.sqrt((self.centres[which] ** 2).sum())
        return np.packbits(turned > 0, axis=1), factor, error + 1e-5 * length


def inner_products(v: np.ndarray, vi: np.ndarray, q: np.ndarray, qi: np.ndarray) -> np.ndarray:
    """Of chosen columns, added up from the first component to the last, so that equal vectors get equal scores."""
    out = np.zeros(len(vi))
    for j in range(len(v)):
        out += v[j, vi] * q[j, qi]
    return out


def centres_of(rows: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n centres by a few rounds of k-means that start at random rows, so crowded regions get more of them."""
    centres = rows[rng.choice(len(rows), n, replace=False)]
    for _ in range(8 if n > 1 else 1):
        at = (rows @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)
        count = np.bincount(at, minlength=n)
        total = np.zeros_like(centres)
        np.add.at(total, at, rows)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def fit(rows: np.ndarray, n_rows: int, k: int) -> Model:
    """A model from a bounded sample of a table of `n_rows` rows."""
    rng = np.random.default_rng(SEED)
    d = rows.shape[1]
    size = max(64, -(-BITS * d // 8) * 8)
    rotation = np.linalg.qr(rng.normal(size=(size, size)))[0][:, :d]
    lists = int(np.clip(n_rows // LIST_ROWS, 1, min(MAX_LISTS, max(1, len(rows) // 16))))
    centres = centres_of(rows, lists, rng)
    model = Model(centres, rotation, np.ones(lists, dtype=np.int64), lists)
    own = model.nearest_list(rows)
    share = np.bincount(own, minlength=lists) / len(rows)
    blocks = max(1, n_rows * d * 8 // BLOCK_BYTES)
    model.parts = np.maximum(1, np.ceil(share * min(PARTS, blocks))).astype(np.int64)
    if lists > 1:
        asked = rng.choice(len(rows), min(FIT_QUERIES, len(rows)), replace=False)
        score = rows[asked] @ rows.T
        score[np.arange(len(asked)), asked] = -np.inf
        best = np.argpartition(-score, k, axis=1)[:, :k]
        place = np.argsort(model.ranked_lists(rows[asked]), axis=1)
        place = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
        model.probes = int(place[min(len(place) - 1, int(np.ceil(PROBE_RECALL * len(place))))]) + 1
    return model


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col("v").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("v"))
            .where(F.col("v").isNotNull() & fine & F.exists(v, lambda x: x != 0)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


class _Held:
    """Rows held back by list until a block is full or the task holds too many."""

    def __init__(self, most_rows: int, most_bytes: int, row_bytes: int, emit: Callable[[int, list[np.ndarray]], pa.RecordBatch]):
        self.most, self.limit, self.row_bytes, self.emit = most_rows, max(1, most_bytes // row_bytes), row_bytes, emit
        self.rows: dict[int, list[tuple[np.ndarray, ...]]] = {}
        self.size: dict[int, int] = {}

    def add(self, which: int, part: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(part[0]), self.most):
            piece = tuple(x[a:a + self.most] for x in part)
            if self.size.get(which, 0) + len(piece[0]) > self.most:
                yield self.out(which)
            self.rows.setdefault(which, []).append(piece)
            self.size[which] = self.size.get(which, 0) + len(piece[0])
        if sum(self.size.values()) > self.limit:
            yield from self.flush()

    def out(self, which: int) -> pa.RecordBatch:
        self.size.pop(which)
        return self.emit(which, [np.concatenate(x) for x in zip(*self.rows.pop(which))])

    def flush(self) -> Iterator[pa.RecordBatch]:
        for which in list(self.rows):
            yield self.out(which)


def _by_list(lists: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(lists, kind="stable")
    edges = np.flatnonzero(np.diff(lists[order])) + 1
    for at in np.split(order, edges):
        if len(at):
            yield int(lists[at[0]]), at


def vector_blocks(rows: DataFrame, model: Model, d: int, kind: str) -> DataFrame:
    """(list, part, ids, known, vectors, bits, factor, error): the stored index, one row for each block; no shuffle."""
    names = ["list", "part", "ids", "known", "vectors", "bits", "factor", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0

        def emit(which: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal made
            made += 1
            ids, known, v = parts
            bits, factor, error = model.encode(v, which)
            spread = (int(ids[0]) * 31 + made) % int(model.parts[which])
            data = [which, spread, ids.tobytes(), known.tobytes(), v.astype(kind).tobytes(), bits.tobytes(), factor.tobytes(), error.tobytes()]
            types = [pa.int32(), pa.int32()] + [pa.binary()] * 6
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(data, types)], names)

        held = _Held(max(1, BLOCK_BYTES // (8 * d)), HELD_BYTES, 8 * d + 16, emit)
        for batch in batches:
            if batch.num_rows:
                ids, v = batch.column(0), _matrix(batch.column(1), d)
                known = np.asarray(ids.is_valid())
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                for which, at in _by_list(model.nearest_list(v)):
                    yield from held.add(which, (ids[at], known[at], v[at]))
        yield from held.flush()

    return rows.mapInArrow(run, "list int, part int, ids binary, known binary, vectors binary, bits binary, factor binary, error binary")


def query_blocks(asked: DataFrame, model: Model, d: int, first: int, last: int) -> DataFrame:
    """(list, part, queries, floors, vectors): blocks of queries for each list that ranks from `first` to `last` for them.

    asked: qkey, vec_id, v, copies, floor. A block is sent to every part of its list.
    """
    names = ["list", "part", "queries", "floors", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(which: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            n = int(model.parts[which])
            about, floors, v = (x.tobytes() for x in parts)
            return pa.RecordBatch.from_arrays(
                [pa.array([which] * n, pa.int32()), pa.array(range(n), pa.int32())]
                + [pa.array([x] * n, pa.binary()) for x in (about, floors, v)], names)

        held = _Held(BLOCK_QUERIES, HELD_BYTES, 8 * d + 32, emit)
        for batch in batches:
            if not batch.num_rows:
                continue
            about = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 3)], axis=1).astype(np.int64)
            v, floors = _matrix(batch.column(2), d), batch.column(4).to_numpy(zero_copy_only=False).astype(float)
            wanted = model.ranked_lists(v)[:, first:last]
            for which, at in _by_list(wanted.ravel()):
                at = at // max(1, wanted.shape[1])
                yield from held.add(which, (about[at], floors[at], v[at]))
        yield from held.flush()

    return asked.select("qkey", "vec_id", "v", "copies", "floor").mapInArrow(
        run, "list int, part int, queries binary, floors binary, q binary")


class _Answers:
    """The k + 1 best so far for each query of one block of queries."""

    def __init__(self, row: dict, model: Model, d: int, k: int):
        self.k, self.model = k, model
        self.about = np.frombuffer(row["queries"], np.int64).reshape(-1, 3)  # qkey, id, copies
        self.floor = np.frombuffer(row["floors"]).copy()
        self.q = np.frombuffer(row["q"]).reshape(-1, d)
        self.length = np.sqrt((self.q * self.q).sum(axis=1))
        self.turned = ((self.q / self.length[:, None]) @ model.rotation.T).astype(np.float32)
        self.centred = self.q @ model.centres[row["list"]]
        self.columns = np.ascontiguousarray(self.q.T)
        none = np.zeros(0, dtype=np.int64)
        self.best = (none, none, none.astype(bool), none.astype(float), none.astype(bool))  # query, id, known, score, same

    def add(self, block: Block) -> None:
        k, n = self.k, len(block.ids)
        estimate = self.turned @ block.signs * block.factor
        estimate *= self.length[:, None]
        estimate += self.centred[:, None]
        bound = self.length[:, None] * block.error
        least = self.floor
        if n > k + 1 and np.isinf(least).any():  # k + 1 vectors of the block, which are reranked, should lie above this
            least = np.maximum(least, np.partition(estimate - bound, n - k - 1, axis=1)[:, n - k - 1])
        estimate += bound
        qi, vi = np.nonzero(~(estimate < least[:, None]))
        if not len(qi):
            return
        score = inner_products(block.columns, vi, self.columns, qi)
        keep = ~(score < self.floor[qi])
        qi, vi, score = qi[keep], vi[keep], score[keep]
        ids, known, about = block.ids[vi], block.known[vi], self.about[qi]
        same = (known == (about[:, 2] > 0)) & (~known | (ids == about[:, 1]))
        at = np.flatnonzero(same)
        same[at] = (block.columns[:, vi[at]] == self.columns[:, qi[at]]).all(axis=0)
        every = [np.concatenate(x) for x in zip(self.best, (qi, ids, known, score, same))]
        order = np.lexsort((every[1], ~every[2], -every[3], every[0]))
        query = every[0][order]
        begin = np.searchsorted(query, np.arange(len(self.q) + 1))
        order = order[np.arange(len(order)) - begin[query] <= k]
        self.best = tuple(x[order] for x in every)
        full = np.flatnonzero(np.diff(begin) > k)
        last = np.searchsorted(self.best[0], full) + k
        self.floor[full] = np.maximum(self.floor[full], self.best[3][last])

    def out(self) -> pa.RecordBatch:
        qi, ids, known, score, same = self.best
        about = self.about[qi]
        return pa.RecordBatch.from_arrays(
            [pa.array(about[:, 0]), pa.array(about[:, 1]), pa.array(about[:, 2]), pa.array(ids, mask=~known), pa.array(score), pa.array(same)],
            ["qkey", "query_id", "copies", "vec_id", "score", "same"])


class Block:
    """A stored block of vectors."""

    def __init__(self, row: dict, d: int, size: int, kind: str):
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
        self.columns = np.ascontiguousarray(np.frombuffer(row["vectors"], kind).reshape(-1, d).T.astype(float))
        bits = np.frombuffer(row["bits"], np.uint8).reshape(len(self.ids), -1)
        self.signs = np.unpackbits(bits, axis=1, count=size).T.astype(np.float32) * 2 - 1
        self.factor, self.error = np.frombuffer(row["factor"]), np.frombuffer(row["error"])


def scan(blocks: DataFrame, queries: DataFrame, model: Model, d: int, k: int, kind: str) -> DataFrame:
    """For each query the k + 1 best of the blocks of its lists that one task sees, if they reach its floor, by exact score."""
    size = model.rotation.shape[0]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[tuple[int, bytes], _Answers] = {}
        block, of = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}
                if of != (row["ids"], row["vectors"]):
                    block, of = Block(row, d, size, kind), (row["ids"], row["vectors"])
                key = row["list"], row["queries"]
                if key not in asked:
                    if sum(len(x.q) for x in asked.values()) * (k + 1) > HELD_ANSWERS:
                        yield from (x.out() for x in asked.values())
                        asked = {}
                    asked[key] = _Answers(row, model, d, k)
                asked[key].add(block)
        yield from (x.out() for x in asked.values())

    return blocks.join(queries, ["list", "part"]).mapInArrow(answer, RESULT)


def nearest(vectors: DataFrame, asked: Column, k: int = 20, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product with each row that satisfies `asked`.

    vectors: any table with an id and a vector column; other columns are only read by `asked`. A row is no neighbour
    of itself, but other rows with its id or its vector are. Score: the inner product in double precision. Ties go to
    the smaller id, a missing id last.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors of another length
    than the most frequent one (of equally frequent lengths, the largest). A row that is there twice asks twice and is found
    twice. A row without an id can be found, but only asks if `asked` holds for it; then its query_id is null.
    Fewer than k candidates: all of them. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, column)
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = most
    rows = rows.where(F.size("v") == d)
    sample = rows.sample(min(1.0, 1.05 * FIT_ROWS / n), seed=SEED) if n > FIT_ROWS else rows
    drawn = _matrix(sample.select(F.col("v").cast("array<double>")).limit(FIT_ROWS).toArrow().column(0).combine_chunks(), d)
    model = fit(drawn if len(drawn) else np.ones((1, d)), n, k)
    kind = "<f4" if dict(rows.dtypes)["v"] == "array<float>" else "<f8"
    blocks = stable(vector_blocks(rows, model, d, kind))
    own = (usable(vectors.where(asked), key, column).where(F.size("v") == d).groupBy("vec_id", F.col("v").cast("array<double>").alias("v"))
           .agg(F.count("*").alias("copies")))
    # a missing id is the number 0 with a negative count of copies inside the blocks
    own = stable(own.select(
        F.monotonically_increasing_id().alias("qkey"), F.coalesce("vec_id", F.lit(0)).alias("vec_id"), "v",
        F.when(F.col("vec_id").isNull(), -F.col("copies")).otherwise(F.col("copies")).alias("copies"), F.lit(float("-inf")).alias("floor")))
    by_score = Window.partitionBy("qkey").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), F.desc("same"))
    best = lambda found: found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k + 1)
    found = scan(blocks, query_blocks(own, model, d, 0, 1), model, d, k, kind)
    if model.probes > 1:
        found = stable(best(found).drop("rank"))
        floor = best(found).where(F.col("rank") == k + 1).select("qkey", F.col("score").alias("reached"))
        raised = own.join(floor, "qkey", "left").withColumn("floor", F.coalesce("reached", "floor"))
        found = found.unionByName(scan(blocks, query_blocks(raised, model, d, 1, model.probes), model, d, k, kind))
    # of the rows equal to the query, one is its own
    before = by_score.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = best(found).withColumn("own", F.sum(F.col("same").cast("int")).over(before))
    ranked = ranked.where(~(F.col("same") & (F.col("own") == 1))).withColumn("rank", F.col("rank") - F.least("own", F.lit(1)))
    return (ranked.where(F.col("rank") <= k)
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("copies"))))
            .select(F.when(F.col("copies") > 0, F.col("query_id")).alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


#: Exact search; double-precision sums run from the first component to the last, as in the operator.
SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT * FROM v WHERE len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM u q JOIN u c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM p
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""
