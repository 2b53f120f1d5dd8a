"""Nearest neighbours against plain loops, with odd vectors, ties, repeats and many lists."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, list int, v string, score double, qkey long"


def table(spark, rows):
    """Further columns have names that the operator uses inside."""
    return spark.createDataFrame([(i, v, 0, 1, "x", 0.5, 7) for i, v in rows], SCHEMA)


def plain(rows, asks, k):
    """Sorted (query_id, rank, vec_id, score) of every asking row."""
    fine = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    sizes = [len(v) for _, v in fine]
    d = max(set(sizes), key=lambda n: (sizes.count(n), n)) if sizes else 0
    fine = [(i, np.asarray(v, np.float32).astype(float)) for i, v in fine if len(v) == d]
    out = []
    for n, (i, q) in enumerate(fine):
        if asks(i):
            found = []
            for m, (j, v) in enumerate(fine):
                if m != n:
                    score = 0.0
                    for a, b in zip(v, q):
                        score += a * b
                    found.append((-score, j is None, j or 0, j))
            out += [(i, r, j, -s) for r, (s, _, _, j) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("d", [3, 64])
def test_like_plain_search(spark, d):
    rng = np.random.default_rng(d)
    rows = [(i, rng.normal(size=d).tolist()) for i in range(120)]
    rows += [(i, rows[5][1]) for i in range(120, 150)]  # ties
    rows += [(40, rows[40][1]), (40, rows[41][1]), (200, rows[7][1]), (None, rows[8][1]), (None, rows[8][1])]
    rows += [(220, None), (240, [0.0] * d), (260, [float("nan")] * d), (280, [None] * d), (300, [1.0] * (d + 1)), (320, []), (340, [float("inf")] * d)]
    rows += [(360, [1e30] * d), (380, [-0.0] + [1e-30] * (d - 1))]
    df = neighbours.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, 5)
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert got(df) == plain(rows, lambda i: i is not None and i % 20 == 0, 5)


def test_few_candidates_and_missing_ids_that_ask(spark):
    rows = [(None, [1.0, 0.0]), (3, [1.0, 1.0]), (None, [1.0, 0.0]), (4, [-1.0, 2.0])]
    assert got(neighbours.nearest(table(spark, rows), F.col("vec_id").isNull(), 20)) == plain(rows, lambda i: i is None, 20)
    assert got(neighbours.nearest(table(spark, rows[:1]), F.lit(True), 20)) == []
    assert got(neighbours.nearest(table(spark, []), F.lit(True), 20)) == []


def test_recall_with_lists(spark, monkeypatch):
    """Many small lists and blocks: clustered vectors, a third of all rows near one point, exact scores."""
    monkeypatch.setattr(neighbours, "LIST_ROWS", 64)
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 1 << 14)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 16)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 24)) * 3
    rows = [(i, (centres[0 if i % 3 == 0 else i % 30] + rng.normal(size=24) * 0.4).tolist()) for i in range(3000)]
    found = got(neighbours.nearest(table(spark, rows).repartition(5), F.col("vec_id") % 20 == 0, 20))
    want = plain(rows, lambda i: i % 20 == 0, 20)
    score = {(q, j): s for q, _, j, s in want}
    both = [(q, j) for q, _, j, _ in found if (q, j) in score]
    assert len(found) == len(want) and len(both) >= 0.98 * len(want)
    assert all(score[q, j] == s for q, _, j, s in found if (q, j) in score)
    model = neighbours.fit(np.asarray([v for _, v in rows]), 3000, 20)
    assert len(model.centres) == 46 and model.probes < 40 and model.parts.sum() > 46


def test_bounds_hold():
    """The estimate's error stays within its bound, and is about as large as the bound says."""
    rng = np.random.default_rng(2)
    v, q = rng.normal(size=(4000, 64)), rng.normal(size=(20, 64))
    model = neighbours.fit(v, 4000, 20)
    bits, factor, error = model.encode(v, 0)
    signs = np.unpackbits(bits, axis=1) * 2.0 - 1
    length = np.sqrt((q * q).sum(axis=1))[:, None]
    estimate = q @ model.centres[0][:, None] + length * ((q / length @ model.rotation.T) @ signs.T * factor)
    off = np.abs(estimate - q @ v.T) / (length * error)
    assert (off > 1).mean() < 4e-3 and 0.8 < np.sqrt((off * off).mean()) * neighbours.ERROR_WIDTH < 1.2
