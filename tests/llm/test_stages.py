"""Pipeline stages on tables with clashing column names, null and repeated ids; recall of the near-duplicate sketches."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import common as C, mixing, near_dedup, substring_dedup

CLASHING = ["target", "whole", "cut", "source_size", "_size", "_draw", "_copy", "_repeats", "_part", "_m", "_source", "_n", "kept",
            "_id", "_removed", "_digest", "_key", "_row", "_text", "_words", "_sha", "_doc", "_kept", "_salt", "_hot", "d", "p.x"]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


@pytest.fixture(scope="module")
def wide(spark):
    rng = random.Random(3)
    passage = words(rng, 30)
    rows = [(i, f"{words(rng, 20 + i)} {passage if i % 3 == 0 else ''}", "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(30, rows[1][1], "en", "s0", 1), (31, None, None, None, None), (None, rows[2][1], "en", "s1", 1), (None, None, "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = [F.concat(F.lit(f"{c}:"), F.coalesce("doc_id", F.lit(-1))).alias(c) for c in CLASHING]
    return docs.select("*", *extra, F.create_map(F.lit("k"), "doc_id").alias("a_map"), F.array("doc_id").alias("l")).cache()


def test_clashing_columns(wide):
    plain = wide.select("doc_id", "text", "lang", "source", "n_chars")
    for stage in (mixing.mixed_documents, substring_dedup.remaining_documents, near_dedup.first_of_each_class):
        out = stage(wide)
        assert out.columns == wide.columns
        got = out.collect()
        want = stage(plain).collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in want) and want
        for r in got:
            own = -1 if r.doc_id is None else r.doc_id
            assert all(r[c] == f"{c}:{own}" for c in CLASHING) and r.a_map == {"k": r.doc_id}
        assert stage(wide.limit(0)).count() == 0


def test_mixture_of_missing_and_repeated_ids(spark):
    """Each source comes near its target, whether ids are missing, repeated or unique and texts equal or not."""
    rng = random.Random(9)
    rows = [(None, words(rng, 8), "a") for _ in range(300)]
    rows += [(7, words(rng, rng.randint(1, 15)), "b") for _ in range(200)]
    rows += [(8, "one two three four", "c") for _ in range(250)]
    rows += [(None, "one two three four five", None) for _ in range(250)]
    rows += [(1000 + i, words(rng, 20), "d") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(docs)
    per = {r.source_size: r for r in got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("most")).collect()}
    assert len(per) == 5
    for r in per.values():
        assert abs(r.taken - r.target) <= r.most / 2 + 1e-6
    rows_of = lambda df: Counter(tuple(r) for r in df.collect())
    assert rows_of(got) == rows_of(mixing.mixture(docs.repartition(7)))
    docs = docs.withColumn("lang", F.lit("en"))
    taken = Counter()
    for r in mixing.mixed_documents(docs).collect():
        taken[r.source] += len(r.text.split())
    assert sorted(taken.values()) == sorted(r.taken for r in per.values())


def test_numbered(spark):
    rows = spark.range(1000).select((F.col("id") % 3).cast("string").alias("g"), "id").withColumn(
        "g", F.when(F.col("g") != "2", F.col("g"))).repartition(5)
    got = {}
    for r in mixing.numbered(rows, "g").collect():
        got.setdefault(r.g, []).append(r._number)
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in got.values()) and len(got) == 3


def test_spread_join(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, -1).otherwise(F.col("id")).alias("k"), "id").cache()
    groups = rows.groupBy("k").agg(F.count("*").alias("_m"), F.min("id").alias("least"))
    got = C.spread_join(rows, groups, "k", "id", 5000)
    assert got.columns == ["k", "id", "least"]
    assert Counter((r.k, r.id, r.least) for r in got.collect()) == Counter((-1, i, 0) if i < 3000 else (i, i, i) for i in range(5000))


@pytest.mark.parametrize("n", [5, 10, 20, 45, 55, 100, 300])
@pytest.mark.parametrize("similarity,least", [(0.8, 0.9), (0.85, 0.95), (0.9, 0.98)])
def test_recall(n, similarity, least):
    """Pairs at the very limit, edits at random and evenly spaced places: replaced, left out or put in."""
    rng = random.Random(n)
    edits = int((1 - similarity) * n + 1e-9)
    if not edits:
        return
    for spaced in (False, True):
        a, b = [], []
        for _ in range(250):
            own = words(rng, n).split()
            at = [k * n // edits + n // (2 * edits) for k in range(edits)] if spaced else sorted(rng.sample(range(n), edits))
            other = list(own)
            kind = rng.choice("rrd")
            for i in reversed(at):
                other[i:i + 1] = [] if kind == "d" else [words(rng, 1)]
            a.append(" ".join(own))
            b.append(" ".join(other))
        keys = near_dedup.Words(a + b).keys()
        found = [len(np.intersect1d(keys[i], keys[i + len(a)])) > 0 for i in range(len(a))]
        assert np.mean(found) >= least, (spaced, np.mean(found))


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_narrow_passes_hold_little(spark):
    """A pass holds arrays over little text at a time, however large its Arrow batch or block is; results are those of each text alone."""
    rng = random.Random(4)
    some = [words(rng, 400) for _ in range(50)]
    texts = [f"{i} {some[i % 50]} {some[i % 49]}" for i in range(700)] + [None, "", "word"]  # 4 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    for run in (near_dedup._sketch, near_dedup._encode):
        list(run([batch.slice(0, 2)]))  # tables that stay
        assert peak_mb(lambda: list(run([batch]))) < 25
        got = [row for part in run([batch]) for row in part.to_pylist()]
        assert got[::100] == [row for i in range(0, len(texts), 100) for part in run([batch.slice(i, 1)]) for row in part.to_pylist()]
        assert [row["doc_id"] for row in got] == list(range(len(texts)))
    block = [(t or "").encode() for t in texts]
    joined = C.Joined(block)
    assert peak_mb(joined.word_hashes) < 25
    assert (joined.word_hashes() == C.range_hash(C.byte_sums(joined.buf), joined.start, joined.end, C.BYTE_BASE)).all()


def test_slices():
    texts = ["a" * 10, None, "", "b" * 50, "c"] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(texts), pa.array(texts[::-1]).cast(pa.binary())], ["i", "t", "u"])
    for columns in ([1], [1, 2]):
        parts = list(C.slices(batch, *columns, most=60))
        assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]).combine_chunks()) and len(parts) > 20
        assert all(p.num_rows == 1 or sum(len(x or "") for c in columns for x in p.column(c).to_pylist()) <= 60 for p in parts)
    assert not list(C.slices(batch.slice(0, 0), 1))


def test_first_of_each_class_moves_rows_once(spark, wide):
    """Whole rows meet the ids that go in one shuffle; with repeated ids the least row of each stays."""
    docs = wide.select("doc_id", "text", "lang", "source", "n_chars")
    whole = lambda df: sum("_row" in x or "text" in x for x in re.findall(
        r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]", df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")))
    out = near_dedup.first_of_each_class(docs)
    assert whole(out) <= 2  # rows without an id are joined apart
    rng = random.Random(6)
    rows = [(i, words(rng, 30), "en") for i in range(40)]
    more = rows + [(3, words(rng, 30), "en"), (3, rows[3][1], "de"), (4, rows[4][1], "en"), (50, rows[7][1], "en"), (50, words(rng, 30), "en"), (None, words(rng, 9), "en")]
    got = near_dedup.first_of_each_class(spark.createDataFrame(more, "doc_id long, text string, lang string")).collect()
    # of id 50 one text is a copy of row 7's: all rows of the id go
    three = min((t, lang) for i, t, lang in more if i == 3)
    assert Counter(map(tuple, got)) == Counter([x for x in rows if x[0] != 3] + [(3, *three), more[-1]])
