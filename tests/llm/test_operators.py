"""Operators of the llm subpackage against brute force on small tables with nulls, empty texts, ties and repeated rows."""

import hashlib
import itertools
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import (
    bpe, common as C, fingerprints, language_id, mixing, near_dedup, packing, quality, substring_dedup, suffix_dedup, token_counts, topk_search)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, data string, root string"


def table(spark, rows):
    """doc_id, text, lang, source; further columns have names that the operators use inside."""
    return spark.createDataFrame([(i, t, g, s, len(t or ""), 1, "x", "y") for i, t, g, s in rows], SCHEMA)


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    english = ["the", "of", "and", *("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(400))]
    french = ["le", "la", "et", *("".join(rng.choice("éèouarst") for _ in range(rng.randint(3, 8))) for _ in range(400))]
    out = [(i, words(rng, rng.randint(20, 90), english if i % 3 else french), "en" if i % 3 else "fr", f"s{i % 4}") for i in range(90)]
    shared = words(rng, 25, english)
    for i in range(90, 110):
        out.append((i, f"{words(rng, 10, english)} {shared}\n{words(rng, 12, english)}", "en", "s1"))
    for i in range(110, 125):  # near copies of one document
        w = out[1][1].split()
        w[rng.randrange(len(w))] = "changed"
        out.append((i, " ".join(w), "en", "s2"))
    out += [(i, out[2][1], "en", None) for i in range(125, 130)]
    return out + [
        (130, None, "en", "s0"), (131, "", None, None), (132, "?! ...", "en", "s0"), (133, "ab " * 400, "en", "s3"),
        (134, "é" * 3000, "fr", "s3"), (135, "one", "en", "s1")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).cache()


def test_suffix_dedup(spark, rows, docs):
    first, want = {}, {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if first.setdefault(b[k:k + 100], (i, k)) != (i, k):
                gone[k:k + 100] = b"\1" * 100
        kept = bytes(itertools.compress(b, (not g for g in gone)))
        want[i] = (len(b), sum(gone), sum(k for k, _ in itertools.groupby(gone)), hashlib.sha256(kept).hexdigest())
    for size in (3 << 20, 2000):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
               for r in suffix_dedup.remove_repeated_strings(docs, block_bytes=size, bucket_bytes=2 * size).collect()}
        assert got == want
    assert sum(w[1] for w in want.values()) > 0


def test_suffix_digits_spread_over_buckets():
    rng = np.random.default_rng(8)
    texts = [bytes(rng.integers(97, 123, 2000, dtype=np.uint8)) for _ in range(200)]
    runs = suffix_dedup.Runs(C.Joined(texts), suffix_dedup.LENGTH, suffix_dedup.GRAM)
    sizes = np.diff(C.by_bucket(runs.digit, 20))
    assert sizes.sum() > 5000 and sizes.max() < 1.5 * sizes.mean()


def test_substring_dedup(rows, docs):
    first, want = {}, {}
    for i, t, *_ in rows:
        w = (t or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k:k + 13]), i) < i:
                gone[k:k + 13] = [True] * 13
        kept = " ".join(itertools.compress(w, (not g for g in gone)))
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    for size in (3 << 20, 2000):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256)
               for r in substring_dedup.remove_repeated_passages(docs, block_bytes=size, bucket_bytes=2 * size).collect()}
        assert got == want
    left = {r.doc_id: r for r in substring_dedup.remaining_documents(docs).collect()}
    assert set(left) == {i for i, (n, gone, _) in want.items() if not n or gone < n}
    assert left[95].n_chars == len(left[95].text) and left[130].text is None


def test_near_duplicates(rows, docs):
    texts = [t or "" for _, t, *_ in rows]
    split = near_dedup.Words(texts)
    codes = [split.hash[a:b].astype(np.uint32) for a, b in zip(split.begin, split.begin[1:])]
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if texts[i] == texts[j] or len(codes[i]) and len(codes[j]) and near_dedup.similar(codes[i], codes[j], 0.8):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    for part in (1000, 4):
        got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(docs, part=part).collect()}
        assert got == {r[0]: rows[root[k]][0] for k, r in enumerate(rows)}


def test_edit_distance():
    rng = random.Random(0)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(300):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 12))]
        b = [x for x in a if rng.random() > 0.2] + [rng.randint(0, 3) for _ in range(rng.randint(0, 3))]
        for most in range(8):
            assert near_dedup.edit_distance(np.array(a, np.uint32), np.array(b, np.uint32), most) == min(plain(a, b), most + 1)


def test_mixing(rows, docs):
    got = {r.doc_id: r for r in mixing.mixture(docs).collect()}
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    total = sum(size.values())
    assert {i: r["size"] for i, r in got.items()} == size
    by_source = {}
    for i, _, _, s in rows:
        by_source.setdefault(s, []).append(i)
    targets = {s: got[ids[0]].target for s, ids in by_source.items()}
    assert sum(targets.values()) == pytest.approx(total)
    for s, ids in by_source.items():
        own = sum(size[i] for i in ids)
        assert targets[s] <= 3 * own + 1e-6
        assert abs(sum(got[i].taken for i in ids) - targets[s]) <= max(size[i] for i in ids) / 2 + 1e-6
        assert all(got[i].taken <= 3 * size[i] for i in ids)
    assert {i: r.taken for i, r in got.items()} == {r.doc_id: r.taken for r in mixing.mixture(docs.repartition(3)).collect()}


def test_water_fill():
    assert mixing.water_fill([10, 100], [5, 1], 110, 3) == [30.0, 80.0]
    assert mixing.water_fill([], [], 0, 3) == []
    assert mixing.water_fill([0, 5], [1, 1], 5, 3) == [0.0, 5.0]


def library(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(bpe.NAME))
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_token_counts(rows, docs):
    want = {i: n for (i, *_), n in zip(rows, map(len, library([t or "" for _, t, *_ in rows])))}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()} == want


def test_pieces_like_the_library():
    rng = random.Random(3)
    parts = ["'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "a", "The", "é", "1", "23", "!", "...", "<|endoftext|>", "<|end", "　", "日本", "'S"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    want = library(texts)
    ids, begin = bpe.Ids().of(texts)
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == want
    assert token_counts.Counter(bpe.NAME).of(texts).tolist() == list(map(len, want))


def test_packing(rows, docs):
    got = packing.pack_documents(docs, 256).collect()
    ids = {i: x + [0] for (i, *_), x in zip(rows, library([t or "" for _, t, *_ in rows]))}
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        assert r.ids_crc32 == packing.C.crc(np.asarray(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes())
    for i, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.start for r in own] == [0, *itertools.accumulate(r.length for r in own)][:-1]
        assert sum(r.length for r in own) == len(ids[i]) and all(r.length == 256 for r in own[1:])
    assert set(pieces) == set(ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1]
        assert sum(n for _, n in own) <= 256
    room = []  # plain best-fit decreasing as a yardstick
    for n in sorted((r.length for r in got), reverse=True):
        fits = [k for k in range(len(room)) if room[k] >= n]
        if fits:
            room[min(fits, key=room.__getitem__)] -= n
        else:
            room.append(256 - n)
    assert len(sequences) <= 1.02 * len(room) + 1


def test_nnls():
    a = np.array([[1.0, 0, 1], [0, 1, 1]])
    assert packing.nnls(a, np.array([3.0, 5.0])) @ a.T == pytest.approx([3, 5])
    assert (packing.nnls(-a, np.array([3.0, 5.0])) == 0).all()


def test_fingerprints(rows, docs):
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    texts = [t or "" for _, t, *_ in rows]
    for k, (i, *_) in enumerate(rows):
        t, after = texts[k], texts[(k + 1) % len(texts)]
        half = len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[:len(t) - half] + after[:half]).encode()).hexdigest()
        a, b, c = (set(x.split()) for x in (got[i].fingerprint, got[i].edited_fingerprint, got[rows[(k + 1) % len(rows)][0]].fingerprint))
        assert got[i].near_edited == pytest.approx(len(a & b) / len(a | b)) and got[i].near_next == pytest.approx(len(a & c) / len(a | c))
    assert got[2].fingerprint == got[125].fingerprint


def test_language(rows, docs):
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == g for i, _, g, _ in rows[:90])
    assert [got[i].lang_pred for i in (130, 131, 132)] == ["und"] * 3 and got[131].score == 0
    assert {r.doc_id for r in language_id.keep_identified(docs).collect()} == set(got) - {130, 131, 132}


def test_language_memory():
    """What scoring holds beside its batch doesn't grow with the batch."""
    rng = random.Random(6)
    texts = pa.array([" ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(150)) for _ in range(20)] * 100)
    model = language_id.Model(["de", "en", "es", "fr"], {}, {a: (-1.5, -1.0, -2.0, -1.25) for a in "abcdefghij"})
    C.powers(C.BYTE_BASE, 1 << 20)
    bpe.classes()
    scorer = language_id.Scorer(model)
    tracemalloc.start()
    try:
        scorer.choose(texts)
        assert tracemalloc.get_traced_memory()[1] < 30e6
    finally:
        tracemalloc.stop()


def test_quality(spark, rows):
    some = [(i, t if i % 4 else t.upper().replace(" ", "!! "), g, s) for i, t, g, s in rows[:110]] + [(200, None, None, None)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i, *_ in some[:100]], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.rate_quality(table(spark, some), labels).collect()}
    assert len(got) == len(some)
    assert all(got[i].predicted == (1 if i % 4 else 0) for i, *_ in some[:110])
    assert 0 <= got[200].score <= 1


def test_empty_tables_and_missing_ids(spark):
    empty = table(spark, [])
    odd = table(spark, [(None, "a b c", "en", None), (None, None, None, None), (7, "a b c", "en", "s"), (7, "a b c", "en", "s")])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for run in (
            language_id.identify, lambda d: topk_search.search(d, d), suffix_dedup.remove_repeated_strings,
            substring_dedup.remove_repeated_passages, mixing.mixture, token_counts.token_counts,
            lambda d: quality.rate_quality(d, labels), packing.pack_documents, near_dedup.near_duplicate_classes, fingerprints.fingerprints):
        assert run(empty).count() == 0
        run(odd).collect()
    assert fingerprints.fingerprints(odd).count() == near_dedup.near_duplicate_classes(odd).count() == 4


def test_fingerprint_pairs(rows, docs):
    sets = {r.class_id: set(r.signature) for r in fingerprints.fingerprint_classes(docs).where("doc_id = class_id").collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) - 1e-9}
    assert {(r.a, r.b) for r in fingerprints.near_duplicates(docs, 0.6).collect()} == want


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    data = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, data, str(tmp_path))
        assert out.columns == data.columns
        out.write.mode("overwrite").parquet(str(tmp_path / f"{stage.__name__}"))
        data = spark.read.parquet(str(tmp_path / f"{stage.__name__}"))
    final = corpus_pipeline.run(spark, str(tmp_path))
    count = {r.doc_id: r["n"] for r in data.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert {r.doc_id: r["n"] for r in final.where("piece = 0").groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == count
    assert not set(count) & {130, 131, 132, 125, 126, 111}


def test_terms():
    rng = random.Random(1)
    parts = ["A", "b", "É", "ß", "İ", "ΑΣ", "Σ", "1", "²", "Ⅷ", "½", "日本", "_", "-", " ", "\n", "\u00a0", "\u0307", "😀", "क्षि", "a\u0301", "\u1680", "x"]
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert topk_search.terms(t) == bpe.regex.findall(r"[\p{L}\p{N}]+", t.lower())
    assert topk_search.terms(None) == []


def plain_search(some, asks, k):
    """Scores of all documents for each query with all its terms."""
    bags = [(i, Counter(topk_search.terms(t))) for i, t, *_ in some]
    df = Counter(t for _, b in bags for t in b)
    n, mean = len(bags), sum(sum(b.values()) for _, b in bags) / len(bags)
    out = {}
    for q, own in bags:
        if q is None or not asks(q):
            continue
        own = [t for t in own if df[t] > 1]
        found = []
        for i, b in bags:
            s = sum(topk_search.idf(n, df[t]) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for t in own if b[t])
            if s > 0 and i != q:
                found.append((i, round(s, 6)))
        out[q] = sorted(found, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:k]
    return {q: x for q, x in out.items() if x}


def searched(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    return got


def test_search_whole_texts(spark, rows, docs):
    """Queries of all their terms, in several shards and blocks of queries."""
    some = [*rows, (None, rows[40][1], "en", "s"), (None, rows[40][1], "en", "s")]
    got = searched(topk_search.search(table(spark, some), docs.where("doc_id % 20 = 0"), 5, 4000, 500))
    assert got == plain_search(some, lambda i: i % 20 == 0, 5) and got[40][0][0] is None


def test_search_packs_blocks_in_pieces(spark, rows, docs, monkeypatch):
    """What a task packs and unpacks at once is bounded by a piece, not by the block of queries; several shards share a cell."""
    some = [*rows, (None, rows[40][1], "en", "s")]
    data, want = table(spark, some), plain_search(some, lambda i: i % 20 == 0, 5)
    for name, value in (("PIECE_BYTES", 300), ("MANY_CELLS", 3)):
        monkeypatch.setattr(topk_search, name, value)
    made = []
    pack = topk_search.stable
    monkeypatch.setattr(topk_search, "stable", lambda df: made.append(pack(df)) or made[-1])
    assert searched(topk_search.search(data, docs.where("doc_id % 20 = 0"), 5, 4000, 2000)) == want
    blocks = next(df for df in made if "piece" in df.columns)
    asked = sum(len((t or "").encode()) for i, t, *_ in some if i is not None and i % 20 == 0)
    assert blocks.count() > -(-asked // 2000)
    # terms of queries leave a task in batches of bounded text, not in one of all queries that an Arrow batch holds
    batch = pa.RecordBatch.from_arrays([pa.array([0, 20, 40]), pa.array([f"a{i} " * 60_000 for i in range(3)])], ["doc_id", "text"])
    assert [b.num_rows for b in topk_search._query_terms(iter([batch]))] == [1, 1, 1]


def test_search_prunes_exactly(spark, monkeypatch):
    """Many common terms, copies and near copies in one shard: blocks are skipped and nothing is lost."""
    rng = random.Random(8)
    weights = [1 / (k + 2) for k in range(800)]
    texts = [" ".join(rng.choices([f"w{k}" for k in range(800)], weights, k=rng.randint(5, 120))) for _ in range(700)]
    texts += [" ".join(t.split()[:-1 - c]) for t in texts[:60] for c in range(8)] + texts[:30]
    some = [(i, t, "en", "s") for i, t in enumerate(texts)]
    scored = []
    plain = topk_search.Shard.whole
    monkeypatch.setattr(topk_search, "SHARDS", 1)
    data = table(spark, some)
    got = searched(topk_search.search(data, data.where("doc_id % 10 = 0"), 5))
    assert got == plain_search(some, lambda i: i % 10 == 0, 5)
    # the same shard by hand, to count the documents that are scored
    bags = [Counter(topk_search.terms(t)) for t in texts]
    kinds = sorted({t for b in bags for t in b})
    df = Counter(t for b in bags for t in b)
    shard = object.__new__(topk_search.Shard)
    shard.ids, shard.known = np.arange(len(texts)), np.ones(len(texts), dtype=bool)
    lists = {t: [i for i, b in enumerate(bags) if t in b] for t in kinds}
    shard.begin = np.cumsum([0] + [len(lists[t]) for t in kinds])[:-1]
    shard.end = shard.begin + [len(lists[t]) for t in kinds]
    shard.doc = np.concatenate([lists[t] for t in kinds])
    mean = sum(sum(b.values()) for b in bags) / len(bags)
    shard.score = np.array([topk_search.idf(len(texts), df[t]) * bags[i][t] * 2.2 / (bags[i][t] + 1.2 * (0.25 + 0.75 * sum(bags[i].values()) / mean))
                            for t in kinds for i in lists[t]])

    def counted(total, dense, chosen, found):
        scored.append(len(found))
        return plain(total, dense, chosen, found)

    monkeypatch.setattr(topk_search.Shard, "whole", staticmethod(counted))
    asked = [i for i in range(60) if len(texts[i].split()) > 40][:20]
    own = [np.array([kinds.index(t) for t in sorted(bags[q]) if df[t] > 1]) for q in asked]
    for q, (found, score) in zip(asked, shard.search(own, np.array(asked), 5)):
        assert [(int(i), float(s)) for i, s in zip(found, score)] == plain_search(some, lambda i: i == q, 5)[q]
    assert sum(scored) < 0.5 * len(asked) * len(texts)


def test_stages_with_missing_and_repeated_ids(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(900)]
    passage, other, clean, more = (words(rng, 40, vocabulary) for _ in range(4))
    # a null-id row and a row of a repeated id lose all words, others nothing or a part
    some = table(spark, [(i, t, "en", "s") for i, t in [
        (1, passage), (None, passage), (None, clean), (None, f"{more} {passage}"), (5, passage), (5, other)]])
    out = substring_dedup.remaining_documents(some).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_chars) for r in out) == sorted(
        (i, t, len(t)) for i, t in [(1, passage), (0, clean), (0, more), (5, other)])
    near = table(spark, [(i, t, "en", "s") for i, t in [
        (1, passage), (1, passage), (None, passage), (None, clean), (None, clean), (None, f"{clean} end"), (7, other), (7, more)]])
    out = sorted((r.doc_id or 0, r.text.split()[0]) for r in near_dedup.first_of_each_class(near).collect())
    first = clean.split()[0]
    assert out == sorted([(0, first), (1, passage.split()[0]), (7, min(other, more).split()[0])])
