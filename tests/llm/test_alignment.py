"""Alignment of two tokenizers against the libraries and plain loops."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from cohortspark.llm import alignment

SCHEMA = "doc_id long, text string, block long, digest string, copies long, keys int, best boolean, groups string, n_a long"


def table(spark, rows):
    """Further columns have names that the operator uses inside."""
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, True, "g", 4) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain(rows, libraries):
    a, b = libraries
    byte = {c: x for x, c in zip(
        [*range(33, 127), *range(161, 173), *range(174, 256)], map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]))}
    rest = [x for x in range(256) if x not in byte.values()]
    byte |= {chr(256 + i): x for i, x in enumerate(rest)}
    found, count = [], Counter()
    for i, t in rows:
        links, groups, n_a, n_b = [], [], 0, 0
        if t:
            left = [(x, bytes(byte[c] for c in a.id_to_token(x))) for x in a.encode(" " + t, add_special_tokens=False).ids]
            right = [(x, bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode())
                     for x in b.encode(t)]
            whole = (" " + t).encode()
            if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right):
                ends = lambda tokens: [sum(len(x) for _, x in tokens[:k + 1]) for k in range(len(tokens))]
                a_end, b_end = ends(left), ends(right)
                n_a, n_b = len(left), len(right)
                for (x, p), e in zip(left, a_end):
                    links += [(x, y) for (y, q), f in zip(right, b_end) if max(e - len(p), f - len(q)) < min(e, f)]
                start = 0
                for cut in sorted(set(a_end) & set(b_end)):
                    groups.append("|".join(",".join(str(x) for (x, _), e in zip(side, end) if start < e <= cut)
                                           for side, end in ((left, a_end), (right, b_end))))
                    start = cut
        count.update(links)
        found.append((i, n_a, n_b, groups, links))
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    return sorted((
        (i, n_a, n_b, len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "") for i, n_a, n_b, groups, links in found), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    parts = ["the ", "of", " tokenizer", "  ", "\n", "\t", "é", "日本", "😀", "12", "345", "'s", "...", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "naïve ", "aaaa", "ﬁ", "é"]
    out = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))) for i in range(150)]
    out += [(i, f"the {i % 7} of it") for i in range(150, 200)]
    out += [(i, "a hot text of many copies") for i in range(200, 320)]
    return out + [(320, None), (321, ""), (322, " "), (323, "▁"), (324, "a▁b"), (325, "<|endoftext|>"), (None, "no id"), (None, "no id"), (7, "again"), (7, None)]


def test_like_the_libraries(spark, rows, libraries, monkeypatch):
    want = plain(rows, libraries)
    assert got(alignment.align(table(spark, rows))) == want
    monkeypatch.setattr(alignment, "CHUNK", 200)
    monkeypatch.setattr(alignment, "BLOCK", 500)
    monkeypatch.setattr(alignment, "HOT_TEXTS", 4)  # the hot text is broadcast, others are not
    assert got(alignment.align(table(spark, rows).repartition(3))) == want
    assert sum(w[4] > w[1] for w in want) > 50 and {w[1] for w in want if w[0] in (320, 321, 323, 324)} == {0}


def test_groups_are_real(spark, rows):
    for r in alignment.align(table(spark, rows[:40]), groups=True).collect():
        assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 if r.n_a else r.groups is None


def test_empty_and_long(spark, libraries):
    assert got(alignment.align(table(spark, []))) == []
    assert got(alignment.align(table(spark, [(1, None), (2, "")]))) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    text = "word after word, " * 700_000 + " " * 100_000
    r = alignment.align(table(spark, [(1, text), (2, "word")])).where("doc_id = 1").first()
    a, b = libraries
    n = [len(a.encode(" " + text, add_special_tokens=False).ids), len(b.encode(text))]
    assert [r.n_a, r.n_b] == n and r.n_links == r.n_a + r.n_b - r.n_groups
