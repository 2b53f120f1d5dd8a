"""Periodic runs against plain loops, extensions against plain comparison."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import periodic_runs as P

SCHEMA = "doc_id long, text string, runs string, best int, start long, length string, period long, n_words int"


def table(spark, rows):
    """Further columns have names that the operator uses inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", 3, 4) for i, t in rows], SCHEMA)


def plain_runs(w):
    """(start, length, period) of every run, by trying all periods at all places."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        s = 0
        while s + q < len(w):
            e = s + q
            while e < len(w) and w[e] == w[e - q]:
                e += 1
            if e - s >= max(6, 4 * q):
                found.setdefault((s, e), q)  # smaller periods come first
            s = e - q + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain(rows):
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        n = len(w)
        if i is not None and n:
            h = zlib.crc32(str(i).encode())
            if h % 10 == 0:
                g = h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(w)
        gone = {k for s, n_, q in runs for k in range(s + q, s + n_)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        out.append((
            i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{n_},{q}\n" for s, n_, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
                   for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for i in range(400):
        letters = "ab" if i % 3 else "abcdefghij"
        w = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
        for _ in range(i % 4):
            unit = [rng.choice(letters) for _ in range(rng.randint(1, 6))]
            w += unit * rng.randint(2, 9) + unit[:rng.randint(0, len(unit))] + [rng.choice(letters) for _ in range(rng.randint(0, 5))]
        out.append((i, rng.choice([" ", "\t", "\n", " \r\f\v "]).join(w)))
    out += [(400, None), (401, ""), (402, " \n "), (403, "a " * 500), (404, "a b " * 300 + "a"), (405, "é é é é é é"), (406, "a" * 5000)]
    out += [(407, "x y x z " * 40), (None, "a a a a a a"), (None, None), (3, "a b " * 8), (3, "a b " * 8), (408, "a a a a a b b b b b b")]
    return out + [(409, "a a a a a a a a a a a a"), (410, "one\x1ctwo " * 6)]  # other white space is part of a word


def test_like_plain_loops(spark, rows, monkeypatch):
    want = plain(rows)
    run = lambda d: P.longest_run(P.find_runs(d, P.repeated_from_id))
    assert got(run(table(spark, rows))) == want
    monkeypatch.setattr(P, "BATCH", 100)
    assert got(run(table(spark, rows).repartition(3))) == want
    assert sum(w[1] for w in want) > 300 and max(w[1] for w in want) > 3


def test_runs_and_texts_are_real(spark):
    r = P.find_runs(table(spark, [(1, "x a b a b a b a b a y y y y y y z")])).first()
    assert [tuple(x) for x in r.runs] == [(1, 9, 2), (10, 6, 1)] and r.collapsed == "x a b y z" and r.n_words == 17
    assert P.find_runs(table(spark, [])).count() == 0


def test_ties_take_the_first(spark):
    r = P.longest_run(P.find_runs(table(spark, [(1, "a b " * 4 + "c " + "d " * 6 + "e f " * 4)]))).first()
    assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (3, 9, 6, 1, 6000)
    r = P.longest_run(P.find_runs(table(spark, [(1, "a b " * 4 + "c d " * 4)]))).first()
    assert (r.n_runs, r.start, r.period) == (2, 0, 2)


def test_extensions():
    rng = np.random.default_rng(0)
    for kinds, n in ((1, 300), (2, 500), (3, 2000), (50, 3000)):
        w = rng.integers(0, kinds, n)
        w[n // 2:n // 2 + n // 4] = w[:n // 4]
        w = np.concatenate([[kinds], w, [kinds + 1]])
        g = P.Grammar(w)
        back = g.reversed()
        assert all(len(a.symbol) > len(b.symbol) for a, b in zip(g.levels, g.levels[1:]))
        x = rng.integers(1, n, 300)
        y = np.where(np.arange(300) % 2, rng.integers(1, n, 300), np.minimum(x + n // 2, n))
        x, y = x[x != y], y[x != y]
        ahead, behind = g.extension(x, y), back.extension(len(w) - x, len(w) - y)
        for i, j, a, b in zip(x.tolist(), y.tolist(), ahead.tolist(), behind.tolist()):
            k = 0
            while max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            assert a == k
            k = 0
            while min(i, j) - k > 0 and w[i - k - 1] == w[j - k - 1]:
                k += 1
            assert b == k


def test_very_long_text(spark):
    """Chains of false grid places and one run over most of a million words."""
    text = "the " + " ".join(f"the w{i}" for i in range(50_000)) + " a b c" * 300_000
    r = P.find_runs(table(spark, [(1, text)]), kept=False).first()
    assert [tuple(x) for x in r.runs] == [(100_001, 900_000, 3)]
