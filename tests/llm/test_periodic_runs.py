"""Operator 12 against a scan of every period."""
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from revlens.llm import periodic_runs as R
from revlens.llm import queries


def plain_runs(w, s=R.Settings()):
    found = {}
    for q in range(1, len(w) // s.exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(s.least_words, s.exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((i, n, q) for (i, n), q in found.items())


def test_cover_brings_all_places_together():
    assert {(a - b) % R.V for a in R.COVER for b in R.COVER} == set(range(R.V))
    into = {c % R.V for c in R.COVER}
    assert all((r + R.SHIFT[r, t]) % R.V in into and (t + R.SHIFT[r, t]) % R.V in into for r in range(R.V) for t in range(R.V))


def test_extensions_equal_comparing():
    random.seed(2)
    for _ in range(60):
        k = random.choice([1, 2, 3])
        x = np.array([random.randrange(k) for _ in range(random.randint(2, 400))] + [9], dtype=np.int64)
        i, j = np.array([random.sample(range(len(x) - 1), 2) for _ in range(50)] if len(x) > 2 else [[0, 1]]).T
        want = [next(t for t in range(len(x)) if x[a + t] != x[b + t] or max(a, b) + t == len(x) - 1) for a, b in zip(i, j, strict=True)]
        assert R.Extensions(x)(i, j).tolist() == want


def test_runs_equal_brute_force(monkeypatch):
    random.seed(3)
    monkeypatch.setattr(R, "PAIRS", 500)
    for _ in range(300):
        docs = []
        for _ in range(random.randint(1, 7)):
            k = random.choice([1, 2, 3, 5, 50])
            w = [random.randrange(k) for _ in range(random.choice([0, 1, 5, 6, 7, 8, 30, 200]))]
            for most in (30, 9):
                if w:
                    p = random.randint(1, max(1, len(w) // 3))
                    w += w[-p:] * random.randint(0, most) + [random.randrange(k) for _ in range(random.randint(0, 9))]
            docs.append(w)
        got = R.runs_of([np.array(w, dtype=np.int64) for w in docs], R.Settings())
        assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(w) for w in docs]


def test_other_settings():
    w = [1, 2] * 3 + [5] * 4
    s = R.Settings(least_words=4, exponent=2)
    assert [tuple(r) for r in R.runs_of([np.array(w)], s)[0].tolist()] == plain_runs(w, s) == [(0, 6, 2), (6, 4, 1)]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a a a a a a b", "x"), (1, None, "x"), (2, " \t\n", None), (2, " \t\n", None), (3, "x" * 100_000, None)],
                                 "doc_id long, text string, runs string")
    got = sorted(((r.doc_id or -1), [tuple(x) for x in r.runs], r.collapsed) for r in R.find_runs(docs).collect())
    assert got == [(-1, [(0, 6, 1)], "a b"), (1, [], ""), (2, [], ""), (2, [], ""), (3, [], "x" * 100_000)]
    assert R.find_runs(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    got = {r.doc_id: r.asDict() for r in queries.op12_periodic_runs(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs) and sum(r["n_runs"] for r in got.values()) > 10
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        gone = {k for i, m, q in runs for k in range(i + q, i + m)}
        assert got[d.doc_id] == {
            "doc_id": d.doc_id, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": 1000 * best[1] // best[2] if runs else None,
            "runs_sha256": hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()}
