"""Periodic runs: against all periods by brute force, whole, in tiles and on Spark."""

import hashlib
import random

import pytest

from risklens.llm import periodic_runs

SF = "/root/testdata/sf0.001"


def brute(words):
    """All runs, by trying every period at every place."""
    least = {}
    for q in range(1, len(words) // 4 + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        i = 0
        while i < len(same):
            j = i
            while same[j]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                least.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in least.items())


def some_words(rng, n):
    """Random words with pieces that repeat, also inside each other."""
    words = [b"w%d" % rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 3 else 0):
        a, p = rng.randrange(n), 1 + rng.randrange(max(1, n // 3))
        for i in range(a + p, rng.randrange(a, n)):
            words[i] = words[i - p]
    return words


def expected(doc_id, text):
    words = periodic_runs.planted(doc_id, (text or "").encode().split())
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    drop = {i for a, n, q in runs for i in range(a + q, a + n)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("dense", [1, 64])
def test_whole_documents(monkeypatch, dense):
    monkeypatch.setattr(periodic_runs, "DENSE", dense)
    rng = random.Random(dense)
    for _ in range(40):
        docs = [some_words(rng, rng.choice([0, 1, 5, 6, 7, 20, 60, 200])) for _ in range(20)]
        assert periodic_runs.whole_runs(docs) == [brute(w) for w in docs]
    assert periodic_runs.whole_runs([]) == []


def test_z_function():
    rng = random.Random(3)
    for _ in range(200):
        x = [rng.randrange(2) for _ in range(rng.randrange(30))]
        assert periodic_runs.z_function(x) == [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(len(x))]


@pytest.mark.parametrize("whole", [8, 64])
def test_fragments_of_tiles_cover_every_run(whole):
    rng = random.Random(whole)
    for _ in range(200):
        words = some_words(rng, rng.choice([6, 20, 60, 200, 400]))
        w, least = periodic_runs.numbered(words), {}
        spans = {}
        for lo, hi, at, core, held in periodic_runs.tiles(len(w), whole):
            for k in range(lo, hi + 1):
                for q, a, b in periodic_runs.octave_stretches(w[at:at + held], k, core, at == 0, at + held >= len(w), len(w) // 4):
                    spans.setdefault(q, set()).update(range(a + at, b + at))
        for q, places in spans.items():
            for a in (i for i in places if i - 1 not in places):
                n = next(k for k in range(len(w) + 1) if a + k not in places) + q
                if n >= max(6, 4 * q):
                    least[a, n] = min(q, least.get((a, n), q))
        assert sorted((a, n, q) for (a, n), q in least.items()) == brute(words)


def test_on_spark(spark):
    rng = random.Random(7)
    rows = [(k, b" ".join(some_words(rng, rng.choice([0, 6, 30, 200, 700]))).decode()) for k in range(120)]
    rows += [(None, "a b " * 40), (None, "a b " * 40), (5, "a " * 500), (5, "a " * 500), (7, None), (8, ""), (9, " \t\n"), (10, "ä ä " * 300 + "　 " * 9)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, key int, runs string")
    want = sorted((expected(*r) for r in rows), key=repr)
    assert as_rows(periodic_runs.digests(periodic_runs.periodic_runs(spark, docs, periodic_runs.planted))) == want
    empty = periodic_runs.digests(periodic_runs.periodic_runs(spark, docs.limit(0), periodic_runs.planted))
    assert empty.count() == 0 and empty.columns[0] == "doc_id"


def test_exploded_on_spark(spark):
    """Every document of 64 words or more goes through tiles, shuffles and stitching."""
    rng = random.Random(11)
    rows = [(k, b" ".join(some_words(rng, rng.choice([60, 100, 300, 900]))).decode()) for k in range(60)] + [(None, "a b c " * 200)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tiled = periodic_runs.periodic_runs(spark, docs, whole=64)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs]) for r in tiled.collect()), key=repr)
    assert got == sorted(((i, len(t.split()), brute(t.split())) for i, t in rows), key=repr)
    assert sorted(map(repr, as_rows(tiled))) == sorted(map(repr, as_rows(periodic_runs.periodic_runs(spark, docs))))


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert as_rows(periodic_runs.query(spark, SF)) == sorted((expected(r.doc_id, r.text) for r in docs), key=repr)
