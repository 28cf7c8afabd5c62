"""MinHash near-dedup: against all pairs of full sets."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from risklens.llm import minhash_dedup as M

SF = "/root/testdata/sf0.01"


def shingles(text, size):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", low)
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def all_pairs(rows, size=2, percent=80):
    """Expected rows, from the full sets of all documents that share a shingle."""
    sets = [shingles(t, size) for _, t in rows]
    distinct = sorted(set(sets) - {frozenset()}, key=lambda s: sorted(s))
    number = {s: k for k, s in enumerate(distinct)}
    parent = list(range(len(distinct)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    holders = defaultdict(list)
    for k, s in enumerate(distinct):
        shared = defaultdict(int)
        for x in s:
            for other in holders[x]:
                shared[other] += 1
            holders[x].append(k)
        for other, n in shared.items():
            if 100 * n >= percent * (len(s) + len(distinct[other]) - n):
                parent[find(other)] = find(k)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            root = find(number[s])
            least[root] = min(i, least.get(root, i))
    out = []
    for (i, _), s in zip(rows, sets):
        c = least.get(find(number[s])) if s else i
        out.append((i, len(s), c, i == c))
    return sorted(out, key=repr)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def some_rows(seed):
    """Copies, near copies in chains, texts that share a passage, and odd rows."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    rows, i = [], 0
    passage = [word() for _ in range(90)]
    for _ in range(25):
        text = [word() for _ in range(rng.randrange(2, 150))]
        for _ in range(rng.randrange(1, 8)):
            text = list(text)
            for _ in range(rng.randrange(1 + len(text) // 20)):
                text[rng.randrange(len(text))] = word()
            rows.append((i, " ".join(text)))
            i += rng.randrange(1, 3)
    for _ in range(60):
        rows.append((i, " ".join(passage + [word() for _ in range(rng.randrange(40))])))
        i += 1
    rows += [(None, rows[3][1]), (None, rows[3][1]), (None, "only without id"), (None, "only without id"), (7, None), (8, ""), (9, " \t"), (i, "One"), (i + 1, "one"),
             (i + 2, "a b"), (i + 2, "A  B"), (i + 2, "c d")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block", [(1, 2048), (2, 8)])
def test_all_pairs(spark, seed, block):
    rows = some_rows(seed)
    docs = spark.createDataFrame([(i, t, b"x", 1, 2) for i, t in rows], "doc_id long, text string, name binary, own int, id int").repartition(7)
    assert as_rows(M.near_components(spark, docs, block=block)) == all_pairs(rows)


def test_empty_and_many_null_ids(spark):
    docs = spark.createDataFrame([(None, f"row {k % 5} of the same few words") for k in range(400)] + [(1, None)], "doc_id long, text string")
    out = M.near_components(spark, docs)
    assert out.count() == 401 and as_rows(M.near_components(spark, docs.limit(0))) == []


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert as_rows(M.query(spark, SF)) == all_pairs(rows)


def test_posterior_bounds():
    """A pair at the threshold is dropped as rarely as the bounds say, and an unlike pair soon."""
    least = M.least_matches(80, 1e-3)
    rng = np.random.default_rng(0)
    zeros = np.zeros((20_000, M.CHECKS), np.uint8)
    at = lambda s: (rng.random((20_000, M.CHECKS)) >= s + (1 - s) / 256).astype(np.uint8)
    assert len(M.survivors(zeros, at(0.8), least)) > 20_000 * (1 - 8 * 2e-3)
    assert len(M.survivors(zeros, at(0.4), least)) < 20
    assert M.least_matches(80, 1e-6) == sorted(M.least_matches(80, 1e-6)) and M.least_matches(80, 1e-6)[-1] < least[-1] < M.CHECKS


def test_signatures_estimate_the_similarity():
    x, y = np.arange(1000, dtype=np.uint64), np.arange(100, 1100, dtype=np.uint64)
    same = np.mean([a == b for a, b in zip(M.check_signature(x), M.check_signature(y))])
    assert abs(same - 900 / 1100) < 0.12
    assert (M.band_signatures(x) == M.band_signatures(x[::-1].copy())).all()
