"""Phrase collocations: against DuckDB and a count of everything in Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from risklens.llm import phrases
from risklens.plans.verify import compare, duck

SF = "/root/testdata/sf0.01"


def expected(rows, least, top):
    """All phrases counted one by one, then scored as the contract says."""
    found, total = Counter(), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, 5):
                found.update((lang or "und", tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    kept = {}
    for (lang, p), a in found.items():
        if len(p) < 2 or a < least:
            continue
        cuts = [(2000000 * a // (found[lang, p[:c]] + found[lang, p[c:]]), c, found[lang, p[:c]], found[lang, p[c:]]) for c in range(1, len(p))]
        kept[lang, p] = (a, *min(cuts))
    for (lang, p), (a, *_) in list(kept.items()):
        for s in range(2, len(p)):
            for i in range(len(p) - s + 1):
                if (lang, p[i:i + s]) in kept and 100 * a >= 80 * found[lang, p[i:i + s]]:
                    kept[lang, p[i:i + s]] += ("gone",)
    out = []
    for lang in total:
        own = sorted((-v[1], -v[0], " ".join(p).encode(), v) for (x, p), v in kept.items() if x == lang and v[-1] != "gone")
        out += [(lang, k, p.decode(), v[0], v[3], v[4], total[lang], v[1]) for k, (_, _, p, v) in enumerate(own[:top], 1)]
    return sorted(out)


def some_rows(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(25)] + ["Ä", "ä", "A", "x" * 40, "x" * 39 + "y", "a b"]
    rows = []
    for _ in range(150):
        text = [rng.choice(words[:3 + rng.randrange(28)]) for _ in range(rng.randrange(60))]
        rows.append((rng.choice(["en", "en", "en", "und", None]), rng.choice([" ", "  ", "\t"]).join(t + rng.choice(["", "", "", ".", "\n", "\r\n", ";"]) for t in text)))
    return rows + [("en", None), ("fr", ""), ("de", " . ,"), (None, "same same same same same " * 30)] + [("en", "of Of OF of of")] * 12


@pytest.mark.parametrize("sample,bits", [(1, 1 << 20), (4, 1 << 16), (10**9, 1 << 10)])
def test_all_counts(spark, sample, bits):
    """Whatever the sample proposes, and however full the filters are."""
    rows = some_rows(sample % 7)
    docs = spark.createDataFrame([(k // 2 if k % 5 else None, t, lang, 1) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n int").repartition(5)
    for least, top in ((5, 2000), (2, 7)):
        got = phrases.collocations(spark, docs, least, top, sample, bits)
        assert sorted(tuple(r) for r in got.collect()) == expected(rows, least, top)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(spark, docs).count() == 0
    docs = spark.createDataFrame([(1, None, None), (None, "", "en")], "doc_id long, text string, lang string")
    assert phrases.collocations(spark, docs).count() == 0


def test_query_against_duckdb(spark):
    assert compare(phrases.query(spark, SF), phrases.SQL, SF, duck(SF))["ok"]


def test_words_and_pieces():
    for _, text in some_rows(3):
        raw = (text or "").encode()
        h, piece, start, end = phrases.words_of(raw, 0)
        words = [raw[a:b] for a, b in zip(start, end)]
        assert words == re.findall(rb"[^\x20\x09.,;:!?\x0a-\x0d]+", raw)
        assert len(set(words)) == len(set(h.tolist()))
        for i in range(len(words) - 1):
            assert (piece[i] == piece[i + 1]) == (not phrases.PIECE_END.search(raw[end[i]:start[i + 1]]))
    long = "one two, " * 400_000
    parts = [p for s in phrases.segments([long, None, "tail"]) for p in s]
    assert b"".join(parts) == (long + "tail").encode() and len(parts) > 3 and all(p.endswith(b",") for p in parts[:-2])


def test_filter_has_no_false_negatives():
    h = np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64)
    own = phrases.Filter(1 << 12)
    own.add(h[:500])
    assert own.holds(h[:500]).all() and not own.holds(h[500:]).all()


def test_products_beyond_64_bits(spark):
    """A score's arithmetic on counts of 10**13 and more."""
    got = spark.range(1).selectExpr("cast((cast(30000000000000 as decimal(28, 0)) * 2000000BD) div (cast(30000000000001 as decimal(28, 0)) + 40000000000000) as bigint) s").first().s
    assert got == 2000000 * 30000000000000 // 70000000000001


def test_words_that_share_a_hash_are_seen(monkeypatch):
    """With a hash of the first letter only, every word with its letters comes back."""
    def first_letter(raw, seed):
        words = [m.span() for m in re.finditer(rb"[^\x20\x09.,;:!?\x0a-\x0d]+", raw)]
        a, b = np.array([w[0] for w in words]), np.array([w[1] for w in words])
        return np.array([raw[x] for x in a], np.uint64), np.zeros(len(a), int), a, b

    monkeypatch.setattr(phrases, "words_of", first_letter)
    own = phrases.Counter((), [], 0)
    own.add("en", b"apple ant apple bee ant apply")
    own.add("de", b"apple b")
    every = phrases.Filter(1 << 10, np.full(16, (1 << 64) - 1, np.uint64))
    got = {(r["lang"], r["word"]) for b in own.letters(every) for r in b.to_pylist()}
    assert got == {("en", w) for w in ("apple", "ant", "bee", "apply")} | {("de", "apple"), ("de", "b")}


def test_groups_under_a_shared_hash():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 5, 300), rng.integers(0, 5, 300)
    for key in (x * 8 + y, x, np.zeros(300, int)):
        at, n = phrases.grouped(key.astype(np.uint64), [x, y])
        assert {(x[i], y[i]): m for i, m in zip(at, n)} == {k: int(((x == k[0]) & (y == k[1])).sum()) for k in set(zip(x, y))}


def test_letters_meet_the_words_once(spark, monkeypatch):
    """Stretches of tasks repeat their words: these are one row each before they meet the wanted ones."""
    plans, keep = {}, phrases.stored

    def stored(session, df, name):
        plans[name] = df._jdf.queryExecution().analyzed().toString()
        return keep(session, df, name)

    monkeypatch.setattr(phrases, "stored", stored)
    texts = spark.createDataFrame([("en", "a b c a b")] * 20, "lang string, text string")
    seed = 0
    h = phrases.words_of(b"a b", seed)[0].view(np.int64).tolist()
    wanted = spark.createDataFrame([("en", 2, *h, 0, 0, 40)], phrases.COUNTED)
    got = phrases.letters_pass(spark, texts, wanted, seed, 1 << 16).collect()
    assert sorted((r.w1, r.word) for r in got) == sorted(zip(h, "ab"))
    lines = plans["letters"].splitlines()
    join, first = (next(k for k, x in enumerate(lines) if w in x) for w in ("Join LeftSemi", "Aggregate"))
    assert join < first


def test_letters_are_joined_behind_the_grouping(spark, monkeypatch):
    """The optimizer must not move the semi join below the grouping again."""
    plans, keep = {}, phrases.stored

    def stored(session, df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return keep(session, df, name)

    monkeypatch.setattr(phrases, "stored", stored)
    h = phrases.words_of(b"a b", 0)[0].view(np.int64).tolist()
    wanted = spark.createDataFrame([("en", 2, *h, 0, 0, 40)], phrases.COUNTED)
    texts = spark.createDataFrame([("en", "a b c a b")] * 20, "lang string, text string")
    assert phrases.letters_pass(spark, texts, wanted, 0, 1 << 16).count() == 2
    lines = plans["letters"].splitlines()
    join, group = (next(k for k, x in enumerate(lines) if w in x) for w in ("Join LeftSemi", "Aggregate"))
    assert join < group


def test_counts_travel_packed(spark):
    """Tasks send few rows, of many phrases each; the counts are all there."""
    texts = spark.createDataFrame([("en", " ".join(f"w{k % 50}" for k in range(4000)))] * 3 + [("fr", "w1 w2")], "lang string, text string").repartition(2)
    got = phrases.count_pass(spark, texts, (1,), [], 0, 1)
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString() and "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = got.collect()
    assert sorted((r.lang, r.n) for r in rows if r.k == 0) == [("en", 12000), ("fr", 2)]
    assert sorted((r.lang, r.n) for r in rows if r.k == 1) == [("en", 240)] * 50 + [("fr", 1)] * 2
