"""The operators on Spark: edge cases and brute force on small tables."""

import base64
import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from risklens.llm import chat_tree, decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, metric_join, pieces, token_counts, url_filters, zip_warc
from risklens.plans.verify import compare

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{k % 997}" for k in range(20_000))
BASE = " ".join(f"base{k}" for k in range(120))
ROWS = [(1, None), (2, ""), (3, "one two"), (4, "one two"), (4, "one two"), (None, "one two"), (None, "lonely row"), (5, LONG),
        (6, LONG + " tail"), (7, "!!! 123"), (8, BASE), (9, BASE.replace("base60", "other")), (10, BASE + " end")]


@pytest.fixture(scope="module")
def docs(spark):
    # clashing and extra columns
    return spark.createDataFrame([(i, t, "en", 1, "x") for i, t in ROWS], "doc_id long, text string, lang string, id long, size string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_exact_dedup(spark, docs, empty):
    out = exact_dedup.exact_dedup(spark, *exact_dedup.split_history(docs)).collect()
    assert len(out) == len(ROWS) and sum(r.kept for r in out) == len({t or "" for _, t in ROWS})
    by = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in out}
    assert {(2, 2, 2, True), (1, 2, 2, False), (3, 4, 4, False), (None, 4, 4, False), (None, None, 1, True)} <= by
    assert exact_dedup.exact_dedup(spark, *exact_dedup.split_history(empty)).count() == 0
    kept = exact_dedup.keep_one(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() == len({t or "" for _, t in ROWS})


def test_jaccard_components(spark, docs, empty):
    got = [(r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark, docs, small=1).collect()]
    comp = {d: c for d, _, c in got}
    assert len(got) == len(ROWS) and comp[6] == 5 and comp[9] == comp[10] == 8 and comp[1] == 1 and comp[4] == 3
    assert jaccard_join.jaccard_components(spark, empty).count() == 0
    assert jaccard_join.keep_one(spark, docs, SF).columns == docs.columns


def all_pairs(sets, percent):
    """doc_id -> least doc_id that links reach, from all pairs of the sets."""
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for d in sorted(sets):
        for e in sorted(sets):
            if d < e and len(sets[d]) and len(sets[e]):
                c = len(sets[d] & sets[e])
                if 100 * c >= percent * (len(sets[d]) + len(sets[e]) - c) and find(d) != find(e):
                    lo, hi = sorted((find(d), find(e)))
                    parent[hi] = lo
    return {d: find(d) for d in sets}


def word_sets(texts, size):
    """Sets of word tuples, by the definition."""
    out = {}
    for d, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[d] = {tuple(words[k:k + size]) for k in range(max(len(words) - size + 1, 1))} if words else set()
    return out


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_jaccard_against_all_pairs(spark, size, percent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = word_sets({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}, size)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark, docs, size, percent).collect()}
    want = all_pairs(sets, percent)
    assert got == {d: (len(sets[d]), want[d]) for d in sets}


def test_jaccard_in_joining_blocks(spark, monkeypatch):
    """All regions with several components go through small blocks."""
    monkeypatch.setattr(metric_join, "MOST", 0)
    monkeypatch.setattr(metric_join, "WIDE_BLOCK", 16)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = word_sets({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}, 4)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark, docs, 4, 85).collect()}
    assert got == all_pairs(sets, 85)


def test_jaccard_in_cells(spark):
    """All regions with several components are cut by pivots."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = word_sets({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}, 4)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark, docs, 4, 85, small=0).collect()}
    assert got == all_pairs(sets, 85)


def test_line_dedup_against_all_pairs(spark):
    near = "this is a line of more than twenty-four characters é"
    rows = [(1, near + "\nshort\n\n" + near), (2, near.replace("line", "lime")), (3, near.replace("a line", "lines")), (4, "short"),
            (5, None), (5, near + " and quite some more"), (None, near)]
    rows += [(100 + k, f"template of a line numbered {k:05d} for all of them") for k in range(60)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, id long")
    got = {(r.doc_id, r.line_no): r.keep for r in line_dedup.dropped_lines(spark, docs, small=4).collect()}
    places = defaultdict(list)
    for d, t in rows:
        for k, x in enumerate(line_dedup.lines_of(t)):
            if x:
                places[x].append((d is None, d or 0, k))
    names = sorted(places)
    parent = {x: x for x in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(names):
        for y in names[:i]:
            if min(len(x), len(y)) >= line_dedup.MIN_CHARS and line_dedup.within(x, y, 2) <= 2:
                parent[find(x)] = find(y)
    first = {}
    for x in names:
        for p in places[x]:
            first[find(x)] = min(first.get(find(x), p), p)
    want = {(None if p[0] else p[1], p[2]): p == first[find(x)] for x in names for p in places[x]}
    assert got == want
    assert line_dedup.dropped_lines(spark, docs.limit(0)).count() == 0


def test_decontaminate(spark, docs, empty):
    passage = " ".join(f"Item{k}" for k in range(30))
    edited = passage.replace("Item7 ", "changed ").replace("Item20 ", "")
    items = spark.createDataFrame([(1, passage, 0), (2, None, 0), (3, "", 0), (None, "lonely row", 0)], "item_id long, text string, doc_id long")
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(50, BASE + " " + edited.lower() + ", " + BASE), (51, " ".join(passage.split()[:6]))], "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_copies(spark, more, items).collect()}
    assert got == {(50, 1), (None, None)}
    assert decontaminate.find_copies(spark, empty, items).count() == decontaminate.find_copies(spark, docs, items.limit(0)).count() == 0


def test_language_id(spark, docs, empty):
    table = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    got = language_id.identify(spark, table).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = language_id.identify(spark, docs.select("doc_id", "text", "lang")).collect()
    assert len(odd) == len(ROWS) and {r.lang_pred for r in odd if r.doc_id in (1, 2, 7)} == {"und"}
    assert language_id.identify(spark, empty).count() == 0


def test_tokens_of_every_row(spark, docs, empty):
    got = pieces.encode_documents(spark, docs, pieces.default_model(), keep_ids=True).collect()
    assert len(got) == len(ROWS) and all(len(r.ids) == r.n_tokens for r in got) and min(r.n_tokens for r in got) == 2
    counts = token_counts.count_tokens(spark, docs, token_counts.default_vocabulary()).collect()
    assert len(counts) == len(ROWS) and min(r.n_tokens for r in counts) == 0 and any(r.over_limit for r in counts)
    assert pieces.encode_documents(spark, empty, pieces.default_model()).count() == 0


def test_chat_tree(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "hi"),
            (None, None, None, None), (None, 0, "assistant", "x"), (2, 1, "assistant", "yes"), (4, 0, "user", "hi"), (4, 1, "assistant", "yes")]
    given = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, idx long")
    nodes, turns = chat_tree.pack(spark, given)
    stream, at = "", 0
    for r in nodes.orderBy("start").collect():
        assert r.start == at and sum(b - a for a, b in r.ancestors) == r.pos
        stream, at = stream + r.rendered, at + r.chars
    back = {r.conv_id: r for r in chat_tree.read_back(spark, nodes, turns).collect()}
    assert set(back) == {1, 2, 3, 4, None} and back[2].n_turns == 3 and back[2].loss_chars == 6 and back[None].loss_chars == 1
    assert back[3].turns_sha256 == hashlib.sha256(b"user\nhi\n").hexdigest()
    assert nodes.count() == 6  # shared turns stand once
    assert chat_tree.pack(spark, given.limit(0))[0].count() == 0


def test_packages_against_brute_force(spark):
    rows = [(3, "u", "same"), (1, "v", "same"), (1, "v", "same"), (2, None, None), (5, "w", ""), (None, "n", "same"), (None, "n", "own"), (9, "l", LONG)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n long")
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in zip_warc.read_packages(spark, zip_warc.write_packages(spark, pages)).collect())
    least, done, want = {}, set(), []
    for p, _, h in rows:
        least[h or ""] = min(least.get(h or "", 1 << 62), 1 << 62 if p is None else p)
    for p, _, h in rows:
        raw, first = (h or "").encode(), least[h or ""]
        alone = (p == first or p is None and first == 1 << 62) and (h or "") not in done
        done |= {h or ""} if alone else set()
        want.append((str(p), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if alone else "revisit", None if alone else first))
    assert got == sorted(want, key=lambda r: r[:4])
    assert zip_warc.read_packages(spark, zip_warc.write_packages(spark, pages.limit(0))).count() == 0


def test_url_filters(spark):
    day = url_filters.BUCKET
    entries = spark.createDataFrame([("example.org", "block", 10), ("example.org", "allow", 3 * day), ("a.example.org/x/", "allow", 20),
                                     ("org", "block", 0), (None, "block", 1), ("net", None, 1), ("net", "block", None)], "key string, action string, at long")
    seen = [(1, "http://A.example.org/x/y", 15, True, "example.org"), (2, "http://a.example.org/x/y?q", 25, False, "a.example.org/x/"),
            (3, "http://a.example.org/z", 2 * day, True, "example.org"), (4, "http://example.org", 3 * day, False, "example.org"),
            (5, "http://k.net/", 99, False, None), (6, None, 5, False, None), (7, "http://example.org", None, False, None), (None, "http://b.org/", 9 * day, True, "org")]
    captures = spark.createDataFrame([(p, u, t, 0) for p, u, t, _, _ in seen], "page_id long, url string, fetched_at long, key long")
    got = {(r.page_id, r.blocked, r.key) for r in url_filters.evaluate(captures, entries).collect()}
    assert got == {(p, b, k) for p, _, _, b, k in seen}
    assert url_filters.evaluate(captures.limit(0), entries).count() == 0 and url_filters.evaluate(captures, entries.limit(0)).where("blocked").count() == 0


@pytest.mark.parametrize("module", [exact_dedup, chat_tree, url_filters])
def test_oracle(spark, module):
    assert compare(module.query(spark, SF), module.SQL, SF)["ok"]


def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(spark, stage(spark, docs, SF), "t")
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
        sizes.append(out.count())
        docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * sizes[0]


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    import sentencepiece
    table = spark.read.parquet(f"{SF}/documents.parquet")
    net = language_id.train(language_id.training_sample(table))
    texts = {r.doc_id: r.text for r in table.collect()}
    for d, t in list(texts.items()):
        (lang,), (score,) = language_id.label(net, [t])
        if lang == language_id.UNKNOWN or score < language_id.MIN_SCORE:
            del texts[d]
    last = {t: max(d for d in texts if texts[d] == t) for t in set(texts.values())}
    texts = {d: t for d, t in texts.items() if last[t] == d}
    comp = all_pairs(word_sets(texts, 5), 80)
    texts = {d: t for d, t in texts.items() if comp[d] == d}
    number = {}
    words = lambda t: np.array([number.setdefault(w, len(number)) for w in re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", t.lower())], np.uint64)
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for d, t in list(texts.items()):
        own = words(t)
        if any(decontaminate.align(x, own[None], np.array([len(own)]))[0][0] >= decontaminate.THRESHOLD * decontaminate.MATCH * len(x) for x in items if len(x) and len(own)):
            del texts[d]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {d: library.encode(t, add_bos=True, add_eos=True) for d, t in texts.items()}


def test_frequent_copies_stay_copies(spark):
    """One edited and one cut copy in 50 documents each; the other n-grams of the items are in none."""
    words = [f"q{k}" for k in range(30)]
    edited = " ".join("other" if k in (7, 14, 21) else w for k, w in enumerate(words))
    cut = " ".join(f"r{k}" for k in range(20))
    items = spark.createDataFrame([(1, " ".join(words)), (2, cut + " " + " ".join(f"answer{k}" for k in range(12)))], "item_id long, text string")
    rows = [(k, f"before {k} {edited} after") for k in range(50)] + [(100 + k, f"{cut} then {k}") for k in range(50)] + [(200, BASE)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_copies(spark, table, items).collect()}
    assert set(got) == {(k, 1) for k in range(50)} | {(100 + k, 2) for k in range(50)}
    assert got[3, 1].score == 51 / 60 and (got[3, 1].start_word, got[3, 1].end_word) == (2, 32)
    assert (got[103, 2].start_word, got[103, 2].end_word) == (0, 20)


def test_links_across_tasks(spark):
    """Stars (P2, P1), (P2, B), (P1, A): P1, P2 and B are linked, A is near B alone."""
    from risklens.llm import metric_join
    from risklens.llm.components import components
    p2, p1, b, a = 1, 2, 3, 4
    place = {p2: 0.0, p1: 0.0, b: 1.0, a: 2.0}
    items = spark.createDataFrame([(k, x, 0.0) for k, x in place.items()], "id long, payload double, size double")
    stars = spark.createDataFrame([(p2, p1), (p2, b), (p1, a)], "a long, b long")
    links = metric_join.connect(spark, stars, items, lambda x, y: (abs(x - y) <= 1, abs(x - y)), 1.0, 1.0,
                                lambda ids: ids.withColumn("region", metric_join.F.lit(0).cast("long")))
    assert {r.comp for r in components(spark, links).where(f"id in ({p1}, {p2}, {b}, {a})").collect()} == {p2}
    assert (a,) in components(spark, links).select("id").collect()


def test_line_counts_of_every_document(spark):
    line = "a line that stands in some of the documents"
    rows = [(1, None), (2, ""), (3, " \n"), (4, f"own words of this one document\n{line}"), (5, f"Share this page\n{line}!"), (6, "Share this page!"), (6, "Share this page!"), (None, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_lines, r.n_dropped, r.dropped, [tuple(k) for k in r.kept]) for r in line_dedup.line_counts(spark, docs).collect())
    assert got == [(0, 1, 1, [0], [(4, 1)]), (1, 0, 0, [], []), (2, 0, 0, [], []), (3, 0, 0, [], []), (4, 2, 0, [], []),
                   (5, 2, 1, [1], [(4, 1)]), (6, 1, 1, [0], [(5, 0)]), (6, 1, 1, [0], [(5, 0)])]


def test_one_row_of_each_group_stays(spark):
    other, third = BASE.replace("base", "second"), BASE.replace("base", "third")
    rows = [(7, BASE), (None, BASE + " end"), (None, "a row alone"), (None, other), (None, other + " end"), (9, third), (9, third + " end"), (9, third + " !"), (9, "own words"),
            (None, None), (3, ""), (3, " ")]
    kept = jaccard_join.keep_one(spark, spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, id long"), SF).collect()
    left = [(r.doc_id, (r.text or "").split(" ")[0]) for r in kept]
    assert sorted(left, key=str) == sorted([(7, "base0"), (None, "a"), (None, "second0"), (9, "third0"), (9, "own"), (None, ""), (3, ""), (3, "")], key=str)


def test_links_are_measured_behind_sketches(spark, monkeypatch):
    """Only pairs whose sketches allow a link reach the payloads; all pairs come back."""
    from risklens.llm import metric_join

    rng, seen, keep = np.random.default_rng(3), [], metric_join.measure
    sets = [np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64)) for _ in range(20)]
    sets.append(sets[0][1:])
    items = spark.createDataFrame([(k, bytearray(s.tobytes()), bytearray(jaccard_join.sketch(s))) for k, s in enumerate(sets)], "id long, payload binary, sketch binary")
    pairs = spark.createDataFrame([(0, k) for k in range(1, 21)], "a long, b long")

    def measure(session, near, held, *more):
        seen.append((near.count(), held.count()))
        return keep(session, near, held, *more)

    monkeypatch.setattr(metric_join, "measure", measure)
    got = metric_join.measure_links(spark, pairs, items, jaccard_join.jaccard_distance(80), jaccard_join.may_link(80)).collect()
    assert sorted((r.a, r.b, r.link) for r in got) == [(0, k, k == 20) for k in range(1, 21)]
    assert seen == [(1, 2)]


def test_blocks_hold_counts_against_each_other(spark):
    """A region of more than one block on each side: all links between components are found,
    and lines whose characters differ too much are never compared."""
    lines = [f"{k:06b}" + "x" * (k // 40) for k in range(64)]
    rows = [(k, x, float(len(x)), k % 3, k % 3 > 0) for k, x in enumerate(lines)]
    items = spark.createDataFrame([r[:3] for r in rows], "id long, payload string, size double")
    held = spark.createDataFrame([(9, k, 0.0, s, c, o, sum(r[4] for r in rows), len(rows)) for k, _, s, c, o in rows],
                                 "region long, id long, d double, at double, comp long, out boolean, outside long, size long")
    counts, apart = line_dedup.char_counts, 4

    def linked(x, y):
        if np.abs(np.subtract(*line_dedup.char_counts([x, y]))).sum() > apart:
            raise AssertionError("counts rule this pair out")
        return line_dedup.within(x, y, 2) <= 2

    got = metric_join._in_blocks(held, items, linked, 2, 2, 8, counts, apart).collect()
    want = {(i, j) for j in range(64) for i in range(j) if i % 3 != j % 3 and line_dedup.within(lines[i], lines[j], 2) <= 2}
    assert want and {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_regions_that_blocks_hold_are_not_cut(spark, monkeypatch):
    """Lines that share two thirds of their text, in one region with over 64 outside: no cells,
    no second table of its members, and the classes of all pairs."""
    head, tags, keep = "the same beginning of every line here ", [], metric_join.stored
    lines = [head + f"{k * k * 7919 % 100_003:017b}" for k in range(150)]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    monkeypatch.setattr(metric_join, "stored", lambda s, df, tag: tags.append(tag) or keep(s, df, tag))
    got = {r.doc_id: r.keep for r in line_dedup.dropped_lines(spark, docs).collect()}
    assert {"work", "wide"} <= set(tags) and not {"spread", "final"} & set(tags)
    first = list(range(len(lines)))
    for j in range(len(lines)):
        for i in range(j):
            if line_dedup.within(lines[i], lines[j], 2) <= 2:
                low, high = sorted((first[i], first[j]))
                first = [low if f == high else f for f in first]
    assert got == {k: first[k] == k for k in range(len(lines))} and 60 < sum(got.values()) < 150
