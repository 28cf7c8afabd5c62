"""Phrase collocations by Toivonen's mining: a sample proposes, full passes count.

Phrases of 1 to ``LONGEST`` words lie inside pieces of texts; everything is per
language. A phrase is frequent if it occurs ``MIN_COUNT`` times or more in all
documents, and so are then the phrases in it.

1. A sample of the documents (one in ``SAMPLE``, by a hash of the row) is mined level by
   level with a threshold that is lowered for its size. The phrases found are the
   proposal.
2. One pass over all documents counts, exactly, all words, the proposal and its
   negative border: phrases that aren't proposed though the longest phrases in them
   are. Both are the phrases whose first and last words but one are proposed.
3. Where phrases of the border turn out frequent the proposal has failed: longer ones
   may hold them. A further pass counts those whose parts are all known to be frequent
   and that no earlier pass has counted, until a pass finds nothing that could grow.

The sample decides what is counted when, never what is returned. Sets of phrases
reach the tasks as Bloom filters of at most ``FILTER_BITS`` bits, so what is broadcast
has a bound at any size of data: a fuller filter lets more phrases be counted, never
fewer. A task counts in stretches of ``FLUSH`` words by sorting, so the shuffle gets one
row per phrase and stretch, and no phrase's or language's rows meet before they are
added up. These rows travel packed, some for each language's and phrase's share of the
hashes, and are added up in numpy.

Words travel as 64-bit hashes. A last pass fetches the letters of the words that stand
in frequent phrases, from all documents; should such a hash stand for two words, that
is seen there and the run is repeated with another hash: the result rests on no
collision. (A shared hash only ever adds to counts, so no other words matter.)

Edge cases: null or empty texts hold no words; a null language is ``und``; nulls,
ties and repeated rows in other columns don't matter, every row counts; empty tables
give empty results; very long texts are read in segments cut between pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from risklens.llm.bloom import Filter, bits_for, broadcast_filter
from risklens.llm.common import bounded_batches, input_bytes, partitions_for, stored
from risklens.llm.shingles import mix

LONGEST = 4
MIN_COUNT = 30
TOP = 2000
#: A candidate goes if a longer one that holds it occurs so many percent as often.
INSIDE_PERCENT = 80
#: One document in so many is in the sample; a phrase is proposed if the sample holds
#: it at SLACK times the rate of the least frequent one, and twice at least.
SAMPLE = 8
SLACK = 0.6
#: Bits of a filter at most.
FILTER_BITS = 1 << 27
#: Words that a task counts at a time, and bytes of text that it reads at a time.
FLUSH = 1 << 20
SEGMENT = 1 << 20
#: Bytes of packed counts for a byte of stored input, seen on prose, and bytes of them
#: that a task adds up; size partitions only.
COUNTS_RATIO = 5.0
COUNTS_BYTES = 16 << 20
#: Words that a task remembers to have sent, and bytes of a batch of packed counts.
SENT = 1 << 18
PACKED_BYTES = 4 << 20

PIECE_END = re.compile(rb"[.,;:!?\x0a-\x0d]")
_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BETWEEN = _PIECE.copy()
_BETWEEN[[0x20, 0x09]] = True
WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]
KEY = ["lang", "k", *WORDS]
COUNTED = "lang string, k int, " + "".join(f"{w} long, " for w in WORDS) + "n long"
_SCHEMA = pa.schema([("lang", pa.string()), ("k", pa.int32()), *[(w, pa.int64()) for w in WORDS], ("n", pa.int64())])


def lang_hash(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8")))


def phrase_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one word more; a language's hash is before all."""
    return mix(before * np.uint64(0x94D049BB133111EB) + word)


def segments(texts: list[str | None]) -> Iterator[list[bytes]]:
    """Texts by the list, some SEGMENT bytes in each; a longer text is cut behind the
    end of a piece, so no phrase is cut."""
    held, size = [], 0
    for t in texts:
        raw = (t or "").encode("utf-8")
        at = 0
        while at < len(raw):
            end = len(raw)
            if end - at > SEGMENT and (cut := PIECE_END.search(raw, at + SEGMENT)):
                end = cut.end()
            held.append(raw[at:end])
            size, at = size + end - at, end
            if size >= SEGMENT:
                yield held
                held, size = [], 0
    if held:
        yield held


def words_of(raw: bytes, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, piece, start, end) of each word of a text with A-Z in lower case."""
    b = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], ~_BETWEEN[b], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    piece = np.cumsum(_PIECE[b])[start] if len(start) else start
    size = end - start
    h = np.full(len(start), (2 * seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    order = np.argsort(33 - np.minimum(size, 33).astype(np.uint8), kind="stable")  # the longest first: those with a t-th byte are a prefix
    at, longest, own = start[order], size[order], h.copy()
    upto = len(h) - np.cumsum(np.bincount(np.minimum(size, 33), minlength=34))  # words of more than t bytes
    more = upto[32]
    for t, upto in enumerate(upto[:32].tolist()):
        if not upto:
            break
        own[:upto] = mix((own[:upto] ^ (b[at[:upto] + t].astype(np.uint64) + np.uint64(1))) * np.uint64(0xBF58476D1CE4E5B9))
    for k in range(more):
        own[k] = xxhash.xxh3_64_intdigest(raw[at[k]:at[k] + longest[k]], seed)
    h[order] = own
    return h, piece, start, end


def grouped(key: np.ndarray, columns: list[np.ndarray], n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each group, its size or the sum of its ``n``) of rows equal in all
    ``columns``, sorted by a hash of them; where that hash is shared, by the columns themselves."""
    if not len(key):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    if any((c[order[1:]] != c[order[:-1]])[same].any() for c in columns):
        order = np.lexsort(columns)
        same = np.logical_and.reduce([c[order[1:]] == c[order[:-1]] for c in columns])
    starts = np.flatnonzero(np.r_[True, ~same])
    return order[starts], np.diff(np.r_[starts, len(key)]) if n is None else np.add.reduceat(n[order], starts)


def entry(k: int) -> np.dtype:
    """A packed count of a phrase of ``k`` words."""
    return np.dtype([("lang", "<i4"), ("n", "<i4"), *[(w, "<u8") for w in WORDS[:k]]])


def hash_of(langs: list[str], lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    h = np.array([lang_hash(x) for x in langs], np.uint64)[lang]
    for w in words:
        h = phrase_hash(h, w)
    return h


def counted_rows(langs: list[str], lang: np.ndarray, k: int, words: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
    zero = np.zeros(len(n), np.int64)
    columns = [pa.DictionaryArray.from_arrays(pa.array(lang.astype(np.int32)), pa.array(langs, pa.string())).cast(pa.string()),
               pa.array(np.full(len(n), k, np.int32)),
               *[pa.array(words[t].view(np.int64) if t < len(words) else zero) for t in range(LONGEST)], pa.array(n.astype(np.int64))]
    batch = pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)
    for at in range(0, len(n), 100_000):
        yield batch.slice(at, 100_000)


class Counter:
    """Counts of phrases in the words of a task, FLUSH at a time.

    ``levels``: numbers of words to count. ``filters``: the sets that passes have
    worked with, this pass's last: a phrase of two words or more is counted if its
    first and last words but one are in the last set and weren't in an earlier one.
    """

    def __init__(self, levels: tuple[int, ...], filters: list[Filter], seed: int):
        self.levels, self.filters, self.seed = levels, filters, seed
        self.clear()

    def clear(self) -> None:
        self.texts, self.parts, self.held = [], [], 0

    def add(self, lang: str, raw: bytes) -> None:
        raw = raw.lower()  # of bytes: ASCII letters only
        h, piece, start, end = words_of(raw, self.seed)
        if len(h):
            self.parts.append((lang, h, piece.astype(np.int32), start.astype(np.int32), end.astype(np.int32)))
            self.texts.append(raw)
            self.held += len(h)

    def joined(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(languages, number of each word's, its hash) of what is held."""
        langs = sorted({p[0] for p in self.parts})
        number = {lang: k for k, lang in enumerate(langs)}
        lang = np.repeat(np.array([number[p[0]] for p in self.parts], np.int32), [len(p[1]) for p in self.parts])
        return langs, lang, np.concatenate([p[1] for p in self.parts])

    def flush(self) -> Iterator[tuple]:
        """(languages, number of each phrase's, words in it, their hashes, its count)."""
        if not self.held:
            return
        langs, lang, h = self.joined()
        # does the next word stand in the same piece?
        follows = np.concatenate([np.r_[p[2][1:] == p[2][:-1], False] for p in self.parts])
        first = np.arange(len(h))
        hashes = phrase_hash(np.array([lang_hash(x) for x in langs], np.uint64)[lang], h)
        if 1 in self.levels:
            at, n = grouped(hashes, [lang, h])
            yield langs, lang[at], 1, [h[at]], n
            yield langs, np.arange(len(langs)), 0, [], np.bincount(lang)
        # for each filter: whether it holds the parts of a phrase, and so all within it;
        # a phrase that a filter holds by accident alone was out of its pass's reach
        parts = [np.ones(len(h), bool) for _ in self.filters]
        for k in range(2, max(self.levels, default=1) + 1):
            # hashes[i]: the phrase of k - 1 words from word first[i] on
            inside = [held & f.holds(hashes) for held, f in zip(parts, self.filters)]
            last = np.searchsorted(first, first + 1)
            last[last == len(first)] = 0
            fits = (first[last] == first + 1) & follows[np.minimum(first + k - 2, len(h) - 1)]  # both parts are here, in one piece
            parts = [fits & f & f[last] for f in inside]
            go = np.flatnonzero(np.logical_or.reduce(parts))
            if not len(go):
                break
            parts, first, hashes = [f[go] for f in parts], first[go], phrase_hash(hashes[go], h[first[go] + k - 1])
            if k in self.levels:
                take = parts[-1].copy()
                for f in parts[:-1]:
                    take &= ~f
                own = first[take]
                at, n = grouped(hashes[take], [lang[own], *[h[own + t] for t in range(k)]])
                at = own[at]
                yield langs, lang[at], k, [h[at + t] for t in range(k)], n
        self.clear()

    def letters(self, wanted: Filter, sent: set | None = None) -> Iterator[pa.RecordBatch]:
        """(lang, w1, word) of the words held that ``wanted`` holds, but for those in
        ``sent``, which remembers the first SENT."""
        if not self.held:
            return
        langs, lang, h = self.joined()
        base = np.repeat(np.cumsum([0, *map(len, self.texts[:-1])]), [len(p[1]) for p in self.parts])
        start, end = (np.concatenate([p[k] for p in self.parts]) + base for k in (3, 4))
        raw = b"".join(self.texts)
        letter = np.frombuffer(raw, np.uint8)
        key = phrase_hash(np.array([lang_hash(x) for x in langs], np.uint64)[lang], h)
        own = np.flatnonzero(wanted.holds(key))
        own = own[np.argsort(key[own])]
        # each word is held against the first of its hash, letter by letter
        lead = np.r_[True, key[own[1:]] != key[own[:-1]]][:len(own)]
        to = own[np.maximum.accumulate(np.where(lead, np.arange(len(own)), 0))] if len(own) else own
        size = (end - start)[own]
        odd = lead | (size != (end - start)[to])
        left = np.flatnonzero(~odd)
        for t in range(int(size.max(initial=0))):
            left = left[size[left] > t]
            differs = letter[start[own[left]] + t] != letter[start[to[left]] + t]
            odd[left[differs]] = True
        found = {(langs[lang[i]], int(h[i].view(np.int64)), raw[start[i]:end[i]]) for i in own[odd].tolist()}
        sent = set() if sent is None else sent
        rows = sorted(found - sent)
        sent.update(rows[:max(0, SENT - len(sent))])
        for k in range(0, len(rows), 100_000):
            part = rows[k:k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.int64()),
                                              pa.array([r[2].decode("utf-8") for r in part], pa.string())], names=["lang", "w1", "word"])
        self.clear()


def held_words(batches, own: Counter) -> Iterator[None]:
    """Fill ``own`` with the texts of batches (lang, text), by language and segment;
    a step each time that it holds FLUSH words, and at the end."""
    for b in batches:
        by: dict[str, list] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            for part in segments(texts):
                own.add(lang, b"\n".join(part))  # ends a piece
                if own.held >= FLUSH:
                    yield
    yield


def count_pass(spark: SparkSession, texts: DataFrame, levels: tuple[int, ...], filters: list, seed: int, least: int, share: float = 1) -> DataFrame:
    """(lang, k, w1.., n) of the phrases of ``texts`` (lang, text) that this pass counts
    and that occur ``least`` times; k is 0 for all words of a language. ``share``: part
    of the stored input that ``texts`` are."""
    parts = partitions_for(spark, COUNTS_RATIO * input_bytes(texts) * share, COUNTS_BYTES)
    buckets = 4 * parts

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = Counter(levels, [f.value for f in filters], seed)
        for _ in held_words(batches, own):
            for langs, lang, k, words, n in own.flush():
                yield from packed(langs, lang, k, words, n)

    def packed(langs, lang, k, words, n) -> Iterator[pa.RecordBatch]:
        """Counts as one blob for each bucket of the phrases' hashes."""
        if not len(n):
            return
        bucket = ((mix(hash_of(langs, lang, words)) >> np.uint64(20)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, rows = bucket[order], np.empty(len(n), entry(k))
        rows["lang"], rows["n"] = lang[order], n[order]
        for name, w in zip(WORDS, words):
            rows[name] = w[order]
        cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(n)]
        step = max(1, PACKED_BYTES * (len(cuts) - 1) // rows.nbytes)
        for at in range(0, len(cuts) - 1, step):
            own = cuts[at:at + step + 1]
            blobs = pa.array([rows[x:y].tobytes() for x, y in zip(own[:-1], own[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[own[:-1]].astype(np.int64)), pa.array(np.full(len(blobs), k, np.int32)),
                                              pa.array([langs] * len(blobs), pa.list_(pa.string())), blobs], names=["bucket", "k", "langs", "entries"])

    def add_up(batches) -> Iterator[pa.RecordBatch]:
        number, held = {}, {}
        for b in batches:
            for k, langs, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                rows = np.frombuffer(raw, entry(k))
                to = np.array([number.setdefault(x, len(number)) for x in langs], np.int32)
                held.setdefault(k, []).append((to[rows["lang"]], rows))
        langs = list(number)
        for k in sorted(held):
            of = held.pop(k)
            lang, rows = np.concatenate([x for x, _ in of]), np.concatenate([x for _, x in of])
            del of
            words = [np.ascontiguousarray(rows[w]) for w in WORDS[:k]]
            at, n = grouped(hash_of(langs, lang, words), [lang, *words], rows["n"].astype(np.int64))
            many = (n >= least) | (k == 0)
            at = at[many]
            yield from counted_rows(langs, lang[at], k, [w[at] for w in words], n[many])

    blobs = texts.mapInArrow(run, "bucket long, k int, langs array<string>, entries binary")
    return blobs.repartition(parts, "bucket").mapInArrow(add_up, COUNTED)


def letters_pass(spark: SparkSession, texts: DataFrame, phrases: DataFrame, seed: int, filter_bits: int) -> DataFrame:
    """(lang, w1, word) of all words of ``phrases``. Raises where two words share a hash."""
    words = phrases.select("lang", F.explode(F.slice(F.array(*WORDS), F.lit(1), F.col("k"))).alias("w1")).distinct()
    words = stored(spark, words.select("lang", F.lit(1).alias("k"), "w1", *[F.lit(0).cast("long").alias(w) for w in WORDS[1:]]), "words")
    wanted = filter_of(spark, words, bits_for(words.count(), filter_bits))

    def run(batches) -> Iterator[pa.RecordBatch]:
        own, sent = Counter((), [], seed), set()
        for _ in held_words(batches, own):
            yield from own.letters(wanted.value, sent)

    # one row per word before the join: every task sends its words. The join's key is an
    # aggregate, for the optimizer moves a semi join by grouping columns below the grouping
    found = texts.mapInArrow(run, "lang string, w1 long, word string").groupBy("lang", F.col("w1").alias("_w")).agg(
        F.min("w1").alias("w1"), F.min("word").alias("word"), F.max("word").alias("other")).drop("_w")
    found = stored(spark, found.join(words.select("lang", "w1"), ["lang", "w1"], "left_semi"), "letters")
    if not found.where("word <> other").isEmpty():
        raise HashClash
    return found.drop("other")


def filter_of(spark: SparkSession, phrases: DataFrame, bits: int):
    """A broadcast Filter with the phrases (KEY)."""
    def hashes(b: pa.RecordBatch) -> np.ndarray:
        langs, k = b.column(0).to_pylist(), b.column(1).to_numpy()
        seen = {x: lang_hash(x) for x in set(langs)}
        h = np.array([seen[x] for x in langs], np.uint64)
        for t in range(LONGEST):
            more = k > t
            h[more] = phrase_hash(h[more], b.column(2 + t).to_numpy().view(np.uint64)[more])
        return h

    return broadcast_filter(spark, phrases.select(*KEY).where("k > 0"), hashes, bits)


class HashClash(Exception):
    pass


def frequent_phrases(spark: SparkSession, docs: DataFrame, least: int = MIN_COUNT, sample: int = SAMPLE,
                     filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to LONGEST words that occur ``least`` times, exactly counted,
    as (lang, k, w1.., n), where k = 0 is all words of a language; and the letters of the
    words of phrases of two and more, as (lang, w1, word)."""
    bounded_batches(spark)
    for seed in range(8):
        try:
            return _mine(spark, docs, least, sample, filter_bits, seed)
        except HashClash:
            continue
    raise RuntimeError("words share hashes under every seed")


def _mine(spark: SparkSession, docs: DataFrame, least: int, sample: int, filter_bits: int, seed: int) -> tuple[DataFrame, DataFrame]:
    columns = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")
    texts = docs.select(*columns)
    some = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(sample)) == 0).select(*columns)
    lowered = max(2, int(SLACK * least / sample))
    proposal, known = None, []
    for k in range(1, LONGEST):
        level = stored(spark, count_pass(spark, some, (k,), known, seed, lowered, 1 / sample).where("k > 0").select(*KEY), "proposed")
        proposal = level if proposal is None else proposal.unionByName(level)
        known = [filter_of(spark, proposal, bits_for(proposal.count(), filter_bits))]
    counted = stored(spark, count_pass(spark, texts, tuple(range(1, LONGEST + 1)), known, seed, least), "counted")
    failed = counted.where(f"k between 1 and {LONGEST - 1}").join(proposal, KEY, "left_anti")
    while not failed.isEmpty():
        known = [*known, filter_of(spark, counted, bits_for(counted.count(), filter_bits))]
        more = stored(spark, count_pass(spark, texts, tuple(range(2, LONGEST + 1)), known, seed, least), "counted")
        counted, failed = counted.unionByName(more), more.where(f"k < {LONGEST}")
    return counted, letters_pass(spark, texts, counted.where("k >= 2"), seed, filter_bits)


def collocations(spark: SparkSession, docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, sample: int = SAMPLE,
                 filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of the phrases of 2 words or more that
    aren't a part of a longer one with nearly as many occurrences, each language's
    ``top`` by score (of their weakest cut), then a, then phrase."""
    found, letters = frequent_phrases(spark, docs, least, sample, filter_bits)
    parts = found.where(f"k between 1 and {LONGEST - 1}")
    many = found.where("k >= 2")
    words = F.array(*WORDS)

    def part(column: str, at: str, size: str) -> list:
        """The words of a part of each phrase, padded as in KEY."""
        return [F.when(F.lit(t) < F.col(size), F.get(words, F.col(at) + t)).otherwise(0).alias(f"{column}{t + 1}") for t in range(LONGEST)]

    def of(rows: DataFrame, prefix: str, size: str, value: str) -> DataFrame:
        """``rows`` with the count of the part whose words stand in prefix1, ..."""
        counts = parts.select(F.col("lang").alias("_lang"), F.col("k").alias("_k"), *[F.col(w).alias(f"_{w}") for w in WORDS], F.col("n").alias(value))
        on = (F.col("lang") == F.col("_lang")) & (F.col(size) == F.col("_k"))
        for t in range(LONGEST):
            on &= F.col(f"{prefix}{t + 1}") == F.col(f"_w{t + 1}")
        return rows.join(counts, on).drop("_lang", "_k", *[f"_{w}" for w in WORDS])

    cuts = many.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)"))).withColumns({"rest": F.col("k") - F.col("cut"), "zero": F.lit(0)})
    cuts = cuts.select("*", *part("x", "zero", "cut"), *part("y", "cut", "rest"))
    cuts = of(of(cuts, "x", "cut", "l"), "y", "rest", "r")
    score = F.expr("cast((cast(n as decimal(28, 0)) * 2000000BD) div (cast(l as decimal(28, 0)) + r) as bigint)")
    weakest = cuts.withColumn("score", score).groupBy(*KEY).agg(
        F.first("n").alias("n"), F.min(F.struct("score", "cut", "l", "r")).alias("weakest"))
    # phrases in a longer one: all but the longest phrase is a part
    held = many.where("k >= 3").withColumn("size", F.explode(F.expr("sequence(2, k - 1)"))).withColumn("at", F.explode(F.expr("sequence(0, k - size)")))
    inside = held.select("lang", F.col("size").alias("k"), F.col("n").alias("longer"), *part("w", "at", "size")).toDF("lang", "k", "longer", *WORDS)
    inside = inside.groupBy(*KEY).agg(F.max("longer").alias("longer"))
    kept = weakest.join(inside, KEY, "left").where(
        f"longer is null or cast(longer as decimal(28, 0)) * 100 < cast(n as decimal(28, 0)) * {INSIDE_PERCENT}").drop("longer")
    for t, w in enumerate(WORDS):
        own = letters.select(F.col("lang").alias("_lang"), F.col("w1").alias("_w"), F.col("word").alias(f"t{t}"))
        kept = kept.join(own, (F.col("lang") == F.col("_lang")) & (F.col(w) == F.col("_w")) & (F.col("k") > t), "left").drop("_lang", "_w")
    kept = kept.select("lang", F.concat_ws(" ", *[f"t{t}" for t in range(LONGEST)]).alias("phrase"), F.col("n").alias("a"),
                       F.col("weakest.l").alias("l"), F.col("weakest.r").alias("r"), F.col("weakest.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of a language's shares first, so no task holds all of a language
    share = Window.partitionBy("lang", "share").orderBy(*order)
    best = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = found.where("k = 0").select("lang", F.col("n"))
    return ranked.drop("share").join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """All phrases counted one by one; hugeint holds the products."""
    cut = " UNION ALL ".join(
        f"SELECT p.lang, p.k, p.words, p.n, {c} AS cut, x.n AS l, y.n AS r FROM f p"
        f" JOIN f x ON x.lang = p.lang AND x.words = p.words[1:{c}]"
        f" JOIN f y ON y.lang = p.lang AND y.words = p.words[{c + 1}:] WHERE p.k > {c}" for c in range(1, LONGEST))
    part = " UNION ALL ".join(
        f"SELECT lang, words[{a}:{a + s - 1}] AS words, n FROM f WHERE k >= {max(s + 1, a + s - 1)}"
        for s in range(2, LONGEST) for a in range(1, LONGEST - s + 2))
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, words[i:i + {k - 1}] AS words FROM (SELECT lang, words, unnest(range(1, len(words) - {k - 2})) AS i"
        f" FROM pieces WHERE len(words) >= {k})" for k in range(1, LONGEST + 1))
    return rf"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
               FROM documents WHERE text IS NOT NULL),
split AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM split),
total AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS ({grams}),
f AS (SELECT lang, k, words, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
cuts AS ({cut}),
scored AS (SELECT *, CAST(n AS HUGEINT) * 2000000 // (l + r) AS score FROM cuts),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1),
parts AS (SELECT lang, words, max(n) AS longer FROM ({part}) GROUP BY ALL),
kept AS (SELECT w.lang, array_to_string(w.words, ' ') AS phrase, w.n AS a, w.l, w.r, CAST(w.score AS BIGINT) AS score
         FROM weakest w LEFT JOIN parts p ON p.lang = w.lang AND p.words = w.words
         WHERE p.longer IS NULL OR 100 * CAST(p.longer AS HUGEINT) < {INSIDE_PERCENT} * CAST(w.n AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, total.n, score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}"""


SQL = _sql()
