"""Benchmark decontamination: exact count and window filters, then Smith-Waterman alignment.

A passage and an item are aligned word by word; the score is the best local
alignment over the score of the whole item, so copies with words changed, dropped
or added still score high. What can't reach the threshold is ruled out first, by
bounds that no alignment exceeds, so nothing that reaches it is missed, however
frequent its words are and however many documents hold it:

1. An alignment of m matches in r unbroken runs has r - 1 edits or more, so it
   scores at most 2m - (r - 1) = m + (m - r) + 1: the words that text and item
   share, and the pairs of neighbouring words that they share, and one. Both are
   counted (with repeats) from lists of the items that hold each word or pair, for
   a stretch of text at a time.
2. In what remains, a word of the text gains a match if the item holds it and costs
   an edit if not, and two neighbours that the item holds, but not side by side,
   cost an edit. The best sum over windows as long as an alignment of that score can
   be gives the passages to align.

The test items are the query set: they are read in blocks of bounded size, and
each block is held against all rows. No text is shuffled.

Edge cases: null and empty texts or items match nothing; equal items are each
reported; an item of one or two words is found wherever one of them stands, for
that is half of its score; letters of scripts without spaces (Chinese, Japanese,
Thai, Lao, Burmese, Khmer) are words; case and ASCII punctuation don't count; ties go to the earlier place;
null ids are reported as null; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens.llm.common import batch_rows, bounded_batches, lean
from risklens.llm.shingles import PUNCTUATION, word_hashes

MATCH, MISMATCH, GAP = 2, -1, -1
#: Part of the whole item's score from which a passage counts as a copy.
THRESHOLD = 0.5
#: Characters of test items in a block: bounds what is sent to the executors.
BLOCK_CHARS = 4 << 20
#: Passages aligned side by side.
LANES = 64
#: Words of a stretch of text, if items aren't longer, and the part of the items from
#: which a word's list is read only where the others' lists leave any item.
STRETCH = 1024
COMMON = 1 / 32
#: Place of the end of a text among the places of words (-1: a word that no item holds).
BETWEEN = -2

PAIRS = "doc_id long, item_id long, score double, start_word long, end_word long"


#: Letters of scripts that are written without spaces: each is a word.
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


def words_of(text: str | None) -> np.ndarray:
    if text and not text.isascii():
        text = UNSPACED.sub(r" \1 ", text)
    return word_hashes(text.lower(), PUNCTUATION) if text else np.empty(0, np.uint64)


def align(item: np.ndarray, passages: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment scores of ``item`` with each row of ``passages`` (padded;
    ``lengths`` are the rows' own) and the word behind its end. Within a row of
    the table, gaps along the passage are a running maximum."""
    rows, width = passages.shape
    step = np.arange(1, width + 1) * -GAP
    inside = np.arange(width) < lengths[:, None]
    last = np.zeros((rows, width + 1), np.int64)
    best, end = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for word in item:
        gain = np.where((passages == word) & inside, MATCH, MISMATCH)
        t = np.maximum(last[:, :-1] + gain, last[:, 1:] + GAP)
        np.maximum(t, 0, out=t)
        last[:, 1:] = np.maximum.accumulate(t + step, axis=1) - step
        top = last[:, 1:].max(axis=1)
        better = top > best
        if better.any():
            best[better] = top[better]
            end[better] = last[better, 1:].argmax(axis=1) + 1
    return best, end


class Postings:
    """Which of the items hold each entry of a table, and how often."""

    def __init__(self, own: list[np.ndarray], size: int):
        self.items = len(own)
        pairs = [at * self.items + k for k, at in enumerate(own)]
        pair, self.count = np.unique(np.concatenate([*pairs, np.empty(0, np.int64)]), return_counts=True)
        self.item = pair % max(self.items, 1)
        self.offset = np.searchsorted(pair // max(self.items, 1), np.arange(size + 1))
        self.common = np.diff(self.offset) > COMMON * self.items

    def shared(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For each item, how much of the entries ``at``, ``n`` times each, it shares."""
        low, held = self.offset[at], self.offset[at + 1] - self.offset[at]
        row = np.repeat(low - np.cumsum(held) + held, held) + np.arange(held.sum())
        return np.bincount(self.item[row], np.minimum(np.repeat(n, held), self.count[row]), self.items)


def places_in(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where the sorted table holds the values; -1 where it doesn't."""
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return np.where(table[at] == values, at, -1) if len(table) else np.full(len(values), -1)


def least_before(q: np.ndarray, width: int) -> np.ndarray:
    """The least of each entry and the ``width`` - 1 before it."""
    out, span = q.copy(), 1
    while span < min(width, len(q)):
        step = min(span, width - span)
        out[step:] = np.minimum(out[step:], out[:-step])
        span += step
    return out


class TestItems:
    """A block of test items: their words, and which items hold each word and pair."""

    def __init__(self, rows: list[tuple[int | None, str | None]], threshold: float = THRESHOLD):
        self.ids = [i for i, _ in rows]
        self.words = [words_of(t) for _, t in rows]
        length = np.array([len(w) for w in self.words], np.int64)
        #: least score of a copy, and words that its passage has at most
        self.need = np.maximum(np.ceil(MATCH * threshold * length - 1e-9), 1).astype(np.int64)
        self.reach = np.maximum(3 * length - self.need, 1)
        self.most = int(self.reach.max(initial=1))
        self.table = np.unique(np.concatenate([*self.words, np.empty(0, np.uint64)]))
        self.own = [places_in(self.table, w) for w in self.words]
        pairs = [at[:-1] * len(self.table) + at[1:] for at in self.own]
        self.pair_table = np.unique(np.concatenate([*pairs, np.empty(0, np.int64)]))
        self.own_pairs = [places_in(self.pair_table, p) for p in pairs]
        self.by_word, self.by_pair = Postings(self.own, len(self.table)), Postings(self.own_pairs, len(self.pair_table))
        common = self.by_word.common
        self.spared = np.array([common[at].sum() for at in self.own], np.int64)

    def candidates(self, at: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Items that a stretch of text shares enough words and pairs with."""
        word, n = np.unique(at[at >= 0], return_counts=True)
        if not len(word):
            return word
        both = self.by_pair.shared(*np.unique(pair[pair >= 0], return_counts=True))
        often = self.by_word.common[word]
        alone = self.by_word.shared(word[~often], n[~often])
        enough = lambda alone: (alone + both + 1 >= self.need) & (MATCH * alone >= self.need)
        if not enough(alone + self.spared).any():
            return word[:0]
        return np.flatnonzero(enough(alone + self.by_word.shared(word[often], n[often])))

    def windows(self, k: int, at: np.ndarray, pair: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, end) of the places of a stretch where item ``k`` may reach its least
        score; a start may lie before the text of its end."""
        held, side = np.zeros(len(self.table) + 2, bool), np.zeros(len(self.pair_table) + 1, bool)
        held[self.own[k]], side[self.own_pairs[k]] = True, True
        inside = held[at]
        cost = inside & np.r_[False, inside[:-1]] & ~side[pair]
        total = np.r_[0, np.cumsum(np.where(inside, MATCH, np.where(at == BETWEEN, -(1 << 40), -1)) - cost)]
        width = int(self.reach[k])
        best = total[1:] - least_before(total[:-1] - cost, width)  # a window's first word has no neighbour in it
        end = np.flatnonzero(best >= self.need[k]) + 1
        if len(end):
            text = np.cumsum(at == BETWEEN)[end - 1]
            cut = np.flatnonzero((np.diff(end) > width) | (np.diff(text) > 0))
            for first, last in zip(end[np.r_[0, cut + 1]].tolist(), end[np.r_[cut, len(end) - 1]].tolist()):
                yield max(first - width, 0), last

    def passages(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(item, text, start, end) of the places to align; places of an item that overlap
        are one. The texts' words are laid end to end, so short ones share a stretch."""
        begin = np.cumsum([0] + [len(w) + 1 for w in texts])
        at = np.full(begin[-1], BETWEEN)
        at[np.delete(np.arange(len(at)), begin[1:] - 1)] = places_in(self.table, np.concatenate([*texts, np.empty(0, np.uint64)]))
        if not (at >= 0).any():
            return
        pair = np.full(len(at), -1)
        next_to = np.flatnonzero((at[1:] >= 0) & (at[:-1] >= 0))
        pair[next_to + 1] = places_in(self.pair_table, at[next_to] * len(self.table) + at[next_to + 1])
        size, found = max(STRETCH, 4 * self.most), []
        for lo in range(0, max(len(at) - self.most, 1), size - self.most):
            here, sides = at[lo:lo + size], pair[lo:lo + size]
            for k in self.candidates(here, sides).tolist():
                for a, b in self.windows(k, here, sides):
                    d = int(np.searchsorted(begin, lo + b - 1, "right")) - 1
                    found.append((k, d, max(lo + a - int(begin[d]), 0), lo + b - int(begin[d])))
        found.sort()
        for j, (k, d, a, b) in enumerate(found):
            if j + 1 < len(found) and found[j + 1][:2] == (k, d) and found[j + 1][2] <= b:
                found[j + 1] = (k, d, a, max(b, found[j + 1][3]))
                continue
            yield k, d, a, b

    def matches(self, texts: list[str | None], threshold: float) -> list[list[tuple]]:
        """For every text its (item_id, score, start_word, end_word), best place of each item.
        ``threshold``: not below the one that the block was made with."""
        todo: dict[int, list] = {}
        words = [words_of(t) for t in texts]
        for k, d, a, b in self.passages(words):
            todo.setdefault(k, []).append((d, a, words[d][a:b]))
        out: list[dict] = [{} for _ in texts]
        for k, places in todo.items():
            item = self.words[k]
            places.sort(key=lambda p: len(p[2]))
            for at in range(0, len(places), LANES):
                part = places[at:at + LANES]
                best, end = align(item, *padded([w for _, _, w in part]))
                score = best / (MATCH * len(item))
                good = np.flatnonzero(score >= threshold).tolist()
                if not good:
                    continue
                # the same alignments, backwards from their ends, give their starts
                back = align(item[::-1], *padded([part[r][2][:end[r]][::-1] for r in good]))[1]
                for r, e in zip(good, back.tolist()):
                    d, stop = part[r][0], part[r][1] + int(end[r])
                    s, a, known = float(score[r]), stop - e, out[d].get(k)
                    if known is None or (-s, a) < (-known[1], known[2]):
                        out[d][k] = (self.ids[k], s, a, stop)
        return [[found[k] for k in sorted(found)] for found in out]


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rows as a table, and their lengths."""
    lengths = np.array([len(w) for w in rows])
    table = np.zeros((len(rows), lengths.max()), np.uint64)
    for r, w in enumerate(rows):
        table[r, :len(w)] = w
    return table, lengths


def item_blocks(items: DataFrame) -> Iterator[list]:
    """The test items in blocks of about BLOCK_CHARS characters."""
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + int(chars // BLOCK_CHARS)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # bounded by BLOCK_CHARS
        yield sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def prepared_blocks(spark: SparkSession, items: DataFrame, threshold: float) -> Iterator:
    """Broadcasts of TestItems."""
    bounded_batches(spark)
    for rows in item_blocks(items):
        yield spark.sparkContext.broadcast(TestItems(rows, threshold))


def find_copies(spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word) of the documents that hold a
    copy of a test item, one row for each such pair."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())])
    out = None
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    for shared in prepared_blocks(spark, items, threshold):
        def run(batches, shared=shared) -> Iterator[dict]:
            for b in batches:
                found = [(i, *m) for i, ms in zip(b.column(0).to_pylist(), shared.value.matches(b.column(1).to_pylist(), threshold)) for m in ms]
                yield dict(zip(schema.names, zip(*found))) if found else {c: [] for c in schema.names}

        part = rows.mapInArrow(batch_rows(run, schema), PAIRS)
        out = part if out is None else out.unionByName(part)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return find_copies(spark, read("documents"), read("benchmark"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a copy of a test item stay, as they are."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out, at = docs, docs.columns.index("text")
    for shared in prepared_blocks(spark, items, THRESHOLD):
        def run(batches, shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = [not m for m in shared.value.matches(b.column(at).to_pylist(), THRESHOLD)]
                yield b.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(lean(run), docs.schema)
    return out
