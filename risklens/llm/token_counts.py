"""Token counts by the whole-token shortcut (byte-level merges).

Offline, on the driver, every vocabulary string is merged alone; those that
come out as one token are proven whole. On the executors a text is cut into
pre-tokens; one that is a proven string counts 1 without any merging, and only
the rest is merged (and remembered for a while, in bounded memory).

Edge cases: a null text counts as empty (0 bytes, 0 tokens); an added special
string in a text is one token, as the library does by default, and cuts the
text; long runs without a cut merge in n log n time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens.llm.common import batch_rows, bounded_batches

#: Fixed value: the pre-token pattern of this family of vocabularies, with
#: white space as Unicode defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Remembered pre-tokens beyond the proven ones.
MEMO = 500_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: bytes that print stand
    for themselves, the others for the code points from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(shifted)) for b in range(256)]


class TokenCounter(dict):
    """Pre-token -> number of tokens. ``proven``: ids known to be whole tokens."""

    def __init__(self, vocabulary: bytes, proven: frozenset[int] | None = None):
        import regex
        spec = json.loads(vocabulary)
        self.letters = byte_letters()
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(spec["model"]["merges"])}
        vocab = spec["model"]["vocab"]
        self.proven = frozenset(i for s, i in vocab.items() if len(self.merge(list(s))) == 1) if proven is None else proven
        byte_of = {c: b for b, c in enumerate(self.letters)}
        self.whole = {}
        for s, i in vocab.items():
            if i in self.proven and all(c in byte_of for c in s):
                try:
                    self.whole[bytes(byte_of[c] for c in s).decode("utf-8")] = 1
                except UnicodeDecodeError:
                    pass  # part of a character: never a whole pre-token of a text
        special = [t["content"] for t in spec.get("added_tokens") or []]
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.find = regex.compile(PATTERN).findall
        super().__init__(self.whole)

    def merge(self, parts: list[str]) -> list[str]:
        """Merge by rank, ties leftmost."""
        if len(parts) > 40:
            return self.merge_long(parts)
        none = len(self.rank)
        rank = self.rank.get
        near = [rank(p, none) for p in zip(parts, parts[1:])]
        while near and (least := min(near)) < none:
            k = near.index(least)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del near[k]
            if k:
                near[k - 1] = rank((parts[k - 1], parts[k]), none)
            if k < len(near):
                near[k] = rank((parts[k], parts[k + 1]), none)
        return parts

    def merge_long(self, parts: list[str]) -> list[str]:
        """The same in n log n: a heap over a linked list."""
        n = len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []
        rank = self.rank.get

        def push(k: int) -> None:
            if k >= 0 and after[k] < n and (r := rank((parts[k], parts[after[k]]))) is not None:
                heapq.heappush(heap, (r, k, parts[k], parts[after[k]]))

        for k in range(n - 1):
            push(k)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k] if alive[k] else n
            if j >= n or parts[k] != a or parts[j] != b:
                continue
            parts[k], alive[j], after[k] = a + b, False, after[j]
            if after[j] < n:
                before[after[j]] = k
            push(before[k])
            push(k)
        return [p for p, ok in zip(parts, alive) if ok]

    def __missing__(self, token: str) -> int:
        n = len(self.merge([self.letters[b] for b in token.encode("utf-8")]))
        if len(token) <= 64:
            if len(self) > len(self.whole) + MEMO:
                self.clear()
                self.update(self.whole)
            self[token] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.cut is None:
            return sum(map(self.__getitem__, self.find(text)))
        pieces = self.cut.split(text)
        return len(pieces) - 1 + sum(sum(map(self.__getitem__, self.find(p))) for p in pieces)


_COUNTERS: dict[str, TokenCounter] = {}


def counter(vocabulary: bytes, proven: frozenset[int]) -> TokenCounter:
    key = hashlib.sha256(vocabulary).hexdigest()
    if key not in _COUNTERS:
        _COUNTERS[key] = TokenCounter(vocabulary, proven)
    return _COUNTERS[key]


def count_tokens(spark: SparkSession, docs: DataFrame, vocabulary_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``."""
    bounded_batches(spark)
    with open(vocabulary_path, "rb") as f:
        raw = f.read()
    # both are as large as the vocabulary, whatever the data
    shared = spark.sparkContext.broadcast((raw, TokenCounter(raw).proven))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches) -> Iterator[dict]:
        own = counter(*shared.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [own.count(t) for t in texts]
            yield {"doc_id": b.column(0), "n_bytes": [len(t.encode("utf-8")) for t in texts],
                   "n_tokens": n, "over_limit": [k > limit for k in n]}

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        batch_rows(run, schema), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
