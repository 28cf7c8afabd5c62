"""Language identification with a bidirectional gated recurrent network over bytes.

A forward and a backward recurrent layer read a window of bytes; at every
position both states give a distribution over the languages. A document's
probabilities are the mean over all its positions (the bytes of letters weigh
1, the others 0), so every byte of a text of any length counts. The network is
trained in numpy by backpropagation through time on a bounded sample of
labelled rows; prediction runs window by window inside Spark tasks.

Edge cases: a null or empty text, or one without a letter, is ``und`` with
score 0; windows shorter than the network's are padded with byte 0; an empty
table or one without labelled rows trains nothing and predicts ``und``;
null ids count as the text ``null`` for the split and stay null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens.llm.common import batch_rows, bounded_batches, lean

#: Documented bound of the training sample: rows per language and characters of each.
SAMPLE_ROWS = 400
SAMPLE_CHARS = 600
HIDDEN = 12
WINDOW = 64
#: Windows that are stepped through together; keeps the state in the CPU's cache.
LANES = 1024
STEPS = 300
TRAIN_LANES = 160
HELD_OUT_REMAINDER = 2
UNKNOWN = "und"
#: The pipeline rejects documents whose best language has less of the positions.
MIN_SCORE = 0.35


def letter_weights() -> np.ndarray:
    """1 for bytes of ASCII letters and of multi-byte characters, else 0."""
    w = np.zeros(256, np.float32)
    w[ord("a"):ord("z") + 1] = 1
    w[ord("A"):ord("Z") + 1] = 1
    w[0x80:] = 1
    return w


class Direction:
    """One recurrent layer: input table (3H, 256), recurrent weights (3H, H).
    Rows are update gate, reset gate, candidate; states are (H, lanes)."""

    def __init__(self, table: np.ndarray, recur: np.ndarray):
        self.table, self.recur, self.h = table, recur, recur.shape[1]

    @classmethod
    def fresh(cls, rng: np.random.Generator, hidden: int) -> Direction:
        table = rng.normal(0, 0.4, (3 * hidden, 256)).astype(np.float32)
        recur = (rng.normal(0, 1, (3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)
        return cls(table, recur)

    def step(self, state: np.ndarray, x: np.ndarray) -> tuple:
        """New state and what the backward pass needs. Gates are logistic: half
        the hyperbolic tangent of half the input, plus a half."""
        h = self.h
        g, a = np.take(self.table, x, axis=1), self.recur @ state
        s = g[:2 * h]
        s += a[:2 * h]
        s *= 0.5
        np.tanh(s, out=s)
        s *= 0.5
        s += 0.5
        n = s[h:] * a[2 * h:]
        n += g[2 * h:]
        np.tanh(n, out=n)
        new = state - n
        new *= s[:h]
        new += n
        return new, (state, s, n, a[2 * h:])

    def back(self, grad: np.ndarray, kept: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients: of the state before, of the summed inputs (for the table),
        of the recurrent products (for the recurrent weights)."""
        state, s, n, an = kept
        h = self.h
        z, r = s[:h], s[h:]
        dn = grad * (1 - z) * (1 - n * n)
        dz = grad * (state - n) * z * (1 - z)
        dr = dn * an * r * (1 - r)
        d_in = np.concatenate([dz, dr, dn])
        d_rec = np.concatenate([dz, dr, dn * r])
        return grad * z + self.recur.T @ d_rec, d_in, d_rec


class ByteNet:
    def __init__(self, forward: Direction, backward: Direction, out: np.ndarray, bias: np.ndarray, langs: list[str]):
        self.forward, self.backward, self.out, self.bias, self.langs = forward, backward, out, bias, langs

    @classmethod
    def fresh(cls, langs: list[str], hidden: int, seed: int) -> ByteNet:
        rng = np.random.default_rng(seed)
        return cls(Direction.fresh(rng, hidden), Direction.fresh(rng, hidden),
                   rng.normal(0, 0.3, (len(langs), 2 * hidden)).astype(np.float32), np.zeros((len(langs), 1), np.float32), langs)

    def weights(self) -> list[np.ndarray]:
        return [self.forward.table, self.forward.recur, self.backward.table, self.backward.recur, self.out, self.bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over all positions of windows ``x`` (T, lanes) and
        its gradients, by backpropagation through time in both directions."""
        steps, lanes = x.shape
        h = self.forward.h
        zero = np.zeros((h, lanes), np.float32)
        fwd, bwd, keep_f, keep_b = [None] * steps, [None] * steps, [None] * steps, [None] * steps
        state = zero
        for t in range(steps):
            state, keep_f[t] = self.forward.step(state, x[t])
            fwd[t] = state
        state = zero
        for t in reversed(range(steps)):
            state, keep_b[t] = self.backward.step(state, x[t])
            bwd[t] = state
        loss, count = 0.0, steps * lanes
        target = (np.arange(len(self.langs))[:, None] == y).astype(np.float32)
        grads = [np.zeros_like(w) for w in self.weights()]
        d_f, d_b = [None] * steps, [None] * steps
        for t in range(steps):
            both = np.concatenate([fwd[t], bwd[t]])
            p = softmax(self.out @ both + self.bias)
            loss -= float(np.log(np.maximum((p * target).sum(axis=0), 1e-9)).sum())
            d = (p - target) / count
            grads[4] += d @ both.T
            grads[5] += d.sum(axis=1, keepdims=True)
            back = self.out.T @ d
            d_f[t], d_b[t] = back[:h], back[h:]
        for layer, kept, d_out, order, k in ((self.forward, keep_f, d_f, range(steps - 1, -1, -1), 0),
                                             (self.backward, keep_b, d_b, range(steps), 2)):
            flow = zero
            for t in order:
                flow, d_in, d_rec = layer.back(flow + d_out[t], kept[t])
                np.add.at(grads[k].T, x[t], d_in.T)
                grads[k + 1] += d_rec @ kept[t][0].T
        return loss / count, grads

    def position_probabilities(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(t, distribution (languages, lanes)) of each position of windows (T, lanes)."""
        steps, lanes = x.shape
        h = self.forward.h
        state = np.zeros((h, lanes), np.float32)
        left = self.out[:, :h], self.out[:, h:]
        scores = np.empty((steps, len(self.langs), lanes), np.float32)
        for t in range(steps):
            state, _ = self.forward.step(state, x[t])
            np.matmul(left[0], state, out=scores[t])
        state = np.zeros((h, lanes), np.float32)
        for t in reversed(range(steps)):
            state, _ = self.backward.step(state, x[t])
            yield t, softmax(scores[t] + left[1] @ state + self.bias)


def softmax(a: np.ndarray) -> np.ndarray:
    a -= a.max(axis=0)
    np.exp(a, out=a)
    a /= a.sum(axis=0)
    return a


def train(samples: list[tuple[bytes, str]], hidden: int = HIDDEN, steps: int = STEPS, lanes: int = TRAIN_LANES, seed: int = 7) -> ByteNet | None:
    """Fit on (text bytes, language) pairs; balanced over languages, adaptive step sizes."""
    langs = sorted({lang for _, lang in samples})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    pools = []
    for lang in langs:
        parts = [np.frombuffer(b, np.uint8) for b, k in samples if k == lang and b]
        pools.append(np.concatenate([*parts, np.zeros(WINDOW, np.uint8)]))
    net = ByteNet.fresh(langs, hidden, seed)
    weights = net.weights()
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for k in range(1, steps + 1):
        y = rng.integers(0, len(langs), lanes)
        rows = []
        for c in y:
            at = rng.integers(0, len(pools[c]) - WINDOW + 1)
            rows.append(pools[c][at:at + WINDOW])
        x = np.stack(rows, axis=1)
        x = x[:int(rng.integers(WINDOW // 3, WINDOW + 1))]
        _, grads = net.gradients(x, y)
        rate = 0.02 * min(1.0, k / 20) * (1 - 0.9 * k / steps)
        for w, g, m, v in zip(weights, grads, mean, square):
            np.clip(g, -0.5, 0.5, out=g)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    return net


def window_blocks(texts: list[str] | list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows, their texts' numbers), LANES at a time; only the block at hand and the text
    that it ends in are held beside the texts."""
    rows, owner, held = [], [], 0
    for d, text in enumerate(texts):
        raw = text.encode("utf-8") if isinstance(text, str) else text
        n = -(-len(raw) // WINDOW)
        if n:
            padded = np.zeros(n * WINDOW, np.uint8)
            padded[:len(raw)] = np.frombuffer(raw, np.uint8)
            rows.append(padded.reshape(n, WINDOW))
            owner.append(np.full(n, d))
            held += n
        if held >= LANES:
            windows, own = np.concatenate(rows), np.concatenate(owner)
            full = held - held % LANES
            for k in range(0, full, LANES):
                yield windows[k:k + LANES], own[k:k + LANES]
            rows, owner, held = [windows[full:].copy()], [own[full:].copy()], held - full
    if held:
        yield np.concatenate(rows), np.concatenate(owner)


def document_probabilities(net: ByteNet, texts: list[str] | list[bytes]) -> np.ndarray:
    """(documents, languages): mean of the position probabilities over the bytes
    of letters. Windows of all texts are stepped through side by side."""
    weight = letter_weights()
    total = np.zeros((len(texts), len(net.langs)))
    mass = np.zeros(len(texts))
    for windows, own in window_blocks(texts):
        x = np.ascontiguousarray(windows.T)
        w = weight[x]
        pooled = np.zeros((len(net.langs), x.shape[1]), np.float32)
        for t, p in net.position_probabilities(x):
            p *= w[t]
            pooled += p
        for c in range(len(net.langs)):
            total[:, c] += np.bincount(own, pooled[c], len(texts))
        mass += np.bincount(own, w.sum(axis=0), len(texts))
    return total / np.maximum(mass, 1)[:, None]


def held_out(doc_id) -> bool:
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % 4 == HELD_OUT_REMAINDER


def training_sample(docs: DataFrame) -> list[tuple[bytes, str]]:
    """At most about SAMPLE_ROWS rows of each language, none held out, with at
    most SAMPLE_CHARS characters each from a place that a hash picks. The share
    of rows that a hash lets through follows from each language's row count."""
    open_rows = docs.where((F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % 4 != HELD_OUT_REMAINDER)
                           & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in open_rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not counts:
        return []
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(SAMPLE_ROWS / n)).otherwise(share)
    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    start = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(13)), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1)).cast("long")) + 1
    picked = open_rows.where(unit < share).where(F.col("text").isNotNull()).select(
        "lang", F.substring(F.col("text"), start.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
    rows = picked.limit(2 * SAMPLE_ROWS * len(counts)).collect()
    return sorted((r["text"].encode("utf-8"), r["lang"]) for r in rows)


def label(net: ByteNet | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    known = np.array([net is not None and bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    at = np.flatnonzero(known)
    if len(at):
        p = document_probabilities(net, [texts[i] for i in at])
        for i, row in zip(at.tolist(), p):
            lang[i], score[i] = net.langs[int(row.argmax())], min(1.0, float(row.max()))
    return lang, score


def predict(spark: SparkSession, docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(net)  # a few thousand weights
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches) -> Iterator[dict]:
        for b in batches:
            ids = b.column(0).to_pylist()
            lang, score = label(shared.value, b.column(1).to_pylist())
            yield {"doc_id": ids, "held_out": [held_out(i) for i in ids], "lang_pred": lang, "score": score}

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        batch_rows(run, schema), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return predict(spark, docs, train(training_sample(docs)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in a known language stay, as they are; those
    without letters or with a score under MIN_SCORE go."""
    bounded_batches(spark)
    shared, at = spark.sparkContext.broadcast(train(training_sample(docs))), docs.columns.index("text")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = label(shared.value, b.column(at).to_pylist())
            yield b.filter(pa.array([k != UNKNOWN and s >= MIN_SCORE for k, s in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
