"""SentencePiece (merge type) encoding by a prefix table, and decoding.

For every prefix of a text the encoding is unique, so its last token is too.
An automaton over the vocabulary lists the pieces that end at a position; of
them exactly one is compatible with the last token of the prefix before it,
that is, the two pieces, joined and merged alone, come out as these two. The
table of last tokens is filled left to right in linear time and the ids are
read from it backwards. (Why that suffices: the first merge across a token
border in the whole text would also be made in the two pieces alone.)

No piece of a vocabulary has a space mark after another character (checked
when the model is loaded; otherwise texts aren't cut), so texts are cut before
runs of space marks and the tables of short segments are kept for reuse.

Edge cases: a null text counts as empty and gives begin and end ids only;
characters without a piece become byte pieces; a space mark in a text decodes
to a space, as in the library. Texts of any length take linear time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens.llm.common import batch_rows, bounded_batches

MARK = "▁"
#: Entries after which a worker's memory of segments, and that of pairs, starts anew,
#: and the longest segment that is kept.
MEMO = 300_000
PAIRS = 1_000_000
MEMO_CHARS = 48


class PieceCodec:
    """Encoder and decoder of one model file's bytes."""

    def __init__(self, model: bytes):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.byte_of, self.piece_of, self.score = {}, {}, {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_of[i] = int(piece[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.piece_of[i] = piece
                self.score[piece] = sp.get_score(i)
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.id_of = {p: i for i, p in self.piece_of.items()}
        self.text_of = {i: p.replace(MARK, " ") for i, p in self.piece_of.items()}
        self.size, self.length_of = n, {i: len(p) for i, p in self.piece_of.items()}
        self.automaton = ahocorasick.Automaton()
        for i, piece in self.piece_of.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        inner = re.compile(f"[^{MARK}]{MARK}")
        cut = not any(inner.search(p) for p in self.id_of)
        self.segments = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if cut else "(?s).+").findall
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}  # ids of segments that decode to themselves
        self.packed: tuple[np.ndarray, np.ndarray] | None = None  # pairs between tasks
        self.odd: dict[str, tuple[bytes, str]] = {}  # ids and text of the others

    def merged(self, text: str) -> list[str]:
        """Merge a short text by its definition: best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, piece_id: int) -> bool:
        """Do the two pieces stay apart and whole? ``left`` -1: a text's start or
        a character that no piece has, which never merges."""
        b = self.piece_of[piece_id]
        if left < 0:
            known = len(self.merged(b)) == 1
        else:
            a = self.piece_of[left]
            known = self.merged(a + b) == [a, b]
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        self.pairs[(left + 1) * self.size + piece_id] = known
        return known

    def segment_ids(self, seg: str) -> list[int]:
        n, size, pairs = len(seg), self.size, self.pairs
        last = [0] * (n + 1)  # the last id of each prefix, plus 1; 0: no piece has this character
        for at, (pid, length) in self.automaton.iter(seg):
            end = at + 1
            if not last[end]:
                before = last[end - length]
                ok = pairs.get(before * size + pid)
                if ok is None:
                    ok = self.compatible(before - 1, pid)
                if ok:
                    last[end] = pid + 1
        out: list[int] = []
        while n:
            pid = last[n] - 1
            if pid >= 0:
                out.append(pid)
                n -= self.length_of[pid]
            else:
                n -= 1
                raw = seg[n].encode("utf-8")
                out.extend(self.byte_id.get(b, self.unknown) for b in reversed(raw)) if self.byte_id else out.append(self.unknown)
        return out[::-1]

    def _segment(self, seg: str, odd: dict[str, str]) -> bytes:
        """Ids of a segment; ``odd`` gets what it decodes to, if that isn't its own text."""
        got = self.odd.get(seg)
        if got is None:
            ids = self.segment_ids(seg)
            got = np.array(ids, dtype="<u4").tobytes(), self.join_pieces(ids)
            plain = got[1] == seg.replace(MARK, " ")
            if len(seg) <= MEMO_CHARS:
                kept = self.memo if plain else self.odd
                if len(kept) > MEMO:
                    kept.clear()
                kept[seg] = got[0] if plain else got
            if plain:
                return got[0]
        odd[seg] = got[1]
        return got[0]

    def rest(self) -> None:
        """For the time between tasks, when a worker idles beside those of other stages: segments
        go (a task's input fills them anew) and pairs are packed, so no small object of
        either is left and their memory is given back."""
        if self.pairs:
            self.packed = np.fromiter(self.pairs, np.int64, len(self.pairs)), np.fromiter(self.pairs.values(), np.bool_, len(self.pairs))
        for kept in (self.memo, self.odd, self.pairs):
            kept.clear()

    def wake(self) -> None:
        """Unpack the pairs that ``rest`` packed."""
        if self.packed is not None:
            self.pairs.update(zip(*(a.tolist() for a in self.packed)))
            self.packed = None

    def join_pieces(self, ids) -> str:
        """Texts of pieces; runs of byte pieces are read as UTF-8."""
        try:
            return "".join([self.text_of[i] for i in ids])
        except KeyError:
            out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i in self.piece_of:
                out.append(self.text_of[i])
            elif i == self.unknown:
                out.append(" ⁇ ")
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids) -> str:
        text = self.join_pieces(ids)
        return text[1:] if text.startswith(" ") else text

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_both(text)[0], "<u4").tolist()

    def encode_both(self, text: str) -> tuple[bytes, str]:
        """Little-endian ids with begin and end, and the text their ids decode to.
        Byte runs end with their segment (the next begins with a space mark), so
        decoded segments join to what the whole ids decode to."""
        edge = np.array([self.begin, self.end], dtype="<u4")
        if not text:
            return edge.tobytes(), ""
        known, odd = self.memo.get, {}
        marked = MARK + text.replace(" ", MARK)
        segments = self.segments(marked)
        parts = [known(s) or self._segment(s, odd) for s in segments]
        if odd:
            decoded = "".join([odd[s] if s in odd else s.replace(MARK, " ") for s in segments])
        else:
            decoded = marked.replace(MARK, " ")
        return edge[:1].tobytes() + b"".join(parts) + edge[1:].tobytes(), decoded[1:] if decoded.startswith(" ") else decoded


_CODECS: dict[str, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """One codec per worker process and model."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = PieceCodec(model)
    return _CODECS[key]


def encode_documents(spark: SparkSession, docs: DataFrame, model_path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``
    (and with ``keep_ids`` the ids themselves)."""
    bounded_batches(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())  # a vocabulary file: its size doesn't follow the data
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
                       + ([("ids", pa.list_(pa.int32()))] if keep_ids else []))

    def run(batches) -> Iterator[dict]:
        own = codec(model.value)
        own.wake()
        try:
            yield from columns(own, batches)
        finally:
            own.rest()

    def columns(own: PieceCodec, batches) -> Iterator[dict]:
        for b in batches:
            rows = [own.encode_both(t or "") for t in b.column(1).to_pylist()]
            cols = {"doc_id": b.column(0), "n_tokens": [len(i) // 4 for i, _ in rows],
                    "ids_sha256": [hashlib.sha256(i).hexdigest() for i, _ in rows],
                    "decoded_sha256": [hashlib.sha256(t.encode("utf-8")).hexdigest() for _, t in rows]}
            if keep_ids:
                flat = np.frombuffer(b"".join([i for i, _ in rows]), "<u4").astype(np.int32)
                ends = np.cumsum([0] + [len(i) // 4 for i, _ in rows], dtype=np.int32)
                cols |= {"ids": pa.ListArray.from_arrays(ends, flat)}
            yield cols

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batch_rows(run, schema), ddl)


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents as ids, with the digests of ids and decoded text."""
    return encode_documents(spark, docs, default_model(), keep_ids=True)
