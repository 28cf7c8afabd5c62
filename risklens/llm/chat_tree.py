"""Chat formatting as a prefix tree of conversations.

Conversations that begin with the same turns share these turns' tokens (code
points here). Every distinct prefix is a node; a node belongs to the chain of
the least conversation through it, so a chain is the part of a conversation
that no lesser one has. Written depth-first, a chain is one run of the packed
stream, followed by the chains that leave it, deepest first. So each node gets

* its place in the stream, where shared tokens stand once;
* position ids that count from its conversation's start (``pos``);
* attention intervals: itself, its chain up to it, and the runs of the chains
  above it up to where its own left them (``ancestors``, one interval a chain).

A turn is rendered as a start mark, the role, a newline, the text, an end mark
and a newline. Control strings in roles and texts are broken by a backslash
after their first character and backslashes are doubled, which is reversible.
The loss mask covers the texts of assistant turns.

Edge cases: null texts and roles count as empty; turns go by (turn, role, text),
so repeated rows keep a defined order and all count; rows without a
conversation id form one conversation, returned with a null id (the least long
stands for it inside); equal conversations share all nodes; empty tables give
empty results; other columns are ignored. Long conversations stream through
their task row by row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens.llm.common import batch_rows, bounded_batches, input_bytes, partitions_for, stored

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that must not occur in a rendered text: the template's own marks and
#: those of other common templates.
CONTROL = (START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
LOSS_ROLE = "assistant"
NO_CONVERSATION = -(1 << 63)

_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_TURN = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n(.*)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as written, and the loss mask's interval in it (0, 0: none)."""
    head = START + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    return head + body + END + "\n", *((len(head), len(head) + len(body)) if role == LOSS_ROLE else (0, 0))


def parse(turn: str) -> tuple[str, str]:
    m = _TURN.fullmatch(turn)
    if not m:
        raise ValueError("not a rendered turn")
    return unescape(m[1]), unescape(m[2])


CHAIN = pa.schema([("conv", pa.int64()), ("idx", pa.int64()), ("node", pa.binary()), ("pos", pa.int64()), ("chars", pa.int64()),
                   ("rendered", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64())])
CHAIN_DDL = "conv long, idx long, node binary, pos long, chars long, rendered string, loss_from long, loss_to long"


def _chain(batches) -> Iterator[dict]:
    """Rendered turns in order, each with the name of its prefix and its position."""
    conv, node, idx, pos = None, b"", 0, 0
    for b in batches:
        rows = []
        for c, role, text in zip(*(b.column(k).to_pylist() for k in (0, 2, 3))):
            if c != conv:
                conv, node, idx, pos = c, b"", 0, 0
            rendered, lo, hi = render(role, text)
            node = hashlib.blake2b(node + rendered.encode("utf-8"), digest_size=16).digest()
            rows.append((conv, idx, node, pos, len(rendered), rendered, lo, hi))
            idx, pos = idx + 1, pos + len(rendered)
        yield dict(zip(CHAIN.names, zip(*rows))) if rows else {c: [] for c in CHAIN.names}


def _running(batches) -> Iterator[dict]:
    """Sums within the partition; its number tells the partitions' rows apart."""
    from pyspark import TaskContext
    part, total = TaskContext.get().partitionId(), 0
    for b in batches:
        ids, sizes, before = b.column(0), b.column(1).to_pylist(), []
        for n in sizes:
            before.append(total)
            total += n
        yield {"rep": ids, "size": sizes, "part": [part] * len(sizes), "before": before}


def chain_starts(spark: SparkSession, chains: DataFrame, parts: int) -> DataFrame:
    """(rep, start): place in the stream of each chain (rep, size, order)."""
    schema = pa.schema([("rep", pa.int64()), ("size", pa.int64()), ("part", pa.int64()), ("before", pa.int64())])
    local = stored(spark, chains.repartitionByRange(parts, "order").sortWithinPartitions("order").select("rep", "size")
                   .mapInArrow(batch_rows(_running, schema), "rep long, size long, part long, before long"), "runs")
    offsets, total = [], 0
    for r in local.groupBy("part").agg(F.sum("size").alias("n")).orderBy("part").collect():  # a row for each partition
        offsets.append((r["part"], total))
        total += r["n"]
    offset = spark.createDataFrame(offsets, "part long, offset long")
    return local.join(F.broadcast(offset), "part").select("rep", (F.col("before") + F.col("offset")).alias("start"))


def pack(spark: SparkSession, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, turns). ``nodes``, the packed stream in order: node, rep, idx, start,
    pos, chars, rendered, loss_from, loss_to, ancestors (start, end). ``turns``:
    conv, idx, node, of every turn."""
    bounded_batches(spark)
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_CONVERSATION)).alias("conv"), "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parts = partitions_for(spark, 4 * input_bytes(conversations))
    chained = stored(spark, rows.repartition(parts, "conv").sortWithinPartitions("conv", "turn", "role", "text")
                     .mapInArrow(batch_rows(_chain, CHAIN), CHAIN_DDL), "chained")
    reps = chained.groupBy("node").agg(F.min("conv").alias("rep"))
    turns = stored(spark, chained.select("conv", "idx", "node", "pos", "chars").join(reps, "node"), "turns")
    # a conversation's path as runs of chains: where it enters each and leaves it
    runs = turns.groupBy("conv", "rep").agg(F.min("idx").alias("idx"), F.min("pos").alias("lo"), F.max(F.col("pos") + F.col("chars")).alias("hi"))
    owners = turns.where("conv = rep").select("conv").distinct()
    paths = runs.join(owners, "conv", "left_semi")
    order = paths.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("idx", "rep"))).alias("path")).select(
        F.col("conv").alias("rep"), F.transform("path", lambda p: F.struct((-p["idx"]).alias("depth"), p["rep"].alias("rep"))).alias("order"))
    own = turns.where("conv = rep").groupBy("rep").agg(F.sum("chars").alias("size"), F.min("pos").alias("first"))
    starts = stored(spark, chain_starts(spark, own.join(order, "rep"), parts).join(own, "rep"), "starts")
    above = paths.where("conv <> rep").join(starts.select("rep", "start"), "rep").groupBy(F.col("conv").alias("rep")).agg(
        F.sort_array(F.collect_list(F.struct("lo", F.col("start").alias("from"), (F.col("start") + F.col("hi") - F.col("lo")).alias("to")))).alias("above"))
    heads = starts.join(above, "rep", "left").select("rep", F.col("start").alias("chain_start"), "first", F.coalesce(
        F.transform("above", lambda a: F.struct(a["from"].alias("start"), a["to"].alias("end"))), F.array()).alias("above"))
    unique = turns.where("conv = rep").select("conv", "idx").join(chained, ["conv", "idx"])
    start = F.col("chain_start") + F.col("pos") - F.col("first")
    nodes = unique.withColumnRenamed("conv", "rep").join(heads, "rep").withColumn("start", start).withColumn(
        "ancestors", F.when(F.col("start") > F.col("chain_start"), F.concat(
            "above", F.array(F.struct(F.col("chain_start").alias("start"), F.col("start").alias("end"))))).otherwise(F.col("above")))
    nodes = nodes.select("node", "rep", "idx", "start", "pos", "chars", "rendered", "loss_from", "loss_to", "ancestors")
    return stored(spark, nodes.repartitionByRange(parts, "start").sortWithinPartitions("start"), "packed"), turns.select("conv", "idx", "node")


BACK = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                  ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read_back(batches) -> Iterator[dict]:
    conv, state, out = None, None, []

    def closed() -> tuple:
        n, all_text, loss_chars, loss, chars = state
        return (None if conv == NO_CONVERSATION else conv, n, all_text.hexdigest(), loss_chars, loss.hexdigest(), chars)

    for b in batches:
        for c, rendered, lo, hi in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4))):
            if c != conv:
                if state:
                    out.append(closed())
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse(rendered)
            under = unescape(rendered[lo:hi])
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[2] += len(under)
            state[3].update(under.encode("utf-8"))
            state[4] += len(rendered)
        if out:
            yield dict(zip(BACK.names, zip(*out)))
            out = []
    if state:
        yield dict(zip(BACK.names, zip(*[closed()])))


def read_back(spark: SparkSession, nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """Every conversation, put together again from the packed stream."""
    rows = turns.join(nodes.select("node", "rendered", "loss_from", "loss_to"), "node").select("conv", "idx", "rendered", "loss_from", "loss_to")
    parts = partitions_for(spark, 4 * input_bytes(nodes))
    return rows.repartition(parts, "conv").sortWithinPartitions("conv", "idx").mapInArrow(
        batch_rows(_read_back, BACK), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return read_back(spark, *pack(spark, given.unionByName(extra)))


#: formatted_chars counts the template's escapes, which are simple replacements.
_ESC = "replace(coalesce(text, ''), chr(92), chr(92) || chr(92))"
for _c in CONTROL:
    _ESC = f"replace({_ESC}, '{_c}', '{_c[0]}' || chr(92) || '{_c[1:]}')"
_ESC_ROLE = _ESC.replace("coalesce(text, '')", "coalesce(role, '')")
SQL = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
  {len(START) + 1 + len(END) + 1} + length({_ESC}) + length(replace({_ESC_ROLE}, chr(10), chr(92) || chr(10))) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = '{LOSS_ROLE}' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
