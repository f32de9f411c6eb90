"""Chat formatting as a prefix tree (operator 2).

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Control strings inside
a role or text are escaped reversibly (``\\`` doubles, ``<|`` becomes ``<\\|``, a
line end in a role becomes ``\\n``), so a mark in the output is always the
template's own.

Conversations that share initial turns share nodes: a node is a turn after a given
prefix, named by a digest chained along the conversation. Every node is emitted
once, in depth-first order, with

* ``start``/``end``: its place in the emitted sequence (code points),
* ``position``: the position id of its first code point in its conversations
  (what its ancestors are long), so siblings continue from the same position,
* ``ancestors``: the intervals of the emitted sequence that it attends to besides
  its own earlier part, adjacent ones merged,
* ``loss_start``/``loss_end``: the part of an assistant turn under the loss mask.

Depth-first order without a task that holds a tree: a distinct conversation is a
path (16 hex digits a turn); paths sorted as text are the tree's preorder, and a
conversation owns the nodes it is the first to hold. A range sort ranks the paths
(a hot first turn is spread, since its paths differ later), the owner of a node is
a minimum of ranks, and places are prefix sums: per partition, plus the sums of
the partitions before.

Turns of a conversation are ordered by (turn, role, text), nulls first; null role
or text counts as empty; rows with a null id form one conversation; repeated rows
are repeated turns. An empty table gives empty tables. A conversation is streamed
turn by turn through one task and never held.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold.llm.common import materialise

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
STEP = 16
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*)" + re.escape(CLOSE), re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escaped(c: Column, one_line: bool = False) -> Column:
    out = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if one_line else out


def unescape(s: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], s)


def parse(rendered: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    m = _TURN.fullmatch(rendered)
    return unescape(m[1]), unescape(m[2])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn -> node digests; the last row of a
    conversation carries its path."""
    names = ["conv_id", "depth", "node", "parent", "position", "length", "path"]
    last: list | None = None  # the pending row: the next one tells whether it ends a conversation
    state = b""
    path: list[str] = []

    def batch(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          names=names)

    for b in batches:
        out = []
        for conv, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            same = last is not None and last[0] == conv
            if last is not None:
                out.append([*last, None if same else "".join(path)])
            if not same:
                state, path = b"", []
            before = state.hex() if same else None
            state = hashlib.blake2b(state + text.encode(), digest_size=16).digest()
            path.append(state.hex()[:STEP])
            last = [conv, last[1] + 1 if same else 0, state.hex(), before,
                    last[4] + last[5] if same else 0, len(text)]
        if out:
            yield batch(out)
    if last is not None:
        yield batch([[*last, "".join(path)]])


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (rank, depth) -> owned nodes with their ancestors' intervals."""
    rank, spans = None, []
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        d = b.to_pydict()
        keep, out = [], []
        for i in range(b.num_rows):
            if d["rank"][i] != rank:
                rank, spans = d["rank"][i], []
            if d["owned"][i]:
                keep.append(i)
                out.append([{"start": s, "end": e} for s, e in spans])
            if spans and spans[-1][1] == d["start"][i]:
                spans[-1] = (spans[-1][0], d["end"][i])
            else:
                spans.append((d["start"][i], d["end"][i]))
        rows = b.select(["rank", "depth", "node", "start", "end"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, kind)], names=[*rows.schema.names, "ancestors"])


class Tree:
    """nodes: one row per distinct (prefix, turn), see the module's text.
    paths: (rank, depth, node), the turns of each distinct conversation.
    members: (conv_id, rank), which distinct conversation each one is."""

    def __init__(self, nodes: DataFrame, paths: DataFrame, members: DataFrame):
        self.nodes, self.paths, self.members = nodes, paths, members


def build(conversations: DataFrame, key: str = "conv_id") -> Tree:
    turns = conversations.select(
        F.col(key).cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.col("role").alias("role"),
        F.col("text").alias("text"))
    formatted = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")) \
        .select("*", F.concat(F.lit(OPEN), escaped(F.col("role"), True), F.lit("\n"), escaped(F.col("text")),
                              F.lit(CLOSE)).alias("rendered"))
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    chain = materialise(dealt.select("conv_id", "rendered").mapInArrow(
        _chain, "conv_id long, depth int, node string, parent string, position long, length long, path string"), "chat")

    leaves = chain.where("path is not null").select("conv_id", F.col("node").alias("leaf"), "path")
    distinct = leaves.groupBy("leaf").agg(F.min("path").alias("path"), F.min("conv_id").alias("rep"))
    ranked = materialise(distinct.repartitionByRange("path").sortWithinPartitions("path", "leaf")
                         .withColumn("rank", F.monotonically_increasing_id()), "chat-rank")
    members = leaves.join(ranked.select("leaf", "rank"), "leaf").select("conv_id", "rank")

    rows = chain.drop("path").join(ranked.select("rep", "rank"), F.col("conv_id").eqNullSafe(F.col("rep"))).drop("rep", "conv_id")
    owner = rows.groupBy("node").agg(F.min("rank").alias("owner"))
    rows = materialise(rows.join(owner, "node").withColumn("owned", F.col("rank") == F.col("owner")).drop("owner"),
                       "chat-rows")

    # places: prefix sums over (partition of the range sort, rank, depth)
    own = rows.where("owned").withColumn("part", F.shiftright("rank", 33))
    parts = own.groupBy("part").agg(F.sum("length").alias("len"))
    before = parts.select("part", (F.sum("len").over(Window.orderBy("part")) - F.col("len")).alias("base"))
    run = Window.partitionBy("part").orderBy("rank", "depth")
    places = own.join(before, "part").select("node", (
        F.col("base") + F.sum("length").over(run) - F.col("length")).alias("start"))
    placed = rows.join(places, "node").withColumn("end", F.col("start") + F.col("length"))
    spans = placed.select("rank", "depth", "node", "owned", "start", "end") \
        .repartition("rank").sortWithinPartitions("rank", "depth").mapInArrow(
            _intervals, "rank long, depth int, node string, start long, end long, "
                        "ancestors array<struct<start:long,end:long>>")

    # the text of a node comes from the conversation that owns it
    texts = formatted.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "text") \
        .select("conv_id", "role", "rendered").mapInArrow(_numbered, "conv_id long, depth int, role string, rendered string")
    head = F.length(F.concat(F.lit(OPEN), escaped(F.col("role"), True))) + 1
    nodes = spans.join(rows.where("owned").select("node", "parent", "position"), "node") \
        .join(ranked.select("rank", F.col("rep").alias("conv_id")), "rank") \
        .join(texts.withColumnRenamed("conv_id", "c"), F.col("c").eqNullSafe(F.col("conv_id"))
              & (texts["depth"] == spans["depth"])) \
        .select("node", "parent", spans["depth"], "role", "rendered", "start", "end", "position", "ancestors",
                F.when(F.col("role") == "assistant", head).alias("loss_start"),
                F.when(F.col("role") == "assistant", F.length("rendered") - len(CLOSE)).alias("loss_end"))
    return Tree(materialise(nodes, "chat-nodes"), rows.select("rank", "depth", "node"), materialise(members, "chat-members"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, depth = object(), 0
    for b in batches:
        out = []
        for conv in b.column(0).to_pylist():
            depth = depth + 1 if conv == last else 0
            last = conv
            out.append(depth)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int32()), b.column(1), b.column(2)],
                                         names=["conv_id", "depth", "role", "rendered"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rank, rendered, loss_start, loss_end) in order -> one row a rank."""
    names = ["rank", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    rank, s = None, None

    def done() -> list:
        return [rank, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]]

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          names=names)

    for b in batches:
        out = []
        for r, text, lo, hi in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if r != rank:
                if s is not None:
                    out.append(done())
                rank, s = r, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, said = parse(text)
            s[0] += 1
            s[1].update(f"{role}\n{said}\n".encode())
            if lo is not None:
                masked = unescape(text[lo:hi])
                s[2] += len(masked)
                s[3].update(masked.encode())
            s[4] += len(text)
        if out:
            yield batch(out)
    if s is not None:
        yield batch([done()])


def read_back(tree: Tree) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)
    of every conversation, from the emitted nodes."""
    rows = tree.paths.join(tree.nodes.select("node", "rendered", "loss_start", "loss_end"), "node") \
        .repartition("rank").sortWithinPartitions("rank", "depth").select("rank", "rendered", "loss_start", "loss_end")
    per = rows.mapInArrow(_digests, "rank long, n_turns long, turns_sha256 string, loss_chars long, "
                                    "loss_sha256 string, formatted_chars long")
    return tree.members.join(per, "rank").drop("rank")
