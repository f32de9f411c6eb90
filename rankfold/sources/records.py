"""Records of text files, split anywhere, numbered in arrival order.

Spark splits a text file at line ends; records are cut at other places: a quoted CSV
cell may hold line ends, a JSON file may be one array on one line or one object a line.
Both are read as pieces that Spark can split (CSV: lines; JSON: what lies between two
``}``) and put together again by the state at the start of each split:

1. one pass runs every split from each state it may start in (CSV: inside a quoted cell
   or not; JSON: inside a string or not) and notes the state it ends in and, for JSON, by
   how much the nesting of objects has changed;
2. sums over the splits of a file, in order, give the true state at each split's start
   (a table of one row per split, as many as Spark plans tasks);
3. a second pass emits the records. One that runs over the end of its split is emitted
   in parts, which are few and are joined by the split it began in;
4. records per split, summed in order of file name and place, number the records. The
   numbers do not depend on the split size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfold.session import scratch_path, ship_package

_ESCAPE = re.compile(r"\\.", re.DOTALL)
PIECE = "fid long, start long, piece string"
SUMMARY = "fid long, start long, end0 int, end1 int, deep0 long, deep1 long"
RECORD = "fid long, start long, local long, part long, text string"
#: the number, within a split, of a record that began in an earlier one
EARLIER = -1


class CsvLines:
    """State: whether a line starts inside a quoted cell. A quote opens a cell only at
    the cell's start; a doubled one inside is text."""

    separator, end = "\n", "\n"

    @staticmethod
    def step(line: str, inside: int) -> tuple[int, int]:
        if '"' not in line:
            return inside, 0
        at = 0
        while True:
            if not inside and line[at:at + 1] == '"':
                inside, at = 1, at + 1
            if inside:
                at = line.find('"', at)
                if at < 0:
                    return 1, 0
                if line[at + 1:at + 2] == '"':
                    at += 2
                    continue
                inside = 0
            at = line.find(",", at) + 1
            if not at:
                return 0, 0

    @staticmethod
    def ended(inside: int, depth: int) -> bool:
        return not inside

    @staticmethod
    def record(pieces: list[str]) -> str | None:
        text = "\n".join(pieces)
        return text if text.rstrip("\r") else None


class JsonObjects:
    """State: whether a piece starts inside a string; its depth counts objects only."""

    separator, end = "}", "}"

    @staticmethod
    def step(piece: str, inside: int) -> tuple[int, int]:
        bare = _ESCAPE.sub("", piece) if "\\" in piece else piece
        parts = bare.split('"')
        depth = sum(p.count("{") for p in parts[inside::2])
        inside = (inside + len(parts) - 1) % 2
        return inside, depth - (not inside)

    @staticmethod
    def ended(inside: int, depth: int) -> bool:
        return not inside and depth <= 0

    @staticmethod
    def record(pieces: list[str]) -> str | None:
        text = "}".join(pieces) + "}"
        at = text.find("{")
        return text[at:] if at >= 0 else None


FORMATS = {"csv": CsvLines, "json": JsonObjects}


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], str]]:
    for b in batches:
        yield from zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), b.column(2).to_pylist())


def _summaries(kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[int]] = {}
        for split, piece in _splits(batches):
            now = found.setdefault(split, [0, 1, 0, 0])
            for k in (0, 1):
                now[k], deeper = kind.step(piece, now[k])
                now[2 + k] += deeper
        yield pa.RecordBatch.from_arrays(
            [pa.array([s[0] for s in found], pa.int64()), pa.array([s[1] for s in found], pa.int64())]
            + [pa.array([v[k] for v in found.values()], pa.int32() if k < 2 else pa.int64()) for k in range(4)],
            names=["fid", "start", "end0", "end1", "deep0", "deep1"])
    return run


def _records(kind, states: dict[tuple[int, int], tuple[int, int]], rows: int = 4096):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, pieces, inside, depth, local, begun = None, [], 0, 0, 0, True

        def close(whole: bool) -> None:
            nonlocal pieces, local, begun
            if not pieces:
                return
            if begun and whole:
                text = kind.record(pieces)
                if text is not None:
                    out.append((*now, local, None, text))
                    local += 1
            else:  # part: 0 the beginning, 1 goes on, 2 the end
                out.append((*now, local if begun else EARLIER, 0 if begun else 2 if whole else 1,
                            kind.end.join(pieces)))
                local += begun
            pieces, begun = [], True

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * 5
            types = [pa.int64()] * 4 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                              names=["fid", "start", "local", "part", "text"])

        for split, piece in _splits(batches):
            if split != now:
                close(False)
                now, local = split, 0
                inside, depth = states[split]
                begun = kind.ended(inside, depth)  # else the first pieces belong to an earlier split
            pieces.append(piece)
            inside, deeper = kind.step(piece, inside)
            depth += deeper
            if kind.ended(inside, depth):
                close(True)
            if len(out) >= rows:
                yield batch()
                out = []
        close(False)
        yield batch()
    return run


def read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """(seq long, file string, first boolean, text string): the records of all files of
    ``path`` (a file, folder or glob), numbered from 0 in order of file name and place;
    ``first`` marks the first record of a file. Blank CSV lines are no records, nor is what
    stands between JSON objects. A part that no end follows is a record too."""
    ship_package(spark)
    kind = FORMATS[fmt]
    raw = spark.read.option("lineSep", kind.separator).text(path) if fmt != "csv" else spark.read.text(path)
    pieces = raw.select(F.xxhash64("_metadata.file_path").alias("fid"), F.col("_metadata.file_block_start").alias("start"),
                        F.col("value").alias("piece"))
    names = raw.select(F.xxhash64("_metadata.file_path").alias("fid"), F.col("_metadata.file_path").alias("file")).distinct()
    # the state before a split: what came before it in its file
    before = Window.partitionBy("fid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    parts = pieces.mapInArrow(_summaries(kind), SUMMARY)
    # a split either keeps the parity of quotes or turns it (JSON), or ends as it ends (CSV)
    if fmt == "json":
        inside = F.pmod(F.coalesce(F.sum("end0").over(before), F.lit(0)), F.lit(2)).cast("int")
    else:
        # the last split before that ends alike from both states, then the turns since
        inside = F.col("inside")
        parts = _csv_states(parts)
    state = parts.withColumn("inside", inside).withColumn(
        "depth", F.coalesce(F.sum(F.when(F.col("inside") == 1, F.col("deep1")).otherwise(F.col("deep0"))).over(before),
                            F.lit(0)))
    states = {(r["fid"], r["start"]): (r["inside"], r["depth"])
              for r in state.select("fid", "start", "inside", "depth").toLocalIterator()}
    folder = scratch_path(spark, "records")
    pieces.mapInArrow(_records(kind, states), RECORD).write.parquet(folder)
    rows = spark.read.schema(RECORD).parquet(folder)
    # parts follow the beginning in the last split before them that has one
    # (what ends in a split stands before what begins in it)
    upto = Window.partitionBy("fid").orderBy("start", F.col("part") == 0).rowsBetween(Window.unboundedPreceding, 0)
    begun = F.when(F.col("part") == 0, F.struct("start", "local"))
    pieced = (rows.where("part is not null").withColumn("of", F.last(begun, True).over(upto)).where("of is not null")
              .groupBy("fid", "of").agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("at"), "part", "text"))).alias("p"))
              .select("fid", F.col("of.start").alias("start"), F.col("of.local").alias("local"),
                      F.array_join(F.transform("p", lambda x: x["text"]), kind.end).alias("text")))
    if fmt == "json":
        pieced = pieced.select("fid", "start", "local", F.concat("text", F.lit(kind.end)).alias("text")) \
            .where(F.instr("text", "{") > 0).withColumn("text", F.expr("substring(text, instr(text, '{'))"))
    whole = rows.where("part is null").select("fid", "start", "local", "text").unionByName(pieced)
    # records per split, summed in order of file name and place
    counts = whole.groupBy("fid", "start").agg(F.max("local").alias("last")).join(F.broadcast(names), "fid") \
        .withColumn("base", F.coalesce(F.sum(F.col("last") + 1).over(
            Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
        .withColumn("head", F.row_number().over(Window.partitionBy("fid").orderBy("start")) == 1)
    return whole.join(F.broadcast(counts), ["fid", "start"]).select(
        (F.col("base") + F.col("local")).alias("seq"), "file",
        (F.col("head") & (F.col("local") == 0)).alias("first"), "text")


def _csv_states(parts: DataFrame) -> DataFrame:
    """Adds ``inside``, the state before each split. A split maps the state at its start
    to (end0, end1): it keeps it, turns it, or ends alike from both."""
    fixed_end = F.when(F.col("end0") == F.col("end1"), F.col("end0"))
    turn = F.when((F.col("end0") == 1) & (F.col("end1") == 0), 1).otherwise(0)
    w = Window.partitionBy("fid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    run = parts.withColumn("known", F.coalesce(F.last(fixed_end, True).over(w), F.lit(0))) \
        .withColumn("turns", F.coalesce(F.sum(turn).over(w), F.lit(0))) \
        .withColumn("at", F.coalesce(F.last(F.when(fixed_end.isNotNull(), F.col("start")), True).over(w), F.lit(-1)))
    upto = run.select("fid", F.col("start").alias("at"), (F.col("turns") + turn).alias("turned"))
    return run.join(upto, ["fid", "at"], "left").withColumn(
        "inside", F.pmod(F.col("known") + F.col("turns") - F.coalesce("turned", F.lit(0)), F.lit(2)).cast("int")) \
        .select(*parts.columns, "inside")
