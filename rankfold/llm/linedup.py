"""Exact line deduplication with per-document keep bitmaps (operator 13).

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case.
Keys of at least ``min_chars`` code points that at least ``min_docs`` documents hold
lose all their lines except in the largest document that holds them.

Only DataFrame functions are used. Lines travel as (two 64-bit hashes of the key,
document, version, position), never as text:

1. hashes are range-partitioned and sorted within the partitions by hash, document
   (largest first) and position; a window streams over them and numbers the documents
   of a hash in order of their first occurrence: the first one keeps its lines;
2. hashes that a bounded frequency sketch reports (at most ``HOT_KEYS``; a hash held by
   a third of all lines is always among them) are taken out of that sort. Their
   documents are made distinct and counted by partial aggregates, and the at most
   ``HOT_KEYS`` results are broadcast to their lines. Both ways are exact, so it does
   not matter which hashes the sketch reports;
3. dropped positions become one bitmap a document, run-length coded: the kept lines as
   (start, length) runs. Documents without dropped lines have no row.

``apply`` joins bitmaps with texts where texts are wanted.

Defined cases: null and empty texts are one empty line; rows of a null id are one
document, smaller than any other; rows that repeat an id are the same document, and
rows of one id with different texts get a bitmap each (``version`` is a hash of the
text); repeated rows all get the same bitmap; a line of any length is one line; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold.llm.common import materialise

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3
#: bounds of the frequency sketch: reported hashes, tracked hashes
HOT_KEYS, SKETCH_ITEMS = 256, 8192


def lower_az(x: Column) -> Column:
    """A-Z to lower case; ``lower`` does the same, faster, where all is ASCII."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, upper, lower))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def version(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_hashes(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1 long, h2 long, doc, version long, pos int) of every line whose key is long enough."""
    line = docs.select(F.col(key).alias("doc"), version(F.col(text)).alias("version"),
                       F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
    bare = F.trim(F.col("line"), F.lit(BLANKS))
    return line.where(F.char_length(bare) >= min_chars).select(
        F.xxhash64(lower_az(bare)).alias("h1"), F.xxhash64(F.lit(13), lower_az(bare)).alias("h2"),
        "doc", "version", "pos")


def hot_hashes(lines: DataFrame, keys: int = HOT_KEYS, tracked: int = SKETCH_ITEMS) -> list[int]:
    """At most ``keys`` values of h1 that a frequency sketch of all lines reports."""
    top = lines.agg(F.expr(f"approx_top_k(h1, {keys}, {tracked})").alias("top")).first()["top"]
    return [x["item"] for x in top or [] if x["count"] > 1]


def dropped_lines(lines: DataFrame, hot: list[int], min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, version, pos) of the lines that go."""
    by_key = Window.partitionBy("h1", "h2")
    in_order = by_key.orderBy(F.col("doc").desc_nulls_last(), "pos")
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot_line = F.col("h1").isin(hot) if hot else F.lit(False)
    cold = lines.where(~hot_line).repartitionByRange(parts, "h1", "h2") \
        .sortWithinPartitions("h1", "h2", F.col("doc").desc_nulls_last(), "pos") \
        .withColumn("nth", F.dense_rank().over(by_key.orderBy(F.col("doc").desc_nulls_last()))) \
        .withColumn("holders", F.max("nth").over(by_key)) \
        .where((F.col("nth") > 1) & (F.col("holders") >= min_docs)).select("doc", "version", "pos")
    if not hot:
        return cold
    some = lines.where(hot_line)
    held = some.select("h1", "h2", "doc").distinct().groupBy("h1", "h2") \
        .agg(F.count(F.lit(1)).alias("holders"), F.max("doc").alias("last")).where(F.col("holders") >= min_docs)
    gone = some.join(F.broadcast(held), ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("last")))
    return cold.unionByName(gone.select("doc", "version", "pos"))


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                 min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, version long, n_dropped long, keep array<struct<start int, length int>>): the kept
    lines of every document that loses any. The last run has length 2^31 - 1 - start: it
    goes on to the end, however many lines there are."""
    lines = materialise(line_hashes(docs, key, text, min_chars), "lines")
    gone = dropped_lines(lines, hot_hashes(lines), min_docs).groupBy("doc", "version") \
        .agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    start = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1))
    end = F.concat(F.col("gone"), F.array(F.lit(2**31 - 1)))
    runs = F.filter(F.zip_with(start, end, lambda s, e: F.struct(s.alias("start"), (e - s).alias("length"))),
                    lambda r: r["length"] > 0)
    return gone.select("doc", "version", F.size("gone").cast("long").alias("n_dropped"), runs.alias("keep"))


def apply(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_lines long, n_dropped long, kept string): every row of ``docs`` with its kept lines."""
    own = docs.select(key, F.col(text).alias("_t"), version(F.col(text)).alias("version"))
    met = own.join(bitmaps, own[key].eqNullSafe(bitmaps["doc"]) & (own["version"] == bitmaps["version"]), "left")
    # the one-element explode splits a text once, not once for every run
    split = met.select(own[key], "_t", "n_dropped", "keep", F.explode(F.array(lines_of(F.col("_t")))).alias("_l"))
    kept = F.array_join(F.flatten(F.transform("keep", lambda r: F.slice("_l", r["start"] + 1, r["length"]))), "\n")
    return split.select(key, F.size("_l").cast("long").alias("n_lines"),
                        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
                        F.when(F.col("keep").isNull(), F.coalesce("_t", F.lit(""))).otherwise(kept).alias("kept"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Bitmaps made and applied: (key, n_lines, n_dropped, kept)."""
    return apply(docs, keep_bitmaps(docs, key, text), key, text)
