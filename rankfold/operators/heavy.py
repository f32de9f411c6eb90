"""The n most frequent terms of many term lists, exactly, without shuffling every term (M3).

1. Each task counts its terms, a batch of lists at a time, in a table of bounded size. A
   full table, and a batch's own before it is added, is cut to its largest counts: the count at the cut is taken off all of them (those that reach zero
   go) and added to the task's error. A term's true count then lies between its count in
   the table and that plus the error. Tables merge by adding counts and errors.
2. With E the summed error and t the n-th largest merged count, a term whose upper bound
   is below t cannot be among the n most frequent. What is left is counted again, exactly.
   If E is so large that it does not separate them (t < 2 E), or fewer than n terms pass
   the document limit above t, the tables are made larger; a table that never fills has
   no error, so this ends.

Only bounded tables are shuffled; the recount combines map-side to one row per candidate.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.session import scratch_path, ship_package

#: table entries per task, in multiples of n, and at least
TABLE, LEAST = 4, 1 << 14


def materialise(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def terms_of(tokens: list[str]) -> Counter:
    """Counts of tokens and of pairs of neighbours."""
    found = Counter(tokens)
    found.update(map(" ".join, zip(tokens, tokens[1:])))
    return found


def _cut(table: dict[str, int], size: int) -> tuple[dict[str, int], int]:
    if len(table) <= size:
        return table, 0
    off = sorted(table.values(), reverse=True)[size]
    return {t: c - off for t, c in table.items() if c > off}, off


def _coded(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray] | None:
    """(words, the word of each token, the list of each token); None if a word has a blank in
    it, when a token and a pair of neighbours may be one term."""
    tokens = lists.flatten().dictionary_encode()
    words = tokens.dictionary
    if tokens.null_count or pc.any(pc.match_substring(words, " ")).as_py():
        return None
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return words, tokens.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(lists)), size)


def _batch_table(lists: pa.Array, size: int) -> tuple[dict[str, int], int]:
    """Counts of the terms of a batch, cut to ``size``, and what the cut took off."""
    coded = _coded(lists)
    if coded is None:
        table = Counter()
        for tokens in lists:
            table.update(terms_of(tokens.as_py() or []))
        return _cut(table, size)
    words, word, row = coded
    near = row[1:] == row[:-1]
    pairs, times = np.unique(word[:-1][near] * max(1, len(words)) + word[1:][near], return_counts=True)
    counts = np.concatenate([np.bincount(word, minlength=len(words)), times])
    off = int(np.partition(counts, len(counts) - size - 1)[len(counts) - size - 1]) if len(counts) > size else 0
    at = np.flatnonzero(counts > off)
    one, two = at[at < len(words)], pairs[at[at >= len(words)] - len(words)]
    terms = words.take(pa.array(one)).to_pylist() + pc.binary_join_element_wise(
        words.take(pa.array(two // max(1, len(words)))), words.take(pa.array(two % max(1, len(words)))), " ").to_pylist()
    return dict(zip(terms, (counts[at] - off).tolist())), off


def _tables(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, error = Counter(), 0
        for b in batches:
            found, off = _batch_table(b.column(0), size)
            table.update(found)
            error += off
            if len(table) > 2 * size:
                kept, off = _cut(table, size)
                table, error = Counter(kept), error + off
        kept, off = _cut(table, size)
        # the error travels as the count of no term
        yield pa.RecordBatch.from_arrays([pa.array([*kept, None], pa.string()), pa.array([*kept.values(), error + off], pa.int64())],
                                         names=["term", "low"])
    return run


def candidates(lists: DataFrame, tokens: str, n: int, size: int) -> tuple[list[str] | None, int]:
    """(terms that may be among the n most frequent, least count below which none is);
    None if tables of ``size`` cannot tell."""
    merged = materialise(lists.select(tokens).mapInArrow(_tables(size), "term string, low long")
                         .groupBy("term").agg(F.sum("low").alias("low")), "terms")
    error = merged.where("term is null").agg(F.coalesce(F.sum("low"), F.lit(0))).first()[0]
    known = merged.where("term is not null")
    top = known.orderBy(F.col("low").desc()).limit(n).agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("t")).first()
    least = top["t"] if top["n"] == n else 0
    if error and least < 2 * error:
        return None, 0
    return [r["term"] for r in known.where(F.col("low") + error >= least).select("term").toLocalIterator()], least


def _row_counts(lists: pa.Array, wanted: pa.Array, place: dict[str, int], first: pa.Array, second: pa.Array) -> np.ndarray:
    """(list, place in ``wanted``, count) of the wanted terms of each list, in order; ``first``
    and ``second`` are the words of the wanted pairs (no second one: a single word)."""
    coded = _coded(lists)
    if coded is None:
        return np.array([(i, place[t], c) for i, x in enumerate(lists)
                         for t, c in sorted(terms_of(x.as_py() or []).items()) if t in place], np.int64).reshape(-1, 3)
    words, word, row = coded
    one = pc.fill_null(pc.index_in(words, value_set=wanted), -1).to_numpy().astype(np.int64)[word]
    a, b = (pc.fill_null(pc.index_in(x, value_set=words), -1).to_numpy().astype(np.int64) for x in (first, second))
    both = np.flatnonzero((a >= 0) & (b >= 0))
    code = a[both] * max(1, len(words)) + b[both]
    by = np.argsort(code)
    code, both = code[by], both[by]
    near = np.flatnonzero(row[1:] == row[:-1]) if len(code) else np.zeros(0, np.int64)
    pair = word[near] * max(1, len(words)) + word[near + 1] if len(near) else near
    at = np.minimum(np.searchsorted(code, pair), max(0, len(code) - 1))
    hit = np.flatnonzero(code[at] == pair) if len(near) else near
    key = np.concatenate([row[one >= 0] * max(1, len(wanted)) + one[one >= 0],
                          row[near[hit]] * max(1, len(wanted)) + both[at[hit]]])
    key, times = np.unique(key, return_counts=True)
    return np.stack([key // max(1, len(wanted)), key % max(1, len(wanted)), times], 1)


def _counts(names: list[str], tokens: str, kept):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(kept.value, pa.string())
        place = {t: i for i, t in enumerate(kept.value)}
        split = [t.partition(" ") for t in kept.value]
        first = pa.array([a if blank else None for a, blank, _ in split], pa.string())
        second = pa.array([b if blank else None for _, blank, b in split], pa.string())
        for b in batches:
            row, term, count = _row_counts(b.column(tokens), wanted, place, first, second).T
            at = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.ListArray.from_arrays(at, wanted.take(pa.array(term))),
                 pa.ListArray.from_arrays(at, pa.array(count, pa.int64()))], names=[*names, "terms", "counts"])
    return run


def frequent_terms(lists: DataFrame, tokens: str, n: int, min_df: int = 1,
                   size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, counts). Vocabulary: (term, df, total), the n terms of the largest total
    (ties: term ascending) that at least ``min_df`` lists hold; terms are the tokens of a list
    and the pairs of neighbours. Counts: the columns of ``lists`` without ``tokens``, and
    ``terms``, ``counts`` of the row (candidates only). ``lists`` is read three times."""
    ship_package(lists.sparkSession)
    size = size or max(TABLE * n, LEAST)
    names = [c for c in lists.columns if c != tokens]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in lists.schema if f.name != tokens]
    while True:
        found, least = candidates(lists, tokens, n, size)
        if found is not None:
            kept = lists.sparkSession.sparkContext.broadcast(sorted(found))
            counted = materialise(lists.mapInArrow(_counts(names, tokens, kept), ", ".join(
                [*fields, "terms array<string>", "counts array<bigint>"])), "counts")
            exact = counted.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")) \
                .agg(F.count(F.lit(1)).alias("df"), F.sum("x.counts").alias("total"))
            vocab = materialise(exact.where(F.col("df") >= min_df).orderBy(F.col("total").desc(), "term").limit(n), "vocabulary")
            last = vocab.agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("t")).first()
            # whatever is no candidate has a smaller total than ``least``
            if least == 0 or last["n"] == n and last["t"] >= least:
                return vocab, counted
        size *= 4
