"""Spelling variants by asymmetric q-chunks (operator 12).

Words are near if one inserted, deleted or replaced code point makes one the other.
Of two words the shorter one (ties: the smaller) contributes two disjoint chunks of
half its length, at its start and behind that; the other contributes its positional
grams of that length. One edit lies in at most one chunk, so the other chunk is left:
the first at the start, the second moved by the difference of the two lengths, which
is a shift of at most one. Words that share a chunk that way are joined (grams where
no chunk can meet them within that shift are not emitted) and the pair is verified by
its edit distance inside the join, so only near pairs leave it. Before that, the
parities of each letter's count are compared: one edit changes at most two of them.
A pair whose first chunk is left is not taken again through its second.

A word's form is its near word of largest count (ties: smallest in code-point order),
if that count is at least ``factor`` times its own. Counts rise along forms, so they
end after at most log2 of the largest count steps; roots are found by doubling.

Scale: words are counted per task first (a bounded table, written out and begun anew
when full), then by Spark; everything after works on the vocabulary. Grams travel as
64-bit hashes; a hot gram is an ordinary equi-join key that adaptive execution splits;
no list of a gram's words is ever built.

Defined cases: null and empty texts have no words; a null id counts as the empty id in
the key of ``dropped_letter``; repeated rows count as often as they occur; an empty
table gives an empty table; other columns are not read; a word may be as long as a text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold.llm.common import materialise

RUN = re.compile("[A-Za-zÀ-ÿ]+")
AZ = {c: c + 32 for c in range(65, 91)}
TABLE_WORDS = 200_000
MAX_ROUNDS = 64
#: one bit a letter: whether it occurs an odd number of times (letters may share a bit)
ODD_LETTERS = "aggregate(split(word, ''), 0L, (m, c) -> m ^ shiftleft(1L, cast(pmod(ascii(c), 64) AS int)))"


def dropped_letter(key, word: str) -> str:
    """The contract's planted misspellings: a code point goes if 97 divides the hash."""
    h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
    if h % 97:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text", change=None, min_chars: int = 5,
           min_count: int = 3) -> DataFrame:
    """(word string, n long) of the words of at least ``min_chars`` code points that
    occur ``min_count`` times; ``change(key, word)`` may alter a lower-cased word first."""

    def table(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                          names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for k, t in zip(b.column(0), b.column(1)):
                own, k = Counter(RUN.findall(t.as_py() or "")), k.as_py()
                for raw, n in own.items():
                    word = raw.translate(AZ)
                    word = change(k, word) if change else word
                    if len(word) >= min_chars:
                        seen[word] += n
                if len(seen) >= TABLE_WORDS:
                    yield table(seen)
                    seen = Counter()
        yield table(seen)

    return docs.select(key, text).mapInArrow(run, "word string, n long").groupBy("word") \
        .agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _gram(start: Column, length: Column) -> Column:
    return F.xxhash64(F.substring(F.col("word"), start + 1, length))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): every pair of near words once, in no particular order."""
    sized = words.select("word", "n", F.char_length("word").alias("size"), F.expr(ODD_LETTERS).alias("odd"))
    half = F.floor(F.col("size") / 2).cast("int")
    chunk = sized.select("word", "n", "size", "odd", half.alias("q"), F.explode(F.array(
        F.struct(F.lit(0).alias("part"), _gram(F.lit(0), half).alias("gram")),
        F.struct(F.lit(1).alias("part"), _gram(half, half).alias("gram")))).alias("c")) \
        .select(F.col("word").alias("a"), F.col("n").alias("na"), "size", "odd", "q", "c.part", "c.gram")

    def grams(shift: int) -> list[Column]:
        """The grams that a word ``shift`` code points shorter can meet with its chunks."""
        size = F.col("size") - shift
        q = F.floor(size / 2).cast("int")
        longer = F.lit(shift > 0).alias("longer")
        return [F.struct(size.alias("size"), longer, F.lit(0).alias("part"), _gram(F.lit(0), q).alias("gram")),
                F.struct(size.alias("size"), longer, F.lit(1).alias("part"), _gram(q + shift, q).alias("gram"))]

    gram = sized.select("word", "n", "odd", F.explode(F.array(*grams(0), *grams(1))).alias("g")) \
        .select(F.col("word").alias("b"), F.col("n").alias("nb"), "odd", F.col("g.size").alias("size"),
                F.col("g.longer").alias("longer"), F.col("g.part").alias("part"), F.col("g.gram").alias("gram"))
    near = F.bit_count(F.col("c.odd").bitwiseXOR(F.col("g.odd"))) <= 2
    ordered = F.col("longer") | (F.col("a") < F.col("b"))
    again = (F.col("c.part") == 1) & (F.substring("a", F.lit(1), F.col("q")) == F.substring("b", F.lit(1), F.col("q")))
    return chunk.alias("c").join(gram.alias("g"), [
        F.col("c.size") == F.col("g.size"), F.col("c.part") == F.col("g.part"), F.col("c.gram") == F.col("g.gram"),
        near, ordered, ~again, F.levenshtein("a", "b", 1) == 1]).select("a", "na", "b", "nb")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): from every word of ``forms`` (word, form) to the last form."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(MAX_ROUNDS):
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(at.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return at
    raise RuntimeError("forms do not end")


def group_variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every row of ``words`` (word, n)."""
    words = materialise(words, "words")
    pairs = near_pairs(words)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("nb").alias("na"),
                                          F.col("a").alias("b"), F.col("na").alias("nb")))
    best = F.min(F.when(F.col("nb") >= factor * F.col("na"), F.struct((-F.col("nb")).alias("m"), "b")))
    own = materialise(both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("x"))
                      .select("word", "n_near", F.col("x.b").alias("form"), (-F.col("x.m")).alias("form_n")), "near")
    ends = roots(own.where("form is not null"))
    return words.join(own, "word", "left").join(ends, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n",
        F.coalesce("root", "word").alias("root"))
