"""Language identification by nearest centroid (operator 3).

A text is the vector of its character 1-, 2- and 3-gram counts (lower-cased,
letters only, runs of other characters as one blank, hashed into ``DIMS``
cells), weighted sqrt(tf) * idf and normalised. Each learned language has up to
``CENTROIDS`` centroids (spherical k-means); a text gets the language of the
centroid with the largest cosine. Its score is that cosine. A text is
``rejected`` when the distance 1 - cosine exceeds the language's limit, set so
that short texts, which are far from every centroid, are judged against training
texts, or pieces cut from them, of the same length class.

The model is fitted on a documented sample: at most ``SAMPLE`` labelled texts a
language and ``SAMPLE_ALL`` in all (smallest hash of the id first, one text an
id), so one task fits it and the centroids are a few rows. Prediction is one pass over all texts without a shuffle.

Null or letterless texts are ``und`` with score 0 (and rejected). Without any
learned language every text is ``und``. Ties go to the language that sorts
first. Repeated rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMS = 1 << 13
CENTROIDS = 3
SAMPLE = 400
SAMPLE_ALL = 1600
#: the sample is ranked among this many times as many keys a language
OVERSAMPLE = 8
HASHES = 1 << 31
ROUNDS = 12
CHUNK = 1 << 20
#: upper ends of the length classes (letters) with limits of their own
CLASSES = (32, 128, 512)
#: a text is rejected beyond this multiple of this quantile of the class's training
#: distances, or half-way from the quantile to 1 where that is less
SLACK = 1.25
QUANTILE = 0.99
#: a class with fewer texts is judged by pieces of that length, then by all languages
MIN_TEXTS = 100
FIRST_MARK = 0x300
BLANK = np.array([32], np.uint32)


@functools.cache
def _is(kind: str) -> np.ndarray:
    """Whether a code point is of a kind, a set of Unicode classes, by code point."""
    out = np.zeros(0x110000, bool)
    for m in regex.finditer(f"[{kind}]+", "".join(map(chr, range(len(out))))):
        out[m.start():m.end()] = True
    return out


def gram_counts(text: str | None) -> tuple[np.ndarray, int]:
    """(counts over the hashed 1- to 3-grams, number of letters) of a whole
    text, counted in chunks that overlap by two characters."""
    out = np.zeros(DIMS, np.float32)
    if not text:
        return out, 0
    letters = 0
    carry = BLANK
    for at in range(0, len(text), CHUNK):
        raw = np.frombuffer(text[at:at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        word = _is(r"\p{L}\p{M}")[raw]
        first = word.copy()  # of a run of other characters the first stays, as a blank
        first[1:] |= word[:-1]
        first[0] |= carry[-1] != 32  # a run of other characters that a cut divides is one blank
        plain = np.where(word, raw, BLANK)[first]
        c = np.concatenate((carry, plain))
        new = len(carry)
        if at + CHUNK >= len(text) and c[-1] != 32:
            c = np.concatenate((c, BLANK))
        letters += int((c[new:] != 32).sum())
        if (c >= FIRST_MARK).any():  # marks are part of a word, but no letters
            letters -= int(_is(r"\p{M}")[plain].sum())
        h = c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h2 = (h[:-1] >> np.uint64(7)) ^ (h[1:] * np.uint64(3))
        h3 = (h2[:-1] >> np.uint64(5)) ^ (h[2:] * np.uint64(7))
        for k, g in ((1, h), (2, h2), (3, h3)):
            g = g[max(0, new - k + 1):]  # grams that end in this chunk
            g = (g * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(51)
            out += np.bincount(g.astype(np.int64), minlength=DIMS)
        carry = c[-2:]
    out[int(((32 * 0x9E3779B97F4A7C15 & (1 << 64) - 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1) >> 51)] = 0  # lone blank
    return out, letters


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    seeds = [int(np.argmax(x @ _unit(x.mean(0, keepdims=True))[0]))]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(ROUNDS):
        of = np.argmax(x @ c.T, axis=1)
        c = _unit(np.stack([x[of == j].sum(0) if (of == j).any() else c[j] for j in range(len(c))]))
    return c


def _length_class(letters: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.asarray(CLASSES), letters, side="left")


def _piece_counts(texts: list[str], k: int) -> list[np.ndarray]:
    """Counts of a piece of each text with as many letters as length class ``k`` has."""
    if k == len(CLASSES):
        return []  # a text that gave a piece would be of the class itself
    lo, hi = max(8, CLASSES[k - 1] if k else 0), CLASSES[k]
    out = []
    for i, t in enumerate(texts):
        size = int(1.2 * (lo + (hi - lo) * (i % 8 + 0.5) / 8))
        at = max(0, (len(t) - size) // 2)
        g, n = gram_counts(t[at:at + size])
        if n and _length_class(np.array([n]))[0] == k:
            out.append(g)
    return out


def _limits(far: dict[str, list[np.ndarray]]) -> dict[str, list[float]]:
    """Largest accepted distance by language and length class."""
    out = {}
    for name, by_class in far.items():
        limits: list = []
        for k, d in enumerate(by_class):
            if len(d) < MIN_TEXTS:
                d = np.concatenate([x[k] for x in far.values()])
            q = float(np.quantile(d, QUANTILE)) if len(d) else None
            limits.append(limits[-1] if q is None and limits else q and min(SLACK * q, (1 + q) / 2))
        first = next((x for x in limits if x is not None), 1.0)
        out[name] = [first if x is None else x for x in limits]
    return out


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["lang", "text"])
    got = [gram_counts(t) for t in pdf["text"]]
    keep = np.array([n > 0 for _, n in got], bool)
    cols = ["lang", "kind", "class", "vector"]
    if not keep.any():
        return pd.DataFrame({c: [] for c in cols})
    x = np.stack([g for g, _ in got])[keep]
    letters, lang = np.array([n for _, n in got])[keep], pdf["lang"].to_numpy()[keep]
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    v = _unit(np.sqrt(x) * idf)
    rows = [("", "idf", 0, idf)]
    texts = pdf["text"].to_numpy()[keep]
    distances = {}
    for name in sorted(set(lang)):
        own = v[lang == name]
        c = _cluster(own, CENTROIDS)
        far = 1 - (own @ c.T).max(1)
        rows += [(name, "centroid", j, row) for j, row in enumerate(c)]
        of = _length_class(letters[lang == name])
        by_class = [far[of == k] for k in range(len(CLASSES) + 1)]
        for k, d in enumerate(by_class):
            cut = _piece_counts(list(texts[lang == name]), k) if len(d) < MIN_TEXTS else []
            if cut:
                by_class[k] = np.concatenate([d, 1 - (_unit(np.sqrt(np.stack(cut)) * idf) @ c.T).max(1)])
        distances[name] = by_class
    rows += [(name, "limit", 0, np.asarray(x)) for name, x in _limits(distances).items()]
    return pd.DataFrame([(a, b, c, [float(z) for z in d]) for a, b, c, d in rows], columns=cols)


class Model:
    """idf, centroids (one row each) with their language, limits by class."""

    def __init__(self, rows: list):
        self.idf = next((np.asarray(r["vector"], np.float32) for r in rows if r["kind"] == "idf"), None)
        cs = sorted((r["lang"], r["class"], r["vector"]) for r in rows if r["kind"] == "centroid")
        self.langs = np.array([c[0] for c in cs], dtype=object)
        self.centroids = np.asarray([c[2] for c in cs], np.float32)
        limits = {r["lang"]: r["vector"] for r in rows if r["kind"] == "limit"}
        self.limits = np.asarray([limits[x] for x in self.langs], np.float64)

    def predict(self, texts: list) -> tuple[list, np.ndarray, np.ndarray]:
        n = len(texts)
        lang, score, rejected = ["und"] * n, np.zeros(n), np.ones(n, bool)
        if self.idf is None:
            return lang, score, rejected
        for lo in range(0, n, 512):
            got = [gram_counts(t) for t in texts[lo:lo + 512]]
            v = _unit(np.sqrt(np.stack([g for g, _ in got])) * self.idf)
            cos = v @ self.centroids.T
            best = np.argmax(cos, axis=1)
            letters = np.array([c for _, c in got])
            for i in np.flatnonzero(letters > 0):
                j = best[i]
                lang[lo + i] = self.langs[j]
                score[lo + i] = min(1.0, max(0.0, float(cos[i, j])))
                limit = self.limits[j, _length_class(letters[i:i + 1])[0]]
                rejected[lo + i] = 1 - score[lo + i] > limit
        return lang, score, rejected


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on rows (key, text, lang); rows with a null language or text are left out.

    The sample is chosen by key alone: rows per language are counted, a share of the
    hashes that holds several times ``SAMPLE`` keys of each language is let through,
    and only those few are ranked. One text a key (the smallest) is then read."""
    rows = labelled.select(F.xxhash64(key).alias("h"), F.col(text).alias("text"), F.col(lang).alias("lang")) \
        .where("lang is not null and text is not null")
    keys = rows.select("lang", "h", F.pmod("h", F.lit(HASHES)).alias("u"))
    # a sample of SAMPLE_ALL texts has room for so many languages at most
    sizes = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE_ALL)
    few = keys.join(F.broadcast(sizes), "lang").where(F.col("u") * F.col("n").cast("double") < HASHES * OVERSAMPLE * SAMPLE) \
        .select("lang", "u", "h").distinct()
    w = Window.partitionBy("lang").orderBy("u", "h")
    chosen = few.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= SAMPLE) \
        .orderBy("rn", "lang").limit(SAMPLE_ALL).select("lang", "h")
    sample = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")) \
        .select("lang", "text")
    got = sample.coalesce(1).groupBy(F.lit(0).alias("g")).applyInPandas(
        _fit, "lang string, kind string, class int, vector array<double>")
    return Model(got.collect())


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred string, score double, rejected boolean to every row."""
    fields = docs.schema.fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
                       + ["lang_pred string", "score double", "rejected boolean"])
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            lang, score, rejected = m.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                names=[*b.schema.names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, schema)


def held_out_accuracy(predicted: DataFrame, truth: Column) -> float:
    return predicted.agg(F.avg((F.col("lang_pred") == truth).cast("double"))).first()[0]
