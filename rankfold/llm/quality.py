"""Quality classifier (operator 5).

Each whole text becomes a row of document statistics (no label, language, source
or id). The statistics are standardised and mapped to random Fourier features,
whose inner products approximate a Gaussian kernel. Ridge scores solve the normal
equations, of which every partition adds up its own part; isotonic calibration
turns a raw score into the share of label 1 near it.

All labelled rows take part in the fit: the parts are added in two levels, so
what reaches the driver is bounded by the feature count, and the calibration
sees counts per score bin. Statistics are computed in one pass without a
shuffle; only their short rows are joined with the labels.

Null text counts as empty. Several labels of one document are averaged; null
labels are left out. Without labels every score is 0.5. Repeated rows give
repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = 256
RIDGE = 1e-2
BINS = 512
SEED = 20
THRESHOLD = 0.7
#: fixed seed, kernel width per statistic
GAMMA = 0.05

_KIND = np.zeros(256, np.int64)          # 0: other
for _ranges, _k in ((["az"], 1), (["AZ"], 2), (["09"], 3)):
    for _r in _ranges:
        _KIND[ord(_r[0]):ord(_r[1]) + 1] = _k
for _c in b".,;:!?'\"()-":
    _KIND[_c] = 4
for _c in b" \t\r\x0b\x0c":
    _KIND[_c] = 5
_KIND[10] = 6
_KIND[128:] = 7
_WORD = (_KIND != 5) & (_KIND != 6)

NAMES = ["bytes", "words", "word_bytes", "word_spread", "distinct", "repeat", "lower", "upper", "digit", "mark",
         "symbol", "blank", "line", "other_bytes", "odd_ends", "lone", "line_bytes", "line_distinct", "ends"]


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    a = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(_KIND, np.bincount(a, minlength=256), 8)
    share = kinds / max(1, len(raw))
    words = raw.split()
    n = len(words)
    inside = np.zeros(len(a) + 2, bool)
    inside[1:-1] = _WORD[a]
    edge = np.flatnonzero(inside[1:] != inside[:-1])  # where words start and end, in turn
    size = (edge[1::2] - edge[0::2]).astype(np.float64) if n else np.zeros(1)
    same = sum(map(operator.eq, words, words[1:]))
    last = a[edge[1::2] - 1]
    ends = _KIND[last]
    lines = raw.split(b"\n")
    full = [x for x in lines if x]
    return [np.log1p(len(raw)), np.log1p(n), float(size.mean()), float(np.log1p(size.std())),
            len(set(words)) / (n + 1) * np.log1p(n), same / max(1, n),
            share[1], share[2], share[3], share[4], share[0], share[5], share[6], share[7],
            float((ends == 0).mean()) if n else 0.0, float((size == 1).mean()) if n else 0.0,
            np.log1p(len(raw) / max(1, len(lines))), len(set(full)) / max(1, len(full)),
            float(((last == 46) | (last == 44)).mean()) if n else 0.0]


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all but the text) and ``stats`` array<double>."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["stats array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = pa.array([statistics(t.as_py()) for t in b.column(0)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], stats], names=[*keep, "stats"])

    return docs.select(F.col(text).alias("_t"), *keep).mapInArrow(run, schema)


class Model:
    def __init__(self, mean=None, scale=None, weights=None, steps=None):
        self.mean, self.scale, self.weights, self.steps = mean, scale, weights, steps
        rng = np.random.default_rng(SEED)
        self.omega = rng.normal(0, np.sqrt(2 * GAMMA), (len(NAMES), FEATURES))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / FEATURES) * np.cos(x @ self.omega + self.phase)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.features(stats) @ self.weights, -0.5, 1.5)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(stats):
            return np.full(len(stats), 0.5)
        raw = self.raw(stats)
        # a fine share of the raw score keeps the order inside a flat step
        return np.clip(np.interp(raw, *self.steps) * 0.998 + (raw + 0.5) * 0.001, 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _add_blobs(df: DataFrame, n: int) -> np.ndarray:
    """Sum of (blob binary) rows of n doubles: a second level of partial sums
    over about sqrt(partitions) tasks, whose few rows the driver adds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_py(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["blob"])

    parts = max(1, int(df.rdd.getNumPartitions() ** 0.5))
    rows = df.repartition(parts).mapInArrow(run, "blob binary").collect()
    return sum((np.frombuffer(r[0], np.float64) for r in rows), np.zeros(n))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted pool-adjacent-violators over sorted x: (knots, values), two
    knots a block, at its first and last x."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, w, strict=True):
        blocks.append([yi, wi, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    return np.array([v for b in blocks for v in b[2:]]), np.array([b[0] for b in blocks for _ in range(2)])


def fit(labelled: DataFrame) -> Model:
    """``labelled``: (stats array<double>, y double) rows of all labelled documents."""
    d = len(NAMES)
    got = labelled.agg(F.count(F.lit(1)).alias("n"), *[x for i in range(d) for x in (
        F.avg(F.col("stats")[i]).alias(f"m{i}"), F.stddev_pop(F.col("stats")[i]).alias(f"s{i}"))]).first()
    if not got["n"]:
        return Model()
    mean = np.array([got[f"m{i}"] for i in range(d)])
    scale = np.maximum(np.array([got[f"s{i}"] for i in range(d)]), 1e-3)
    model, m = Model(mean, scale), FEATURES + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m, m + 1))
        for b in batches:
            if b.num_rows:
                z = model.features(_matrix(b.column(0)))
                total += z.T @ np.hstack([z, b.column(1).to_numpy()[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["blob"])

    total = _add_blobs(labelled.select("stats", "y").mapInArrow(equations, "blob binary"), m * (m + 1)).reshape(m, m + 1)
    ridge = RIDGE * np.eye(m) * got["n"] / FEATURES
    ridge[-1, -1] = 0
    model.weights = np.linalg.solve(total[:, :-1] + ridge, total[:, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((BINS, 3))
        for b in batches:
            if b.num_rows:
                raw = model.raw(_matrix(b.column(0)))
                at = np.minimum(BINS - 1, ((raw + 0.5) / 2 * BINS).astype(int))
                for k, w in enumerate((np.ones(len(raw)), raw, b.column(1).to_numpy())):
                    out[:, k] += np.bincount(at, w, BINS)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["blob"])

    bins = _add_blobs(labelled.select("stats", "y").mapInArrow(binned, "blob binary"), BINS * 3).reshape(BINS, 3)
    bins = bins[bins[:, 0] > 0]
    model.steps = isotonic(bins[:, 1] / bins[:, 0], bins[:, 2] / bins[:, 0], bins[:, 0])
    return model


def with_labels(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(stats, y) of the labelled rows."""
    y = labels.select(F.col(key).alias("_k"), F.col(label).alias("_y")).where("_k is not null and _y is not null") \
        .groupBy("_k").agg(F.avg("_y").alias("y"))
    return stats.join(y, stats[key] == y["_k"]).select("stats", "y")


def score(stats: DataFrame, model: Model) -> DataFrame:
    """The rows of ``with_statistics`` without ``stats``, with score double and predicted int."""
    keep = [c for c in stats.columns if c != "stats"]
    schema = ", ".join([f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in keep]
                       + ["score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(_matrix(b.column(0))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))],
                names=[*keep, "score", "predicted"])

    return stats.select("stats", *keep).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents whose score reaches the threshold, all columns unchanged;
    statistics are computed in the same pass, so no text is shuffled."""
    at = docs.columns.index(text)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = model.score(np.array([statistics(t.as_py()) for t in b.column(at)]))
                yield b.filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(run, schema)
