"""N-gram Jaccard self-join by vertical partitioning (operator 8).

Documents are sets of 64-bit hashes of their distinct word n-grams. The hash
order is the global n-gram order; it is cut into fragments, the same cut for all
documents of a size class, and a document's part in a fragment is a *segment*.

Candidates. Two sets with similarity s differ in at most D n-grams, hence in at
most D segments. Segments that are equal in both are the units shared: per
fragment, equal segments are found by one shuffle on the segment's signature.
Ordering units by how many documents hold them, rarest first, the first D + 1
units of two similar documents have one in common (prefix filter), so a document
with D + 1 units of its own needs no further look; passages and lines that many
documents share come last in the order and do not make candidates.

Links. No group becomes all its pairs. Every group gets a pivot set (the smallest
that a member of it meets in any of its groups), and members are compared with
the pivot only: fragments are joined, the differences are counted per fragment
and summed per pair. What can be linked besides, across the components found so
far, are members of one pivot that share enough of their *differences from it*:
two that are not both linked with the pivot p need at least

* 4/9 s of the s differences of a member linked with p,
* 9/10 (s - (n + n_p) / 9) of those of a member not linked with p

(from |x - y| = s_x + s_y - 2 c, the bound (n_x + n_y) / 9 on it at 80 %, and
|n_y - n_p| <= s_y; for other thresholds (1 - t) / (1 + t) takes the place of 1/9).
So the same prefix filter runs on the differences, rarest first. A pair must share
c = (s_x + s_y - (n_x + n_y) / 9) / 2 of them, so the first that it shares stands at
least c - 1 places before the end of either list; pairs are joined on such places
only, and the few left are verified by their differences, again per fragment and
summed per pair.

Fragments are chosen so that a set of n has more than D = n / 4 non-empty ones
by many standard deviations (small sets: nearly one n-gram a fragment).

Documents with fewer words than n form one n-gram of all their words; without
words or text the set is empty and links with nothing. Equal sets are one class
throughout. Rows with a null id get the component of their class (null if the
class has no other id). Repeated rows give repeated rows; an empty table gives
an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold.llm.common import materialise
from rankfold.llm.components import components

WIDTH = 5
PERCENT = 80
BATCH_BYTES = 1 << 20
FRAGMENT_ROWS = 4096

U = np.uint64
_ODD = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93),
        U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3)]
_BASE = 0x2545F4914F6CDD1D
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(r^i, r^-i) modulo 2^64 for i < n."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for r in (_BASE, inverse):
        p = np.full(n, U(r))
        p[0] = U(1)
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_hashes(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of a buffer that ends with a blank; equal
    words hash equal wherever they stand."""
    a = np.frombuffer(buf, np.uint8)
    blank = _SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    power, back = _powers(max(BATCH_BYTES * 2, 1 << (len(a) - 1).bit_length()))
    total = np.concatenate(([U(0)], np.cumsum((a.astype(np.uint64) + U(1)) * power[:len(a)])))
    return _mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64) * _ODD[7]), start


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A long text in parts that end between words."""
    at = 0
    while at < len(raw):
        to = at + BATCH_BYTES
        while to < len(raw) and not _SPACE[raw[to]]:
            to += 1
        yield raw[at:to] + b" "
        at = to


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a sequence of word hashes."""
    n = len(words)
    if not n:
        return words
    k = min(width, n)
    h = np.full(n - k + 1, U(k)) * _ODD[6]
    for j in range(k):
        h += words[j:n - k + 1 + j] * _ODD[j % 6] * U(2 * (j // 6) + 1)
    return np.unique(_mix(h))


def sets_of(texts: list) -> Iterator[np.ndarray]:
    """The n-gram set of every text, whole texts, about a megabyte at a time."""
    i = 0
    while i < len(texts):
        take, size = [], 0
        while i < len(texts) and (not take or size + len(texts[i] or "") < BATCH_BYTES):
            raw = (texts[i] or "").encode().lower()  # bytes.lower changes A-Z only
            if len(raw) > BATCH_BYTES and not take:
                i += 1
                yield shingles(np.concatenate([word_hashes(p)[0] for p in _pieces(raw)]))
                break
            if len(raw) > BATCH_BYTES:
                break
            take.append(raw + b" ")
            size += len(raw) + 1
            i += 1
        if take:
            h, start = word_hashes(b"".join(take))
            cut = np.searchsorted(start, np.cumsum([len(t) for t in take]))
            for lo, hi in zip(np.concatenate(([0], cut[:-1])), cut, strict=True):
                yield shingles(h[lo:hi])


def set_id(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set; the first is even."""
    with np.errstate(over="ignore"):
        one = _mix(np.array([s.sum(dtype=np.uint64) * _ODD[1] + U(len(s))]))[0] & ~U(1)
        two = _mix(np.array([_mix(s ^ _ODD[3]).sum(dtype=np.uint64) + U(len(s))]))[0]
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def fragments(lo: int) -> int:
    """Number of fragments for the size class [lo, 2 lo)."""
    return 1 << 20 if lo < 16 else 16 * lo if lo < 64 else 4 * lo if lo < 128 else 2 * lo if lo < 256 else int(0.72 * lo)


def units(s: np.ndarray, lo: int) -> np.ndarray:
    """Signatures of the non-empty segments of a sorted set, cut for a class."""
    f = ((s >> U(32)) * U(fragments(lo))) >> U(32)
    at = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
    return _mix(np.add.reduceat(s, at) * _ODD[2] + f[at] * _ODD[4] + U(lo * int(_ODD[5]) & (1 << 64) - 1))


def classes(n: int, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(flag, lo, largest difference D) of the size classes of a set of n: its
    own (flag 0) and, when a partner may be in it, the one below (flag 1).
    Similarity t bounds the difference by (1 - t) / (1 + t) * (n + n')."""
    lo = 1 << (n.bit_length() - 1)
    t = percent / 100
    out = [(0, lo, int(n * (1 - t) / t + 1e-9))]
    if lo > 1 and -(-n * percent // 100) < lo:
        out.append((1, lo // 2, int(2 * n * (1 - t) / (1 + t) + 1e-9)))
    return out


def _info(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[], [], [], [], []]
        for s in sets_of(b.column(1).to_pylist()):
            n = len(s)
            one, two = set_id(s) if n else (None, None)
            t = {flag: len(units(s, lo)) for flag, lo, _ in classes(n)} if n > 3 else {}
            for c, v in zip(cols, (one, two, n, t.get(0), t.get(1)), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols]],
                                         names=["doc_id", "node", "node2", "n", "t0", "t1"])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, nid): nid is the set's digest with the class flag in its last bit."""
    for b in batches:
        sig, nid, held = [], [], 0
        for s in sets_of(b.column(0).to_pylist()):
            if len(s) > 3:
                node = set_id(s)[0]
                for flag, lo, _ in classes(len(s)):
                    u = units(s, lo)
                    sig.append(u.view(np.int64))
                    nid.append(np.full(len(u), node | flag))
                    held += len(u)
            if held > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig)), pa.array(np.concatenate(nid))],
                                                 names=["sig", "nid"])
                sig, nid, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig)), pa.array(np.concatenate(nid))],
                                             names=["sig", "nid"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, parts, part, seg) of the sets of the wanted classes, for each number
    of parts that one of their pivots asks for."""
    for b in batches:
        rep, parts, part, seg = [], [], [], []
        for r, node, cuts, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(),
                                    sets_of(b.column(3).to_pylist()), strict=True):
            if not len(s) or set_id(s)[0] != node:
                continue  # another text under the same id
            for p in cuts:
                f = ((s >> U(32)) * U(p)) >> U(32)
                for k, (lo, hi) in enumerate(zip(*[np.searchsorted(f, np.arange(p) + d) for d in (0, 1)], strict=True)):
                    rep.append(r)
                    parts.append(p)
                    part.append(k)
                    seg.append(s[lo:hi].view(np.int64))
            if sum(map(len, seg)) > 500_000:
                yield _segment_batch(rep, parts, part, seg)
                rep, parts, part, seg = [], [], [], []
        if rep:
            yield _segment_batch(rep, parts, part, seg)


def _segment_batch(rep, parts, part, seg) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in seg]))).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(rep, pa.int64()), pa.array(parts, pa.int32()), pa.array(part, pa.int32()),
         pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(seg)))],
        names=["rep", "parts", "part", "seg"])


def _second_level(stars: DataFrame, sizes: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Components (src, dst) that a linked pair joins, of members of one pivot.
    stars: (a, b, part, diff); sizes: (a, na, b, nb, s, linked)."""
    g = (100 - percent) / (100 + percent)
    of = comp.select(F.col("node").alias("b"), "component")
    st = sizes.join(of, "b", "left").withColumn("c", F.coalesce("component", "b")).drop("component")
    split = st.groupBy("a").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("a")
    keep = materialise(st.join(split, "a"), "nj-open")
    need = F.when(F.col("linked"), (1 - g) / 2 * F.col("s")).otherwise(
        (F.col("s") - g * (F.col("nb") + F.col("na"))) / (1 + g))
    elements = stars.select("a", "b", "diff").join(keep.select("a", "b", "na", "nb", "s", "linked", "c"), ["a", "b"]) \
        .select("a", "b", "na", "nb", "s", "linked", "c", F.explode("diff").alias("e"))
    shared = elements.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("a", "e"))).where("df > 1")
    of_member = Window.partitionBy("a", "b")
    prefix = shared.withColumn("own", F.col("s") - F.count(F.lit(1)).over(of_member)) \
        .withColumn("rn", F.row_number().over(of_member.orderBy("df", "e"))) \
        .withColumn("m", F.greatest(F.lit(1), F.ceil(need - 1e-6))).withColumn("at", F.expr("rn + own")) \
        .where("at <= s - m + 1")
    # the first difference that two members share leaves room for all they must share
    share = f"greatest(1, ceil((s1 + s2 - {g!r} * (nb1 + nb2)) / 2 - 1e-6))"
    x = prefix.select("a", "e", *[F.col(c).alias(c + "1") for c in ("b", "nb", "s", "at", "linked", "c")])
    y = prefix.select("a", "e", *[F.col(c).alias(c + "2") for c in ("b", "nb", "s", "at", "linked", "c")])
    pairs = x.join(y, ["a", "e"]).where("b1 < b2 and c1 <> c2 and not (linked1 and linked2)") \
        .where(f"least(s1 - at1, s2 - at2) + 1 >= {share}") \
        .where(f"100 * least(nb1, nb2) >= {percent} * greatest(nb1, nb2)") \
        .groupBy("b1", "b2", "nb1", "nb2", "c1", "c2").agg(F.min(F.struct("a", "s1", "s2")).alias("p")) \
        .select("b1", "b2", "nb1", "nb2", "c1", "c2", "p.*")
    left = stars.select("a", F.col("b").alias("b1"), "part", F.col("diff").alias("d1"))
    right = stars.select("a", F.col("b").alias("b2"), "part", F.col("diff").alias("d2"))
    both = pairs.join(left, ["a", "b1"]).join(right, ["a", "b2", "part"])
    return both.withColumn("o", F.size(F.array_intersect("d1", "d2"))) \
        .groupBy("b1", "b2", "nb1", "nb2", "c1", "c2", "s1", "s2").agg(F.sum("o").alias("o")) \
        .where(f"(s1 + s2 - 2 * o) * {100 + percent} <= (nb1 + nb2) * {100 - percent}") \
        .select(F.col("c1").alias("src"), F.col("c2").alias("dst"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles long, component_id long) per row of ``docs``."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    info = materialise(rows.mapInArrow(
        _info, "doc_id long, node long, node2 long, n long, t0 long, t1 long"), "nj-info")
    reps = materialise(info.where("n > 0").groupBy("node", "node2", "n").agg(
        F.min("doc_id").alias("rep"), F.max("t0").alias("t0"), F.max("t1").alias("t1")), "nj-reps")

    # units held by at least two sets, with how many rows hold them
    sig = rows.select("text").mapInArrow(_signatures, "sig long, nid long")
    w = Window.partitionBy("sig")
    shared = materialise(
        sig.withColumn("df", F.count(F.lit(1)).over(w)).withColumn("lo", F.min("nid").over(w))
        .withColumn("hi", F.max("nid").over(w)).where("lo <> hi").select("sig", "nid", "df").distinct(), "nj-units")

    # prefix filter: units of a single set come first, then by frequency
    t = percent / 100
    sets = reps.where("n > 3 and rep is not null").select(
        "rep", "n", F.explode(F.array(
            F.struct(F.col("node").alias("nid"), F.lit(0).alias("flag"), F.col("t0").alias("t"),
                     F.floor(F.col("n") * ((1 - t) / t) + 1e-9).alias("d")),
            F.struct((F.col("node") + 1).alias("nid"), F.lit(1).alias("flag"), F.col("t1").alias("t"),
                     F.floor(F.col("n") * (2 * (1 - t) / (1 + t)) + 1e-9).alias("d")))).alias("x")) \
        .select("rep", "n", "x.*").where("t is not null")
    of_set = Window.partitionBy("nid")
    prefix = shared.withColumn("s", F.count(F.lit(1)).over(of_set)) \
        .withColumn("rn", F.row_number().over(of_set.orderBy("df", "sig"))) \
        .join(sets, "nid").where("rn <= d + 1 - (t - s)")
    groups = prefix.groupBy("sig").agg(F.min(F.struct("rep", "n")).alias("p"), F.max("rep").alias("last")) \
        .where("p.rep <> last").select("sig", "p")
    met = materialise(prefix.select("sig", "nid", "rep", "n").join(groups, "sig"), "nj-cand")
    smallest = met.groupBy("nid").agg(F.min("p").alias("p"))
    pivot = met.select("sig", "nid").join(smallest, "nid").groupBy("sig").agg(F.min("p").alias("pivot"))
    # all members of a pivot are cut as the pivot's own class, in whichever classes they meet it
    lo = F.pow(F.lit(2.0), F.floor(F.log2(F.col("pivot.n") + 0.5)))
    star = materialise(
        met.join(pivot, "sig").where("rep <> pivot.rep")
        .select(F.col("pivot.rep").alias("a"), F.col("pivot.n").alias("na"), F.col("rep").alias("b"), F.col("n").alias("nb"),
                F.greatest(F.lit(1), (lo / FRAGMENT_ROWS).cast("int")).alias("parts")).distinct(), "nj-stars")

    # the sets of all that takes part, cut into fragments
    wanted = star.select(F.explode(F.array("a", "b")).alias("rep"), "parts") \
        .groupBy("rep").agg(F.sort_array(F.collect_set("parts")).alias("cuts")).join(reps.select("rep", "node"), "rep")
    segments = materialise(
        wanted.join(rows.select(F.col("doc_id").alias("rep"), "text"), "rep").select("rep", "node", "cuts", "text").distinct()
        .mapInArrow(_segments, "rep long, parts int, part int, seg array<long>"), "nj-segments")
    right = segments.select(F.col("rep").alias("b"), "parts", "part", F.col("seg").alias("sb"))
    left = segments.select(F.col("rep").alias("a"), "parts", "part", F.col("seg").alias("sa"))
    stars = materialise(
        star.join(right, ["b", "parts"]).join(left, ["a", "parts", "part"]).select(
            "a", "na", "b", "nb", "part",
            F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa")).alias("diff")), "nj-diff")
    sizes = stars.groupBy("a", "na", "b", "nb").agg(F.sum(F.size("diff")).alias("s")) \
        .withColumn("linked", F.expr(f"s * {100 + percent} <= (na + nb) * {100 - percent}"))
    first = sizes.where("linked").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    comp = components(first)
    second = materialise(_second_level(stars, sizes, comp, percent), "nj-links")
    of_class = reps.select("node", "node2", "rep") \
        .join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left") \
        .select("node", "node2", F.coalesce("component", "rep").alias("component"))
    if second.limit(1).count():
        joined = components(second).select(F.col("node").alias("component"), F.col("component").alias("smallest"))
        of_class = of_class.join(joined, "component", "left") \
            .select("node", "node2", F.coalesce("smallest", "component").alias("component"))
    return info.join(of_class, ["node", "node2"], "left").select(
        F.col("doc_id").alias(key), F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"))
