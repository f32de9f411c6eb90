"""Content model (M1-M11): TF-IDF + one-hot + min-max item features, cosine.

  tokens     lower + regexp_extract_all + stop-word filter (M2), written down once
  vocabulary bounded tables of counts per task, then an exact recount of the terms
             that may be among the MAX_FEATURES largest (M3, operators.heavy)
  tf-idf     one pass over the items' term counts; the vocabulary (at most
             max_features rows) goes to the tasks (M4)
  vectors    text, one-hot and scaled numbers of an item are one row, scaled to unit
             length (M5-M7); no term row is ever shuffled
Similarities are never materialised as an N x N table: neighbours come from
the blocked top-n product (operators.blockdot) over unit feature vectors.

Feature ids are 64-bit hashes of "kind:name" so text, categorical and
numeric dimensions share one sparse index space without a driver-side
dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold import fixed
from rankfold.functions import jsonfields as J
from rankfold.functions.scalar import once
from rankfold.operators import heavy
from rankfold.operators.blockdot import top_n_dot
from rankfold.operators.heavy import materialise
from rankfold.operators.numbering import numbered
from rankfold.session import spread


@dataclass
class ContentConfig:
    text_fields: list[str] = field(default_factory=lambda: list(fixed.DEFAULT_TEXT_FIELDS))
    categorical_fields: list[str] = field(default_factory=lambda: list(fixed.DEFAULT_CATEGORICAL_FIELDS))
    numerical_fields: list[str] = field(default_factory=list)
    max_features: int = fixed.MAX_FEATURES
    min_df: int = fixed.MIN_DF
    stop_words: list[str] = field(default_factory=lambda: list(fixed.STOP_WORDS))


@dataclass
class ContentModel:
    config: ContentConfig
    vocab: DataFrame          # term, df, total
    features: DataFrame       # item_id, fid, weight  (raw feature vectors as long rows)
    vectors: DataFrame        # item_id, idx array<bigint>, val array<double>  (unit rows)
    n_items: int
    n_dims: int
    groups: tuple[DataFrame, DataFrame] | None = field(default=None, repr=False, compare=False)  # see ``grouped``


# --- M1 / F4 / F5 / F6 ---------------------------------------------------------

def _truthy_col(c: Column, dtype: str) -> Column:
    if dtype == "string":
        return F.when(F.length(c) > 0, c)
    return F.when(c.isNotNull() & (c != 0), c)


def text_of_item(items: DataFrame, fields: list[str]) -> Column:
    """per field, the item value or else features[field]; truthy parts joined by ' '."""
    types = dict(items.dtypes)
    parts = []
    for f in fields:
        own = _truthy_col(F.col(f).cast("string") if types.get(f) != "string" else F.col(f),
                          "string") if f in types else None
        fb = J.truthy_text(F.col("features"), f) if "features" in types else None
        cands = [c for c in (own, fb) if c is not None]
        if cands:
            parts.append(F.coalesce(*cands))
    return F.concat_ws(" ", *parts) if parts else F.lit("")


def category_of_item(items: DataFrame, f: str) -> Column:
    """the item field only (features are not tried), else 'unknown'."""
    if f not in items.columns:
        return F.lit(fixed.UNKNOWN_CATEGORY)
    c = F.col(f).cast("string")
    return F.coalesce(F.when(F.length(c) > 0, c), F.lit(fixed.UNKNOWN_CATEGORY))


def number_of_item(items: DataFrame, f: str) -> Column:
    """field or features[field] as float; failure -> 0.0."""
    types = dict(items.dtypes)
    fb = None
    if "features" in types:
        v = J.field(F.col("features"), f)
        fb = F.when(J.truthy(v), F.coalesce(F.try_variant_get(v, "$", "double"),
                                            F.try_variant_get(v, "$", "string").try_cast("double")))
    if f in types:
        own = F.col(f)
        if types[f] == "string":
            val = F.when(F.length(own) > 0, F.trim(own).try_cast("double")).otherwise(fb)
        else:
            val = F.when(own.isNotNull() & (own != 0), own.cast("double")).otherwise(fb)
    else:
        val = fb if fb is not None else F.lit(None)
    return F.coalesce(val.cast("double"), F.lit(0.0))


def corpus(items: DataFrame, cfg: ContentConfig) -> DataFrame:
    cols = [F.col("item_id"), text_of_item(items, cfg.text_fields).alias("text")]
    cols += [category_of_item(items, f).alias(f"cat_{i}") for i, f in enumerate(cfg.categorical_fields)]
    cols += [number_of_item(items, f).alias(f"num_{i}") for i, f in enumerate(cfg.numerical_fields)]
    return items.select(*cols)


# --- M2 ------------------------------------------------------------------------

def tokens(text: Column, stop_words: list[str]) -> Column:
    """Lower-cased runs of 2+ word characters, stop words removed (repeats kept)."""
    toks = F.regexp_extract_all(F.lower(text), F.lit(fixed.TOKEN_PATTERN), 0)
    if not stop_words:
        return toks
    return F.filter(toks, lambda t: ~t.isin(stop_words))


def with_bigrams(toks: Column) -> Column:
    """Unigrams followed by the bigrams of adjacent tokens. ``toks`` must be a
    column reference (not an expression), so it is evaluated once per row."""
    pairs = F.zip_with(toks, F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(1))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(toks, F.filter(pairs, lambda p: p.isNotNull()))


def item_tokens(corp: DataFrame, cfg: ContentConfig) -> DataFrame:
    """The corpus with its tokens instead of its text, built once and written down."""
    keep = [c for c in corp.columns if c != "text"]
    return materialise(corp.select(*keep, tokens(F.col("text"), cfg.stop_words).alias("toks")), "tokens")


# --- M3 / M4 -------------------------------------------------------------------

def vocabulary(toks: DataFrame, cfg: ContentConfig) -> tuple[DataFrame, DataFrame]:
    """M3: terms (tokens and bigrams) with df >= min_df, then the max_features largest
    total counts (ties: term ascending): (term, df, total), and each item's term counts."""
    return heavy.frequent_terms(toks, "toks", cfg.max_features, cfg.min_df)


def tfidf(counts: DataFrame, vocab: DataFrame, n_items: int) -> DataFrame:
    """M4: the rows of ``counts`` with ``fids`` and ``weights`` of their vocabulary terms:
    tf * (ln((1+N)/(1+df)) + 1), scaled to unit L2. One pass, no shuffle; the vocabulary
    (at most max_features rows) goes to the tasks."""
    spark = counts.sparkSession
    rows = vocab.select("term", "df", _fid("t", F.col("term")).alias("fid")).toPandas()
    idf = np.log((1.0 + n_items) / (1.0 + rows["df"].to_numpy(np.float64))) + 1.0
    shared = spark.sparkContext.broadcast((rows["term"].tolist(), rows["fid"].to_numpy(np.int64), idf))
    names = [c for c in counts.columns if c not in ("terms", "counts")]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema if f.name in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, fids, idf = shared.value
        values = pa.array(terms, pa.string())
        for b in batches:
            of = b.column("terms")
            size = np.diff(of.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), size)
            at = pc.fill_null(pc.index_in(of.flatten(), value_set=values), -1).to_numpy()
            ok = at >= 0
            row, at = row[ok], at[ok]
            w = b.column("counts").flatten().to_numpy()[ok] * idf[at] if len(at) else np.zeros(0)
            w = w / np.sqrt(np.bincount(row, w * w, b.num_rows))[row]
            cut = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.ListArray.from_arrays(cut, pa.array(fids[at], pa.int64())),
                 pa.ListArray.from_arrays(cut, pa.array(w, pa.float64()))], names=[*names, "fids", "weights"])

    return counts.select(*names, "terms", "counts").mapInArrow(run, ", ".join(
        [*fields, "fids array<bigint>", "weights array<double>"]))


def term_weights(weighted: DataFrame, vocab: DataFrame) -> DataFrame:
    """(item_id, term, weight) of ``tfidf`` as long rows."""
    x = weighted.select("item_id", F.explode(F.arrays_zip("fids", "weights")).alias("x"))
    named = vocab.select("term", _fid("t", F.col("term")).alias("fid"))
    return x.select("item_id", F.col("x.fids").alias("fid"), F.col("x.weights").alias("weight")) \
        .join(F.broadcast(named), "fid").select("item_id", "term", "weight")


# --- M5 / M6 / M7 --------------------------------------------------------------

def _fid(kind: str, name: Column) -> Column:
    return F.xxhash64(F.concat(F.lit(kind + ":"), name))


def _scaled(corp: DataFrame, cfg: ContentConfig) -> dict[str, Column]:
    """Field -> its values scaled to [0,1] (constant column -> 0); empty when every value is 0."""
    nums = [f"num_{i}" for i in range(len(cfg.numerical_fields))]
    if not nums:
        return {}
    # one global aggregate; only 2 scalars per field reach the driver
    st = corp.agg(*[F.min(c).alias(f"mn_{c}") for c in nums],
                  *[F.max(c).alias(f"mx_{c}") for c in nums],
                  F.max(F.greatest(*[F.abs(F.col(c)) for c in nums], F.lit(0.0))).alias("any_nz")).first()
    if not st["any_nz"]:
        return {}
    out = {}
    for f, c in zip(cfg.numerical_fields, nums):
        mn, mx = float(st[f"mn_{c}"]), float(st[f"mx_{c}"])
        out[f] = F.lit(0.0) if mx == mn else (F.col(c) - F.lit(mn)) / F.lit(mx - mn)
    return out


def minmax_features(corp: DataFrame, cfg: ContentConfig) -> DataFrame | None:
    """(item_id, field, value) scaled to [0,1]; None when every numeric value is 0."""
    scaled = _scaled(corp, cfg)
    if not scaled:
        return None
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in scaled.items()])
    return corp.select("item_id", F.explode(pairs).alias("x")).select("item_id", "x.field", "x.value")


def raw_features(weighted: DataFrame, cfg: ContentConfig, scaled: dict[str, Column]) -> DataFrame:
    """(item_id, f array<struct<fid, weight>>): text weights, one-hot categories and scaled
    numbers of an item side by side. An item is one row, so nothing is shuffled."""
    pair = lambda fid, w: F.struct(fid.alias("fid"), w.cast("double").alias("weight"))
    text = F.zip_with("fids", "weights", pair)
    others = [pair(_fid("c", F.concat(F.lit(f + "="), F.col(f"cat_{i}"))), F.lit(1.0))
              for i, f in enumerate(cfg.categorical_fields)]
    others += [pair(_fid("n", F.lit(f)), v) for f, v in scaled.items()]
    every = F.concat(text, F.filter(F.array(*others), lambda s: s["weight"] != 0)) if others else text
    return weighted.select("item_id", F.sort_array(every).alias("f"))


def unit_vectors(raw: DataFrame) -> DataFrame:
    """(item_id, idx, val): cosine-ready unit rows; an all-zero item keeps an empty vector
    (its cosine with anything is 0)."""
    norm = F.sqrt(F.aggregate("f", F.lit(0.0), lambda a, s: a + s["weight"] * s["weight"]))
    return raw.select("item_id", F.transform("f", lambda s: s["fid"]).alias("idx"),
                      once(norm, lambda n: F.transform("f", lambda s: s["weight"] / n)).alias("val"))


def train(items: DataFrame, cfg: ContentConfig | None = None, *, persist: bool = True) -> ContentModel:
    """M1-M7: tokens once, vocabulary from bounded tables, then one pass to unit vectors."""
    cfg = cfg or ContentConfig()
    toks = item_tokens(corpus(spread(items), cfg), cfg)
    # one job: item count and distinct values per categorical field (for M11)
    st = toks.agg(F.count(F.lit(1)).alias("n"),
                  *[F.countDistinct(f"cat_{i}").alias(f"d{i}") for i in range(len(cfg.categorical_fields))]
                  ).first()
    n_items = st["n"]
    if n_items == 0:
        raise ValueError("No items provided for training")
    vocab, counts = vocabulary(toks, cfg)
    n_vocab = vocab.count()
    scaled = _scaled(counts, cfg)
    if not n_vocab and not cfg.categorical_fields and not scaled:
        raise ValueError("No features could be extracted from items")
    raw = raw_features(tfidf(counts, vocab, n_items), cfg, scaled)
    vectors = unit_vectors(raw)
    if persist:
        vectors = vectors.cache()
    n_dims = n_vocab + sum(st[f"d{i}"] for i in range(len(cfg.categorical_fields))) + len(scaled)
    features = raw.select("item_id", F.explode("f").alias("x")).select("item_id", "x.fid", "x.weight")
    return ContentModel(cfg, vocab, features, vectors, n_items, n_dims)


def grouped(model: ContentModel) -> tuple[DataFrame, DataFrame]:
    """The items by equal feature vectors, worked out once: (sid, idx, val, size), one row a
    distinct vector, sid its smallest item; (item_id, sid, place), an item's place among the
    items of its vector by id."""
    if model.groups is None:
        vec = model.vectors.withColumn("h", F.xxhash64("idx", "val"))
        sig = materialise(vec.groupBy("h", "idx", "val").agg(F.min("item_id").alias("sid"), F.count(F.lit(1)).alias("size")),
                          "distinct")
        own = vec.join(sig.select("h", "idx", "val", "sid"), ["h", "idx", "val"]).select("item_id", "sid")
        # a vector may have very many items: places come from a range sort
        model.groups = sig.drop("h"), numbered(own, "sid", [F.col("item_id").asc()], "place")
    return model.groups


# --- M9 ------------------------------------------------------------------------

def similar_items(model: ContentModel, n: int = 10, sources: DataFrame | None = None,
                  k: int | None = None, exclude_self: bool = True) -> DataFrame:
    """M9 for every source item at once: top k (default n) by cosine, self
    excluded unless told otherwise, score > 0. Returns (item_id, rank, other_id, score).

    Items with identical feature vectors (same text, type, ...) are collapsed
    into one signature first, so the block product runs over distinct vectors
    only. Exact expansion: candidate signatures are ranked by (score desc,
    smallest member id), which is the item order among tied scores, so the
    first k + 1 signatures and the first k + 1 members of each (one slot for
    the query item itself) contain every item of the true top k.
    """
    k = k or n
    sig, members = grouped(model)
    qsig = sig if sources is None else sig.join(
        members.join(sources.select("item_id").distinct(), "item_id", "left_semi").select("sid").distinct(),
        "sid", "left_semi")
    top = top_n_dot(qsig.select(F.col("sid").alias("qid"), "idx", "val"),
                    sig.select(F.col("sid").alias("cid"), "idx", "val"),
                    k + 1, dense=False, min_score=0.0)
    first_members = members.where(F.col("place") <= k + 1)
    # per query signature: its first k + 1 candidate items in (score desc, id asc) order
    cand = (top.join(first_members.select(F.col("sid").alias("cid"), F.col("item_id").alias("other_id")), "cid")
            .select("qid", "other_id", "score", F.round("score", fixed.RANK_PLACES).alias("key")))
    cw = Window.partitionBy("qid").orderBy(F.col("key").desc(), F.col("other_id"))
    cand = cand.withColumn("cr", F.row_number().over(cw)).where(F.col("cr") <= k + 1)
    qitems = members.drop("place") if sources is None else members.drop("place").join(sources.select("item_id").distinct(),
                                                          "item_id", "left_semi")
    pairs = qitems.join(cand.withColumnRenamed("qid", "sid"), "sid")
    if exclude_self:
        pairs = pairs.where(F.col("item_id") != F.col("other_id"))
    w = Window.partitionBy("item_id").orderBy(F.col("cr"))
    return (pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("item_id", "rank", "other_id", "score"))


def similar_items_direct(model: ContentModel, n: int = 10, sources: DataFrame | None = None,
                         k: int | None = None) -> DataFrame:
    """M9 without signature collapsing (one block product over all items)."""
    q = model.vectors if sources is None else \
        model.vectors.join(sources.select("item_id").distinct(), "item_id", "left_semi")
    res = top_n_dot(q.withColumnRenamed("item_id", "qid"),
                    model.vectors.withColumnRenamed("item_id", "cid"),
                    k or n, dense=False, exclude_self=True, min_score=0.0)
    return res.select(F.col("qid").alias("item_id"), "rank", F.col("cid").alias("other_id"), "score")


# --- M10 -----------------------------------------------------------------------

def recommend_from_liked(model: ContentModel, liked: DataFrame, exclude: DataFrame | None,
                         n: int | DataFrame = 10) -> DataFrame:
    """M10 for many users at once. ``n`` is a number or a table (user_id, n).

    liked:   (user_id, item_id, n_likes) -- the liked list with multiplicity
    exclude: (user_id, item_id) pairs to drop (liked items are always dropped)
    score(u, i) = mean over liked l (with repeats, known items only) of cos(l, i)
                = profile_u . unit_i,  profile_u = sum(n_l * unit_l) / sum(n_l)
    Returns (user_id, rank, item_id, score) with score > 0.

    Users are compared with the distinct vectors only (``grouped``). With x of them holding
    an item that the user may not get, the first n + x by (score, smallest item) hold the
    user's n items: every other one before an item's own gives its smallest item. Of those,
    the ones whose betters offer n items already are left out, and each of the rest offers
    its first n items besides those that the user may not get.
    """
    vec = model.vectors
    sig, members = grouped(model)
    known = liked.join(vec.select("item_id"), "item_id", "left_semi")
    prof_rows = (known.join(vec, "item_id")
                 .select("user_id", "n_likes", F.arrays_zip("idx", "val").alias("z"))
                 .select("user_id", "n_likes", F.explode("z").alias("e")))
    denom = known.groupBy("user_id").agg(F.sum("n_likes").alias("den"))
    profile = (prof_rows.groupBy("user_id", F.col("e.idx").alias("fid"))
               .agg(F.sum(F.col("n_likes") * F.col("e.val")).alias("w"))
               .join(denom, "user_id")
               .groupBy("user_id")
               .agg(F.sort_array(F.collect_list(F.struct("fid", (F.col("w") / F.col("den")).alias("v"))))
                    .alias("p")))
    excl = liked.select("user_id", "item_id")
    if exclude is not None:
        excl = excl.unionByName(exclude.select("user_id", "item_id"))
    queries = profile.select(F.col("user_id").alias("qid"),
                             F.transform("p", lambda s: s["fid"]).alias("idx"),
                             F.transform("p", lambda s: s["v"]).alias("val"))
    excl = excl.distinct()
    lost = materialise(excl.join(members.select("item_id", "sid"), "item_id").groupBy(F.col("user_id").alias("qid"), F.col("sid").alias("cid"))
                       .agg(F.count(F.lit(1)).alias("lost")), "lost")
    asked = queries.withColumn("n", F.lit(n).cast("long")) if not isinstance(n, DataFrame) else \
        queries.join(n.select(F.col("user_id").alias("qid"), F.col("n").cast("long").alias("n")), "qid")
    more = lost.groupBy("qid").agg(F.count(F.lit(1)).alias("more"))
    asked = materialise(asked.join(more, "qid", "left").withColumn("k", F.when(F.col("n") > 0, F.col("n") + F.coalesce("more", F.lit(0)))
                                                                   .otherwise(F.lit(0))).drop("more"), "profiles")
    top = top_n_dot(asked, sig.select(F.col("sid").alias("cid"), "idx", "val"), "k", dense=False, min_score=0.0)
    by = Window.partitionBy("qid")
    found = top.join(sig.select(F.col("sid").alias("cid"), "size"), "cid").join(lost, ["qid", "cid"], "left") \
        .join(asked.select("qid", "n"), "qid") \
        .select("qid", "cid", "n", "score", F.round("score", fixed.RANK_PLACES).alias("key"), "size", F.coalesce("lost", F.lit(0)).alias("lost"))
    offer = F.col("size") - F.col("lost")
    # items offered by strictly better vectors: a running sum (ties share it) less that of the ties
    found = found.withColumn("left", F.col("n") - F.sum(offer).over(by.orderBy(F.col("key").desc())
                                                                    .rangeBetween(Window.unboundedPreceding, Window.currentRow))
                             + F.sum(offer).over(Window.partitionBy("qid", "key"))).where("left > 0")
    offered = found.select("qid", "n", "score", "key", F.col("cid").alias("sid"),
                           F.explode(F.sequence(F.lit(1).cast("long"), F.least("size", F.col("left") + F.col("lost")))).alias("place")) \
        .join(members, ["sid", "place"]) \
        .join(excl.select(F.col("user_id").alias("qid"), "item_id"), ["qid", "item_id"], "left_anti")
    return offered.withColumn("rank", F.row_number().over(by.orderBy(F.col("key").desc(), "item_id"))).where("rank <= n") \
        .select(F.col("qid").alias("user_id"), "rank", "item_id", "score")


def training_info(model: ContentModel) -> dict:
    """M11."""
    c = model.config
    return {"num_items": model.n_items, "feature_dimensions": model.n_dims,
            "text_fields": c.text_fields, "categorical_fields": c.categorical_fields,
            "numerical_fields": c.numerical_fields}
