"""Blending and serving.

Every function answers a whole set of users or items in one job. Result
rows: (user_id | item_id, rank, item_id | other_id, score, explanation).
Ordering everywhere: score rounded to 9 places desc, then source order
(content before collaborative, as in a stable sort of the concatenated
lists), then rank inside the source.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold import fixed
from rankfold.functions import jsonfields as J
from rankfold.functions.scalar import clip01, rank_score
from rankfold.operators import collab as K
from rankfold.operators import content as C
from rankfold.operators.heavy import materialise


@dataclass(frozen=True)
class Weights:
    """How the two sources are blended; the ``cold`` pair counts for users with fewer
    liked entries than ``cold_start_threshold``."""
    content_weight: float = fixed.CONTENT_WEIGHT
    collaborative_weight: float = fixed.COLLAB_WEIGHT
    cold_start_threshold: int = fixed.COLD_START_THRESHOLD
    cold_content_weight: float = fixed.COLD_START_CONTENT_WEIGHT
    cold_collaborative_weight: float = fixed.COLD_START_COLLAB_WEIGHT

    def config(self) -> dict:
        return asdict(self)

    @classmethod
    def of(cls, config: dict) -> Weights:
        """From a saved configuration; what it does not name keeps its default."""
        return cls(**{f.name: config[f.name] for f in fields(cls) if f.name in config})


def _rank(df: DataFrame, key: str, n: int | str, order) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= (F.col(n) if isinstance(n, str) else n))


# --- M21 --------------------------------------------------------------------------

def similar_items(cmodel: C.ContentModel | None, kmodel: K.CollabModel | None, n: int,
                  sources: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Similar items from both sources: content 2n, collaborative 2n (new ids only,
    x 0.8), merged, top n. Pairs (item_id, other_id) of ``exclude`` are taken out of
    both lists before they are merged (so fewer than n may remain).
    Returns (item_id, rank, other_id, score, explanation)."""
    parts = []
    with ThreadPoolExecutor(max_workers=2) as pool:  # overlap the two legs' eager steps
        fc = pool.submit(C.similar_items, cmodel, n, sources, fixed.SIMILAR_OVERFETCH * n) \
            if cmodel is not None else None
        fk = pool.submit(K.similar, kmodel.item_factors, "item_id", fixed.SIMILAR_OVERFETCH * n, sources) \
            if kmodel is not None else None
        c_res = fc.result() if fc else None
        k_res = fk.result() if fk else None
    if cmodel is not None:
        c = c_res
        parts.append(c.select("item_id", "other_id", "score", F.lit(0).alias("src"),
                              F.col("rank").alias("src_rank"),
                              F.lit(fixed.EXPLAIN_SIMILAR_CONTENT).alias("explanation")))
    if kmodel is not None:
        k = k_res.select("item_id", "other_id", (F.col("score") * fixed.COLLAB_NEIGHBOUR_DISCOUNT).alias("score"),
                     F.lit(1).alias("src"), F.col("rank").alias("src_rank"),
                     F.lit(fixed.EXPLAIN_USERS_ALSO_LIKED).alias("explanation"))
        if parts:
            k = k.join(parts[0].select("item_id", "other_id"), ["item_id", "other_id"], "left_anti")  # J4
        parts.append(k)
    if not parts:
        raise RuntimeError("no trained model")
    allc = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if exclude is not None:
        allc = allc.join(exclude.select("item_id", "other_id"), ["item_id", "other_id"], "left_anti")
    return _rank(allc, "item_id", n, [rank_score(F.col("score")).desc(), "src", "src_rank"]) \
        .select("item_id", "rank", "other_id", "score", "explanation")


# --- M22 / M23 / M24 -----------------------------------------------------------------

def content_leg(cmodel: C.ContentModel, liked: DataFrame, exclude: DataFrame | None, n: int) -> DataFrame:
    return C.recommend_from_liked(cmodel, liked, exclude, n)


def collab_leg(kmodel: K.CollabModel, users: DataFrame, exclude: DataFrame | None, n: int) -> DataFrame:
    return K.recommend(kmodel, users, exclude, n)


def recommend_content(cmodel, liked, exclude, n):
    """M22."""
    return content_leg(cmodel, liked, exclude, n).withColumn("explanation", F.lit(fixed.EXPLAIN_CONTENT))


def recommend_collab(kmodel, users, exclude, n):
    """M23."""
    return collab_leg(kmodel, users, exclude, n).withColumn("explanation", F.lit(fixed.EXPLAIN_COLLAB))


def recommend_hybrid(cmodel: C.ContentModel | None, kmodel: K.CollabModel | None, users: DataFrame,
                     liked: DataFrame, exclude: DataFrame | None, n: int,
                     weights: Weights = Weights()) -> DataFrame:
    """3n from each source, full outer join by item, weighted sum.

    Weights .4/.6, or .8/.2 when the liked list (with repeats) has fewer than 5
    entries, unless given. Returns (user_id, rank, item_id, score, explanation)."""
    us = users.select("user_id").distinct()
    if kmodel is None:
        return _hybrid(cmodel, None, us, liked, exclude, n, weights)
    # users without likes, exclusions and factors all get one list: it is made once
    own = liked.select("user_id").unionByName(kmodel.user_factors.select("user_id"))
    if exclude is not None:
        own = own.unionByName(exclude.select("user_id"))
    own = own.distinct()
    alike = materialise(us.join(own, "user_id", "left_anti"), "alike")
    one = alike.first()
    if one is None:
        return _hybrid(cmodel, kmodel, us, liked, exclude, n, weights)
    ranked = _hybrid(cmodel, kmodel, materialise(us.join(own, "user_id", "left_semi"), "users"), liked, exclude, n, weights)
    any_of = alike.sparkSession.createDataFrame([(one["user_id"],)], "user_id string")
    same = materialise(_hybrid(None, kmodel, any_of, liked.limit(0), None, n, weights).drop("user_id"), "one-list")
    return ranked.unionByName(alike.crossJoin(F.broadcast(same)).select(ranked.columns))  # at most n rows are broadcast


def _hybrid(cmodel, kmodel, us: DataFrame, liked: DataFrame, exclude: DataFrame | None, n: int, weights: Weights) -> DataFrame:
    m = fixed.BLEND_OVERFETCH * n
    n_liked = liked.groupBy("user_id").agg(F.sum("n_likes").alias("n_liked"))
    # the legs' eager steps (block sizing, materialised query sides) are
    # submitted from two driver threads so their jobs overlap
    tasks = []
    if cmodel is not None:
        tasks.append(lambda: content_leg(cmodel, liked.join(us, "user_id", "left_semi"), exclude, m)
                     .select("user_id", "item_id", F.col("score").alias("cs"), F.col("rank").alias("cr")))
    if kmodel is not None:
        tasks.append(lambda: collab_leg(kmodel, us, exclude, m)
                     .select("user_id", "item_id", F.col("score").alias("ks"), F.col("rank").alias("kr")))
    with ThreadPoolExecutor(max_workers=2) as pool:
        legs = [f.result() for f in [pool.submit(t) for t in tasks]]
    if not legs:
        raise RuntimeError("no trained model")
    by = iter(legs)
    j = blend_legs(next(by) if cmodel is not None else None, next(by) if kmodel is not None else None, n_liked, weights)
    return _rank(j, "user_id", n, blend_order()).select("user_id", "rank", "item_id", "score", "explanation")


def blend_legs(content: DataFrame | None, collab: DataFrame | None, n_liked: DataFrame, weights: Weights) -> DataFrame:
    """(user_id, item_id, score, explanation, src, src_rank): content rows (user_id, item_id,
    cs, cr) and collaborative rows (user_id, item_id, ks, kr) of each user and item blended."""
    if content is not None and collab is not None:
        j = content.join(collab, ["user_id", "item_id"], "full_outer")  # J3
    elif content is not None:
        j = content.withColumn("ks", F.lit(None).cast("double")).withColumn("kr", F.lit(None).cast("int"))
    else:
        j = collab.withColumn("cs", F.lit(None).cast("double")).withColumn("cr", F.lit(None).cast("int"))
    j = j.join(n_liked, "user_id", "left")
    cold = F.coalesce(F.col("n_liked"), F.lit(0)) < weights.cold_start_threshold
    wc = F.when(cold, F.lit(weights.cold_content_weight)).otherwise(F.lit(weights.content_weight))
    wk = F.when(cold, F.lit(weights.cold_collaborative_weight)).otherwise(F.lit(weights.collaborative_weight))
    score = wc * F.coalesce(F.col("cs"), F.lit(0.0)) + wk * F.coalesce(F.col("ks"), F.lit(0.0))
    expl = (F.when(F.col("cs").isNotNull() & F.col("ks").isNotNull(), F.lit(fixed.EXPLAIN_BOTH))
             .when(F.col("cs").isNotNull(), F.lit(fixed.EXPLAIN_CONTENT))
             .otherwise(F.lit(fixed.EXPLAIN_COLLAB)))
    return j.select("user_id", "item_id", score.alias("score"), expl.alias("explanation"),
                    F.when(F.col("cs").isNotNull(), 0).otherwise(1).alias("src"),
                    F.coalesce(F.col("cr"), F.col("kr")).alias("src_rank"))


def blend_order() -> list:
    """Score, then source (content first), then the rank in the source."""
    return [rank_score(F.col("score")).desc(), F.col("src"), F.col("src_rank")]


# --- M26 ------------------------------------------------------------------------------

def fallback(items: DataFrame, users: DataFrame, exclude: DataFrame | None, n: int,
             item_type: str | None = None) -> DataFrame:
    """Newest n items (optional type), touched ones removed, score 0.5.

    The newest list is at most n rows: computed once by a top-k, pulled to the
    driver (bounded) and attached to every user as a literal array."""
    src = items if item_type is None else items.where(F.col("item_type") == item_type)
    newest = (src.orderBy(F.col("created_at").desc(), F.col("item_id")).limit(n)
              .select("item_id").collect())
    arr = F.array(*[F.struct(F.lit(i + 1).alias("pos"), F.lit(r["item_id"]).alias("item_id"))
                    for i, r in enumerate(newest)]) if newest else F.array().cast(
        "array<struct<pos:int,item_id:string>>")
    per_user = users.select("user_id").distinct().select("user_id", F.explode(arr).alias("e")) \
        .select("user_id", F.col("e.pos").alias("pos"), F.col("e.item_id").alias("item_id"))
    if exclude is not None:
        per_user = per_user.join(exclude.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return _rank(per_user, "user_id", n, ["pos"]).select(
        "user_id", "rank", "item_id", F.lit(fixed.FALLBACK_SCORE).alias("score"),
        F.lit(fixed.EXPLAIN_FALLBACK).alias("explanation"))


# --- M25: filters, cut, enrichment, clamp ------------------------------------------------

def serve(results: DataFrame, items: DataFrame, n: int, item_type: str | None = None,
          filters: dict | None = None) -> DataFrame:
    """P13 + T7 + J5 + F1 over ranked results (user_id, rank, item_id, score, explanation).

    Filters run after the top n (so fewer than n rows may remain);
    ``total_candidates`` counts what passes them; then rows whose item no longer
    exists are dropped and scores are clamped to [0, 1]."""
    it = items.select("item_id", "title", "item_type", "features", "metadata", F.lit(True).alias("_there"))
    if item_type or filters:
        cond = F.lit(True)
        if item_type:
            cond = cond & (F.col("item_type") == item_type)
        for k, v in (filters or {}).items():
            cond = cond & J.equals_value(J.first_truthy(F.col("metadata"), F.col("features"), k), v)
        # each item is tried once; results whose item is gone pass no filter
        r = results.join(it.where(cond), "item_id")
    else:
        r = results.join(it, "item_id", "left")
    r = r.withColumn("total_candidates", F.count(F.lit(1)).over(Window.partitionBy("user_id"))).where("_there")  # J5
    w = Window.partitionBy("user_id").orderBy("rank")
    return (r.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("user_id", "rank", "item_id", "title", "item_type",
                    clip01(F.col("score")).alias("score"), "explanation", "metadata", "total_candidates"))


# --- M27 ------------------------------------------------------------------------------

def train_models(items: DataFrame, strengths: DataFrame, strategy: str = "hybrid",
                 item_types: list[str] | None = None, content_config=None):
    """Train content, collaborative or both. One failing does not stop the
    other: the result holds the model (or None) and an error text per model.
    ``item_types`` restricts the content model only (P11)."""
    out = {"content": None, "collaborative": None, "errors": {}}
    if strategy in ("content_based", "hybrid"):
        try:
            src = items if not item_types else items.where(F.col("item_type").isin(item_types))
            out["content"] = C.train(src, content_config)
        except Exception as e:  # noqa: BLE001 - reported per model
            out["errors"]["content"] = str(e)
    if strategy in ("collaborative", "hybrid"):
        try:
            out["collaborative"] = K.train(strengths)
        except Exception as e:  # noqa: BLE001
            out["errors"]["collaborative"] = str(e)
    return out


# --- M20 / M28 ----------------------------------------------------------------------------

def dispatch(cmodel, kmodel, n: int, strategy: str = "hybrid", users: DataFrame | None = None,
             items: DataFrame | None = None, liked: DataFrame | None = None,
             exclude: DataFrame | None = None, weights: Weights = Weights()) -> DataFrame:
    """Item requests without a user go to similar items (M21); user
    requests go to the strategy's operator (M22 / M23 / M24). Untrained
    sources are skipped; nothing trained -> error (``requests.answer`` falls back, M26)."""
    if strategy not in fixed.STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if users is None:
        if items is None:
            raise ValueError("Either user_id or item_id must be provided")
        return similar_items(cmodel, kmodel, n, items)
    if strategy == "content_based":
        if cmodel is None or liked is None:
            return users.sparkSession.createDataFrame(
                [], "user_id string, rank int, item_id string, score double, explanation string")
        return recommend_content(cmodel, liked.join(users.select("user_id"), "user_id", "left_semi"),
                                 exclude, n)
    if strategy == "collaborative":
        if kmodel is None:
            return users.sparkSession.createDataFrame(
                [], "user_id string, rank int, item_id string, score double, explanation string")
        return recommend_collab(kmodel, users, exclude, n)
    return recommend_hybrid(cmodel, kmodel, users, liked, exclude, n, weights)


def training_info(cmodel, kmodel, content_weight: float = fixed.CONTENT_WEIGHT,
                  collab_weight: float = fixed.COLLAB_WEIGHT) -> dict:
    """Both models' training info plus the blend weights."""
    return {"content_model": C.training_info(cmodel) if cmodel is not None else None,
            "collaborative_model": dict(kmodel.info) if kmodel is not None else None,
            "weights": {"content": content_weight, "collaborative": collab_weight},
            "is_content_trained": cmodel is not None, "is_collaborative_trained": kmodel is not None}
