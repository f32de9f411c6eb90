"""Mixed serving requests in one plan.

A request is a row: (request_id, user_id, item_id, strategy, n, exclude_interacted,
item_type, filters). Rows of every kind are answered together: requests of one user
that need the same candidates share them (a user who asks a third of all requests is
ranked once per kind), both sources are asked once with the number of candidates that
each request needs, and answers go back to their requests by a join.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold import fixed
from rankfold.functions import jsonfields as J
from rankfold.functions.scalar import clip01, is_json_object, rank_score
from rankfold.operators import blend as B
from rankfold.operators import collab as K
from rankfold.operators import content as C
from rankfold.operators import strength, validate
from rankfold.operators.blockdot import top_n_dot
from rankfold.operators.heavy import materialise

REQUEST = ("request_id string, user_id string, item_id string, strategy string, n int, "
           "exclude_interacted boolean, item_type string, filters string")
RESULT = "key string, route string, rank int, item_id string, score double, explanation string"


def checked(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected with a reason). Empty ids count as none; without a strategy a request
    is hybrid, without the flag it excludes what the user touched, without n it asks for 10."""
    r = requests.select(
        "request_id", F.nullif("user_id", F.lit("")).alias("user_id"), F.nullif("item_id", F.lit("")).alias("item_id"),
        F.coalesce("strategy", F.lit("hybrid")).alias("strategy"), F.coalesce("n", F.lit(10)).alias("n"),
        F.coalesce("exclude_interacted", F.lit(True)).alias("exclude_interacted"), "item_type", "filters")
    return validate.split(r, [
        ("Either user_id or item_id must be provided", F.col("user_id").isNotNull() | F.col("item_id").isNotNull()),
        ("strategy", F.col("strategy").isin(list(fixed.STRATEGIES))),
        ("n", F.col("n").between(1, fixed.MAX_RECOMMENDATIONS)),
        ("item_type", F.col("item_type").isNull() | F.col("item_type").isin(list(fixed.ITEM_TYPES))),
        ("filters", F.col("filters").isNull() | is_json_object(F.col("filters")))])


def _key(first: str, *others: Column) -> Column:
    return F.concat_ws("|", *[o.cast("string") for o in others], F.col(first))


def _similar(model: C.ContentModel | None, kmodel: K.CollabModel | None, keys: DataFrame) -> DataFrame | None:
    """M21 per (key, item_id, n): content 2n, collaborative 2n (new ids only, discounted), top n."""
    itself = keys.select(F.col("key").alias("qid"), F.col("item_id").alias("cid"))
    parts = []

    def told(top: DataFrame, src: int, factor: float, explanation: str) -> DataFrame:
        return top.select("key", "item_id", (F.col("score") * factor).alias("score"),
                          F.lit(src).alias("src"), F.col("rank").alias("src_rank"), F.lit(explanation).alias("explanation"))

    most = keys.agg(F.max("n")).first()[0]
    if model is not None:
        # an item's list is ranked once, as long as the longest that is asked for
        near = C.similar_items(model, k=fixed.SIMILAR_OVERFETCH * (most or 1), sources=keys)
        found = keys.select("key", "item_id", "n").join(near, "item_id").where(F.col("rank") <= fixed.SIMILAR_OVERFETCH * F.col("n")) \
            .select("key", F.col("other_id").alias("item_id"), "score", "rank")
        parts.append(told(found, 0, 1.0, fixed.EXPLAIN_SIMILAR_CONTENT))
    if kmodel is not None:
        unit = kmodel.item_factors.select("item_id", K._unit(F.col("f")).alias("val")).where("val is not null")
        q = keys.join(unit, "item_id").select(F.col("key").alias("qid"), "val", (fixed.SIMILAR_OVERFETCH * F.col("n")).alias("k"))
        top = top_n_dot(q, unit.select(F.col("item_id").alias("cid"), "val"), "k", dense=True, min_score=0.0, exclude=itself)
        k = told(top.select(F.col("qid").alias("key"), F.col("cid").alias("item_id"), "score", "rank"), 1,
                 fixed.COLLAB_NEIGHBOUR_DISCOUNT, fixed.EXPLAIN_USERS_ALSO_LIKED)
        parts.append(k.join(parts[0].select("key", "item_id"), ["key", "item_id"], "left_anti") if parts else k)
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return B._rank(every.join(keys.select("key", "n"), "key"), "key", "n", [rank_score(F.col("score")).desc(), "src", "src_rank"]) \
        .select("key", F.lit("similar").alias("route"), "rank", "item_id", "score", "explanation")


def _newest(items: DataFrame, good: DataFrame, touched: DataFrame) -> DataFrame:
    """M26 per request: the newest n items (of the type, if one is asked), touched ones left
    out, score 0.5. At most 100 items a type and 100 of all reach the tasks."""
    newest = [F.col("created_at").desc(), F.col("item_id")]
    most = fixed.MAX_RECOMMENDATIONS
    typed = items.select("item_type", "item_id", F.row_number().over(Window.partitionBy("item_type").orderBy(*newest)).alias("pos")) \
        .where(F.col("pos") <= most)
    every = items.orderBy(*newest).limit(most).select(F.lit(None).cast("string").alias("item_type"), "item_id",
                                                      F.row_number().over(Window.orderBy(*newest)).alias("pos"))
    listed = typed.unionByName(every).withColumnRenamed("item_type", "_type")
    asked = good.select("request_id", "user_id", "n", "exclude_interacted", F.col("item_type").alias("_want"))
    rows = asked.join(F.broadcast(listed), F.col("_want").eqNullSafe(F.col("_type")) & (F.col("pos") <= F.col("n")))
    mine = asked.where("exclude_interacted").join(touched, "user_id").select("request_id", "item_id")
    rows = rows.join(mine, ["request_id", "item_id"], "left_anti")
    return B._rank(rows, "request_id", "n", ["pos"]).select(
        "request_id", "rank", "item_id", F.lit(fixed.FALLBACK_SCORE).alias("score"), F.lit(fixed.EXPLAIN_FALLBACK).alias("explanation"))


def answer(requests: DataFrame, cmodel: C.ContentModel | None, kmodel: K.CollabModel | None, items: DataFrame,
           interactions: DataFrame, weights: B.Weights = B.Weights()) -> tuple[DataFrame, DataFrame]:
    """(answers, rejected requests). Answers: (request_id, strategy, rank, item_id, title,
    item_type, score, explanation, metadata, total_candidates), one row per item.

    A request without a user asks for items similar to its item; one with a user goes to its
    strategy; without any trained model all get the newest items. Then, per request: the
    type and the filters (a JSON object; every field must equal ``metadata[k] or
    features[k]``), the count of what passed, the items' data (items that are gone drop
    out), scores cut to 0..1."""
    good, bad = checked(requests)
    good = materialise(good, "requests")
    touched = strength.touched_items(interactions)
    if cmodel is None and kmodel is None:
        ranked = _newest(items, good, touched)
    else:
        users = good.where("user_id is not null")
        over = F.when(F.col("strategy") == "hybrid", fixed.BLEND_OVERFETCH * F.col("n")).otherwise(F.col("n"))
        users = users.withColumn("k", over).withColumn("key", _key("user_id", F.col("exclude_interacted"), F.col("k")))
        keys = materialise(users.select("key", "user_id", "exclude_interacted", "k").distinct(), "keys")
        of = lambda strategy: users.where(F.col("strategy").isin("hybrid", strategy)).select("key").distinct()
        exclude = keys.where("exclude_interacted").join(touched, "user_id").select(F.col("key").alias("user_id"), "item_id")
        liked = keys.join(strength.liked_items(interactions), "user_id").select(F.col("key").alias("user_id"), "item_id", "n_likes")
        limits = keys.select(F.col("key").alias("user_id"), F.col("k").alias("n"))

        def content_leg() -> DataFrame:
            mine = of("content_based").select(F.col("key").alias("user_id"))
            return materialise(C.recommend_from_liked(cmodel, liked.join(mine, "user_id", "left_semi"), exclude, limits), "content")

        def collab_leg() -> DataFrame:
            mine = keys.join(of("collaborative"), "key", "left_semi")
            factors = mine.join(kmodel.user_factors, "user_id").select(F.col("key").alias("user_id"), "f")
            return materialise(K.recommend(replace(kmodel, user_factors=factors), mine.select(F.col("key").alias("user_id")),
                                           exclude, limits), "collab")

        items_asked = good.where("user_id is null").select("item_id", "n").distinct() \
            .withColumn("key", _key("item_id", F.col("n")))
        with ThreadPoolExecutor(max_workers=3) as pool:  # the legs' jobs overlap
            legs = [pool.submit(f) if model is not None else None for f, model in ((content_leg, cmodel), (collab_leg, kmodel))]
            near = pool.submit(_similar, cmodel, kmodel, items_asked)
            c, k = [f.result() if f is not None else None for f in legs]
            results = near.result()
        hybrid = users.where("strategy = 'hybrid'").select(F.col("key").alias("user_id"), "n").distinct()
        cs = c.select("user_id", "item_id", F.col("score").alias("cs"), F.col("rank").alias("cr")) if c is not None else None
        ks = k.select("user_id", "item_id", F.col("score").alias("ks"), F.col("rank").alias("kr")) if k is not None else None
        n_liked = liked.groupBy("user_id").agg(F.sum("n_likes").alias("n_liked"))
        both = B.blend_legs(cs, ks, n_liked, weights).join(hybrid, "user_id")
        results = results.unionByName(B._rank(both, "user_id", "n", B.blend_order()).select(
            F.col("user_id").alias("key"), F.lit("hybrid").alias("route"), "rank", "item_id", "score", "explanation"))
        for rows, route, words in ((c, "content_based", fixed.EXPLAIN_CONTENT), (k, "collaborative", fixed.EXPLAIN_COLLAB)):
            if rows is not None:
                results = results.unionByName(rows.select(F.col("user_id").alias("key"), F.lit(route).alias("route"), "rank",
                                                          "item_id", "score", F.lit(words).alias("explanation")))
        asked = users.select("request_id", "key", F.col("strategy").alias("route")).unionByName(
            good.where("user_id is null").select("request_id", _key("item_id", F.col("n")).alias("key"), F.lit("similar").alias("route")))
        ranked = asked.join(results, ["key", "route"]).select("request_id", "rank", "item_id", "score", "explanation")
    return _finish(ranked, good, items), bad


def _finish(ranked: DataFrame, good: DataFrame, items: DataFrame) -> DataFrame:
    wanted = good.select("request_id", "strategy", F.col("item_type").alias("_type"), "filters")
    there = items.select("item_id", "title", "item_type", "features", "metadata", F.lit(True).alias("_there"))
    rows = ranked.join(wanted, "request_id").join(there, "item_id", "left")
    narrowed = F.col("_type").isNotNull() | F.col("filters").isNotNull()
    fits = F.col("_there") & (F.col("_type").isNull() | (F.col("item_type") == F.col("_type"))) & \
        J.matches(F.col("filters"), F.col("metadata"), F.col("features"))
    rows = rows.where(~narrowed | F.coalesce(fits, F.lit(False)))
    w = Window.partitionBy("request_id")  # at most 100 rows
    rows = rows.withColumn("total_candidates", F.count(F.lit(1)).over(w)).where("_there")
    return rows.withColumn("rank", F.row_number().over(w.orderBy("rank"))).select(
        "request_id", "strategy", "rank", "item_id", "title", "item_type", clip01(F.col("score")).alias("score"),
        "explanation", "metadata", "total_candidates")
