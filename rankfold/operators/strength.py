"""Interaction strength fold.

The reference folds the log row by row per (user, item), starting at 0: a
rating with a value *sets* value / 10, any other row sets max(current, weight).

Closed form used here: let ``lr`` be the last rating-with-value of the pair.
Then strength = greatest(base, weights of non-rating rows after ``lr``) with
base = value_at(lr) / 10, or 0 when there is no such rating.

Because the weights take only a handful of distinct values, "the largest
weight after lr" needs just the last sequence number seen per weight class.
So the whole fold is ONE hash aggregate keyed by (user, item) whose buffers
are max() values: it combines map-side (partial aggregation), so a hot
(user, item) pair or a hot user never lands whole in one task, and it needs no
window, no sort and no ordered UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold import fixed
from rankfold.functions.scalar import interaction_weight, rating_norm


def _weight_classes() -> list[float]:
    return sorted(set(fixed.INTERACTION_WEIGHTS.values()) | {fixed.DEFAULT_WEIGHT})


def strength_aggregates(seq: str = "seq") -> tuple[list[Column], Column]:
    """Aggregate expressions and the final strength expression over them."""
    is_rated = (F.col("interaction_type") == "rating") & F.col("value").isNotNull()
    weight = interaction_weight(F.col("interaction_type"))
    rated_seq = F.when(is_rated, F.col(seq))
    # fixed-width buffers (long, double): planned as a hash aggregate
    aggs = [F.max(rated_seq).alias("_lr_s"), F.max_by(F.col("value"), rated_seq).alias("_lr_v")]
    classes = _weight_classes()
    for i, w in enumerate(classes):
        aggs.append(F.max(F.when(~is_rated & (weight == F.lit(w)), F.col(seq))).alias(f"_w{i}"))
    lr_seq = F.col("_lr_s")
    base = F.coalesce(rating_norm(F.col("_lr_v")), F.lit(0.0))
    after = [F.when(F.col(f"_w{i}") > F.coalesce(lr_seq, F.lit(-(2 ** 63))), F.lit(float(w)))
             for i, w in enumerate(classes)]
    strength = F.greatest(base, *after).cast("double")
    return aggs, strength


def strength_fold(interactions: DataFrame, items: DataFrame | None = None,
                  users: DataFrame | None = None, seq: str = "seq") -> DataFrame:
    """(user_id, item_id, strength) for every pair with interactions.

    ``items`` / ``users`` restrict the fold to known ids (J6, left-semi).
    Rows are ordered by ``seq`` (arrival order).
    """
    df = interactions.select("user_id", "item_id", "interaction_type", "value", seq)
    if items is not None:
        df = df.join(items.select("item_id"), "item_id", "left_semi")
    if users is not None:
        df = df.join(users.select("user_id"), "user_id", "left_semi")
    aggs, strength = strength_aggregates(seq)
    return (df.groupBy("user_id", "item_id").agg(*aggs)
              .select("user_id", "item_id", strength.alias("strength")))


def liked_items(interactions: DataFrame) -> DataFrame:
    """Positive signals per user with multiplicity (``n_likes``)."""
    pos = (F.col("interaction_type").isin(fixed.POSITIVE_TYPES)
           | ((F.col("interaction_type") == "rating") & (F.col("value") >= fixed.HIGH_RATING)))
    return (interactions.where(pos)
            .groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n_likes")))


def touched_items(interactions: DataFrame) -> DataFrame:
    """Distinct (user, item) pairs, any type."""
    return interactions.select("user_id", "item_id").distinct()
