"""Stored results kept right (S19, U10, R7): what to compute again, and nothing else.

A stored result is one row: (result_key, user_id, strategy, item_ids array<string>,
computed_at, expires_at). The inverted index (item_id -> result_key) over the stored
lists, at most 100 items each, says which rows show an item. A row is to be computed
again for the first of these reasons that holds: it has expired, a model that its
strategy uses was trained after it, its user has a later interaction, or an item that it
shows has changed after it. Every test is an equi-join with a "later than" condition on
rows that are aggregated to one per key first, so a hot user or item is one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold import fixed
from rankfold.operators.heavy import materialise

#: strategy -> models whose training makes its results stale
MODELS_OF = {"content_based": ["content"], "collaborative": ["collaborative"], "hybrid": ["content", "collaborative"]}
REASONS = ["expired", "trained", "interaction", "item"]


def index(stored: DataFrame) -> DataFrame:
    """(item_id, result_key): the stored lists that show an item."""
    return stored.select(F.explode("item_ids").alias("item_id"), "result_key").distinct()


def stale(stored: DataFrame, now: Column, interactions: DataFrame | None = None, changed_items: DataFrame | None = None,
          trainings: DataFrame | None = None) -> DataFrame:
    """(result_key, reason) of the rows to compute again.

    interactions:  (user_id, timestamp); changed_items: (item_id, changed_at), inserted,
    updated and deleted ones alike; trainings: (model, trained_at)."""
    rows = stored.select("result_key", "user_id", "strategy", "computed_at", "expires_at")
    found = [rows.where(F.col("expires_at") <= now).select("result_key", F.lit(0).alias("r"))]
    if trainings is not None:
        uses = F.create_map(*[x for s, m in MODELS_OF.items() for x in (F.lit(s), F.array(*map(F.lit, m)))])
        last = trainings.groupBy("model").agg(F.max("trained_at").alias("at"))
        found.append(rows.select("result_key", "computed_at", F.explode(F.element_at(uses, F.col("strategy"))).alias("model"))
                     .join(F.broadcast(last.where(F.col("model").isin(["content", "collaborative"]))), "model")  # two rows
                     .where("at > computed_at").select("result_key", F.lit(1).alias("r")))
    if interactions is not None:
        last = interactions.groupBy("user_id").agg(F.max("timestamp").alias("at"))
        found.append(rows.join(last, "user_id").where("at > computed_at").select("result_key", F.lit(2).alias("r")))
    if changed_items is not None:
        last = changed_items.groupBy("item_id").agg(F.max("changed_at").alias("at"))
        # an item shown twice has the same latest change: no need to tell its rows apart
        latest = stored.select(F.explode("item_ids").alias("item_id"), "result_key").join(last, "item_id").groupBy("result_key").agg(F.max("at").alias("at"))
        found.append(rows.join(latest, "result_key").where("at > computed_at").select("result_key", F.lit(3).alias("r")))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    names = F.array(*map(F.lit, REASONS))
    return every.groupBy("result_key").agg(F.min("r").alias("r")) \
        .select("result_key", F.element_at(names, F.col("r") + 1).alias("reason"))


def get_or_compute(requests: DataFrame, stored: DataFrame, compute: Callable[[DataFrame], DataFrame], now: Column,
                   ttl_s: int = fixed.RESULT_TTL_S, **changes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(answers, new stored table). ``requests`` (result_key, user_id, strategy, ...) that
    have a stored row which is not stale are served from it; for the others, and only for
    them, ``compute`` gives (result_key, item_ids). ``hit`` tells which is which. Stored
    rows that nobody asked for stay, stale ones too (they are found stale again)."""
    stored = materialise(stored, "stored")  # read several times below, mostly without the lists
    bad = stale(stored, now, **changes)
    good = stored.join(bad.select("result_key"), "result_key", "left_anti")
    asked = requests.dropDuplicates(["result_key"])
    hits = good.join(asked.select("result_key"), "result_key", "left_semi")
    missing = asked.join(good.select("result_key"), "result_key", "left_anti")
    fresh = missing.join(compute(missing), "result_key").select(
        "result_key", "user_id", "strategy", "item_ids", now.alias("computed_at"),
        (now + F.make_interval(secs=F.lit(ttl_s))).alias("expires_at"))
    answers = hits.withColumn("hit", F.lit(True)).unionByName(fresh.withColumn("hit", F.lit(False)))
    kept = stored.join(missing.select("result_key"), "result_key", "left_anti")
    return answers, kept.unionByName(fresh)
