"""Full import with counts (S9, S10, A14) as set operations.

Order of the reference: items, then users, then interactions.
  items:        first-wins inside the batch, existing ids skipped
  users:        same rule
  interactions: user auto-created (U3, before the item check), unknown item
                skipped; duplicates are fine (interaction ids are fresh)
Rows dropped by the loader's validation are not counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.operators import changes
from rankfold.sources.files import Dataset, load_csv, load_json


@dataclass
class ImportResult:
    items: DataFrame
    users: DataFrame
    interactions: DataFrame
    stats: DataFrame   # (entity, imported, skipped)


def import_dataset(store: Dataset, batch: Dataset, skip_errors: bool = True, source: str = "import") -> ImportResult:
    """``source`` names the batch: ids of its interactions derive from it and their ``seq``."""
    items, new_items, rej_items = _insert(store.items, batch.items, "item_id")
    if not skip_errors and rej_items.limit(1).count() > 0:
        raise ValueError("item conflict during import")
    users, new_users, rej_users = _insert(store.users, batch.users, "user_id")
    inter_in = batch.interactions
    users_all = changes.get_or_create_users(users, inter_in)
    auto = users_all.where("created").drop("created")
    users = users_all.drop("created")
    bad = changes.check_items(inter_in, items)[1]
    ok = changes.record_interactions(inter_in, items, source=source)
    interactions = store.interactions.unionByName(ok, allowMissingColumns=True)
    stats = (_counts("items", new_items, rej_items)
             .unionByName(_counts("users", new_users, rej_users))
             .unionByName(_counts("interactions", ok, bad))
             .unionByName(_counts("users_auto_created", auto, None)))
    return ImportResult(items, users, interactions, stats)


def _insert(table: DataFrame, batch: DataFrame, key: str):
    b = batch.withColumnRenamed("seq", "_seq")
    cols = [c for c in table.columns if c in b.columns] + ["_seq"]
    return changes.insert_new(table, b.select(*cols), key, "_seq")


def _counts(entity: str, acc: DataFrame, rej: DataFrame | None) -> DataFrame:
    """One aggregate per side over a flag column (union, then group)."""
    a = acc.select(F.lit(1).alias("ok"))
    if rej is not None:
        a = a.unionByName(rej.select(F.lit(0).alias("ok")))
    return a.agg(F.coalesce(F.sum("ok"), F.lit(0)).cast("long").alias("imported"),
                 F.coalesce(F.sum(1 - F.col("ok")), F.lit(0)).cast("long").alias("skipped")) \
        .select(F.lit(entity).alias("entity"), "imported", "skipped")


def import_files(store: Dataset, fmt: str, items_path=None, users_path=None, interactions_path=None,
                 skip_errors: bool = True) -> ImportResult:
    """CSV or JSON convenience import chosen by ``fmt``."""
    spark = store.items.sparkSession
    if fmt == "csv":
        batch = load_csv(spark, items_path, users_path, interactions_path)
    elif fmt == "json":
        batch = load_json(spark, items_path, users_path, interactions_path)
    else:
        raise ValueError(f"unknown format {fmt}")
    return import_dataset(store, batch, skip_errors)
