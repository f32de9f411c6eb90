"""Change application over tables.

Tables are immutable DataFrames; a change returns the new table (and the
rejected rows). Callers persist the result by writing a new table version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(batch: DataFrame, key: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """(first row per key by ``seq``, later duplicates).

    The winner is a ``min_by`` aggregate (combined map-side), so an id
    repeated across a large share of the batch never gathers in one task; the
    losers are the rows whose (key, seq) is not a winner's (an anti join on a
    unique pair, so no skewed key either)."""
    cols = [c for c in batch.columns if c != key]
    win = (batch.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(seq)).alias("_w"))
           .select(key, *[F.col(f"_w.{c}").alias(c) for c in cols]))
    losers = batch.join(win.select(key, seq), [key, seq], "left_anti")
    return win.select(*batch.columns), losers


def insert_new(table: DataFrame, batch: DataFrame, key: str, seq: str,
               now=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Insert rows whose id is absent; conflicts are rejected.

    Returns (new table, inserted rows, rejected rows with reason)."""
    now = now if now is not None else F.current_timestamp().cast("timestamp_ntz")
    first, dups = first_wins(batch, key, seq)
    fresh = first.join(table.select(key), key, "left_anti")
    clash = first.join(table.select(key), key, "left_semi")
    stamped = fresh
    for c in ("created_at", "updated_at"):
        if c in table.columns and c not in stamped.columns:
            stamped = stamped.withColumn(c, now)
    if "is_active" in table.columns and "is_active" not in stamped.columns:
        stamped = stamped.withColumn("is_active", F.lit(True))
    inserted = stamped.select(*table.columns)
    rejected = (dups.withColumn("reason", F.lit("duplicate in batch"))
                .unionByName(clash.withColumn("reason", F.lit("already exists"))))
    return table.unionByName(inserted), inserted, rejected


def get_or_create_users(users: DataFrame, interactions: DataFrame, now=None) -> DataFrame:
    """Users plus every interaction user not yet known (created with '{}'),
    taken before the item check, so a rejected interaction still creates its user.
    Adds ``created`` = true for new rows."""
    now = now if now is not None else F.current_timestamp().cast("timestamp_ntz")
    new = (interactions.select("user_id").distinct()
           .join(users.select("user_id"), "user_id", "left_anti"))
    cols = [c for c in users.columns if c != "user_id"]
    fill = {"preferences": F.lit("{}"), "created_at": now, "is_active": F.lit(True)}
    new_rows = new.select("user_id", *[fill.get(c, F.lit(None)).cast(dict(users.dtypes)[c]).alias(c)
                                       for c in cols])
    return (users.withColumn("created", F.lit(False))
            .unionByName(new_rows.withColumn("created", F.lit(True))))


def check_items(interactions: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(interactions with a known item, interactions with an unknown item)."""
    ids = items.select("item_id")
    return (interactions.join(ids, "item_id", "left_semi"),
            interactions.join(ids, "item_id", "left_anti"))


def derived_id(*parts) -> Column:
    """An id in the form of a UUID that the same parts always give."""
    h = F.md5(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in cuts])


def record_interactions(interactions: DataFrame, items: DataFrame, now=None, source=None) -> DataFrame:
    """Stamp id and default timestamp on accepted rows. With ``source`` (a column or
    text naming where the rows come from) ids derive from it and ``seq``, so the same rows
    get the same ids again; without, they are random."""
    now = now if now is not None else F.current_timestamp().cast("timestamp_ntz")
    ok, _ = check_items(interactions, items)
    name = F.expr("uuid()") if source is None else derived_id(
        source if isinstance(source, Column) else F.lit(source), F.col("seq"))
    return ok.select("*", name.alias("interaction_id"), now.alias("created_at")).withColumn(
        "timestamp", F.coalesce(F.col("timestamp"), now))


def update_items(items: DataFrame, updates: DataFrame, now=None) -> DataFrame:
    """U4: given non-null fields replace, a null never clears, JSON replaced whole.
    Multiple updates of one id apply in ``seq`` order (the last non-null wins)."""
    now = now if now is not None else F.current_timestamp().cast("timestamp_ntz")
    fields = [c for c in ("title", "description", "features", "metadata") if c in updates.columns]
    if "seq" in updates.columns:
        agg = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields]
        upd = updates.groupBy("item_id").agg(*agg)
    else:
        upd = updates.select("item_id", *fields)
    u = upd.select("item_id", *[F.col(c).alias(f"_u_{c}") for c in fields], F.lit(True).alias("_hit"))
    j = items.join(u, "item_id", "left")
    out = []
    for c in items.columns:
        if c in fields:
            out.append(F.coalesce(F.col(f"_u_{c}"), F.col(c)).alias(c))
        elif c == "updated_at":
            out.append(F.when(F.col("_hit"), now).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def delete_items(items: DataFrame, ids: DataFrame, interactions: DataFrame | None = None,
                 hard: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Soft delete (is_active = false) or hard delete with cascade."""
    if hard:
        kept = items.join(ids.select("item_id"), "item_id", "left_anti")
        inter = None if interactions is None else interactions.join(ids.select("item_id"), "item_id", "left_anti")
        return kept, inter
    hit = ids.select("item_id").distinct().withColumn("_del", F.lit(True))
    base = items if "is_active" in items.columns else items.withColumn("is_active", F.lit(True))
    out = base.join(hit, "item_id", "left").withColumn(
        "is_active", F.when(F.col("_del"), F.lit(False)).otherwise(F.col("is_active"))).drop("_del")
    return out.select(*base.columns), interactions


def touch_last_active(users: DataFrame, interactions: DataFrame) -> DataFrame:
    """U8: last_active_at = latest interaction time per user."""
    last = interactions.groupBy("user_id").agg(F.max("timestamp").alias("_last"))
    j = users.join(last, "user_id", "left")
    prev = F.col("last_active_at") if "last_active_at" in users.columns else F.lit(None).cast("timestamp_ntz")
    return j.withColumn("last_active_at", F.greatest(prev, F.col("_last"))).drop("_last")


def activate_model(artifacts: DataFrame, name: str, version: str) -> DataFrame:
    """Only (name, version) active for ``name``; unknown version -> none active."""
    same = F.col("model_name") == F.lit(name)
    return artifacts.withColumn(
        "is_active",
        F.when(same, F.col("model_version") == F.lit(version)).otherwise(F.col("is_active")))


def stale_users(stored: DataFrame, interactions: DataFrame) -> DataFrame:
    """Users whose stored results predate one of their interactions."""
    last = stored.groupBy("user_id").agg(F.min("computed_at").alias("computed_at"))
    newer = interactions.join(last, "user_id").where(F.col("timestamp") > F.col("computed_at"))
    return newer.select("user_id").distinct()
