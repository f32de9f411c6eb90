"""Projections, filters and lookups (P1-P17, T4, W3), set-based.

Single-id lookups of the reference become joins with a DataFrame of request
ids, so one job answers every request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold.functions.scalar import json_object_or_empty
from rankfold.operators.numbering import numbered


def active(df: DataFrame) -> DataFrame:
    """P10: soft-deleted rows hidden (tables without the flag are all active)."""
    return df.where(F.coalesce(F.col("is_active"), F.lit(True))) if "is_active" in df.columns else df


def by_ids(table: DataFrame, key: str, requests: DataFrame) -> DataFrame:
    """Rows for requested ids.

    requests: (request_id, pos, <key>) -- repeats kept, unknown ids skipped
    (inner join); the request order is the ``pos`` column (no global sort)."""
    return requests.join(table, key)


def exists(table: DataFrame, key: str, requests: DataFrame) -> DataFrame:
    """Requests whose id exists (left-semi; ignores is_active)."""
    return requests.join(table.select(key), key, "left_semi")


def page(table: DataFrame, order: list, offset: int = 0, limit: int = 100,
         where=None, include_inactive: bool = False) -> DataFrame:
    """Filter (inactive rows go unless asked for), total order, offset +
    limit (a top-k, not a full sort)."""
    df = table if include_inactive else active(table)
    df = df if where is None else df.where(where)
    return df.orderBy(*order).offset(offset).limit(limit)


def newest_per_key(df: DataFrame, key: str, limit: int, ts: str = "timestamp",
                   tie: str = "seq") -> DataFrame:
    """P6 / P14 / W3 for many keys: newest ``limit`` rows per key. Catalyst
    plans the rank filter as a window group limit, so each task keeps at most
    ``limit`` rows per key before the window."""
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)


def full_history(df: DataFrame, key: str, ts: str = "timestamp", tie: str = "seq") -> DataFrame:
    """P7 / W3 without a limit: all rows per key, newest first, numbered in ``rn``. A hot
    key is spread over as many tasks as its rows need."""
    return numbered(df, key, [F.col(ts).desc(), F.col(tie).desc()])


def user_interactions(interactions: DataFrame, types: list[str] | None = None) -> DataFrame:
    """P6 filter part: a user's interactions, optional type list."""
    return interactions if not types else interactions.where(F.col("interaction_type").isin(types))


def _records(df: DataFrame, columns: list[str], json_columns: list[str]) -> DataFrame:
    return df.select(*[json_object_or_empty(F.col(c)).alias(c) if c in json_columns else F.col(c)
                       for c in columns if c in df.columns])


# Rows as records, null JSON -> '{}'; columns that a table does not have are left out

def item_records(items: DataFrame) -> DataFrame:
    return _records(items, ["item_id", "title", "item_type", "description", "features", "metadata", "is_active",
                            "created_at", "updated_at"], ["features", "metadata"])


def user_records(users: DataFrame) -> DataFrame:
    return _records(users, ["user_id", "preferences", "is_active", "created_at", "last_active_at"], ["preferences"])


def interaction_records(interactions: DataFrame) -> DataFrame:
    return _records(interactions, ["interaction_id", "seq", "user_id", "item_id", "interaction_type", "value", "context",
                                   "timestamp", "created_at"], ["context"])


def artifact_records(artifacts: DataFrame) -> DataFrame:
    return _records(artifacts, ["model_name", "model_version", "model_type", "artifact_path", "hyperparameters", "metrics",
                                "item_count", "user_count", "interaction_count", "is_active", "trained_at"],
                    ["hyperparameters", "metrics"])
