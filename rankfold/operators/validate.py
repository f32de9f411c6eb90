"""Row validation (V1-V4): split a batch into accepted and rejected rows.

Each rule is a boolean column; the first failing rule names the rejection
reason. Null-safe: a rule that evaluates to null counts as failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold import fixed
from rankfold.functions.scalar import is_json_object


def _len_between(c: str, lo: int, hi: int) -> Column:
    return F.length(F.col(c)).between(lo, hi)


def item_rules() -> list[tuple[str, Column]]:
    """V1."""
    return [
        ("item_id length", _len_between("item_id", 1, fixed.ID_MAX_LEN)),
        ("title length", _len_between("title", 1, fixed.TITLE_MAX_LEN)),
        ("item_type", F.col("item_type").isin(fixed.ITEM_TYPES)),
        ("description length", F.col("description").isNull()
         | (F.length("description") <= fixed.DESCRIPTION_MAX_LEN)),
        ("features object", is_json_object(F.col("features"))),
        ("metadata object", is_json_object(F.col("metadata"))),
    ]


def user_rules() -> list[tuple[str, Column]]:
    """V2."""
    return [
        ("user_id length", _len_between("user_id", 1, fixed.ID_MAX_LEN)),
        ("preferences object", is_json_object(F.col("preferences"))),
    ]


def interaction_rules() -> list[tuple[str, Column]]:
    """V3 + V4."""
    return [
        ("user_id length", _len_between("user_id", 1, fixed.ID_MAX_LEN)),
        ("item_id length", _len_between("item_id", 1, fixed.ID_MAX_LEN)),
        ("interaction_type", F.col("interaction_type").isin(fixed.INTERACTION_TYPES)),
        ("value range", F.col("value").isNull()
         | F.col("value").between(fixed.VALUE_MIN, fixed.VALUE_MAX)),
        ("rating needs value", ~((F.col("interaction_type") == "rating") & F.col("value").isNull())),
    ]


def reason_column(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first failing rule, null when every rule holds."""
    expr = None
    for name, cond in rules:
        failed = ~F.coalesce(cond, F.lit(False))
        expr = F.when(failed, F.lit(name)) if expr is None else expr.when(failed, F.lit(name))
    return expr.otherwise(F.lit(None).cast("string"))


def split(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Return (accepted, rejected); rejected carries a ``reason`` column.

    Both sides are filters of the same scan; Catalyst pushes the conjunction
    down where the source supports it.
    """
    ok = None
    for _, cond in rules:
        c = F.coalesce(cond, F.lit(False))
        ok = c if ok is None else ok & c
    accepted = df.where(ok)
    rejected = df.where(~ok).withColumn("reason", reason_column(rules))
    return accepted, rejected


def valid_interactions(df: DataFrame) -> DataFrame:
    return split(df, interaction_rules())[0]


def rejected_interactions(df: DataFrame) -> DataFrame:
    return split(df, interaction_rules())[1]
