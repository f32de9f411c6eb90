"""Readers (S1-S8, S11): CSV, JSON (array or lines), Parquet, JDBC.

Text files are read as records that any split size cuts and numbers alike
(``sources.records``): ``seq`` is the arrival order, dense from 0, over all files in
order of name. No schema inference: cells are parsed with try_* functions and rows are
split into accepted and rejected ones (with a ``reason``) by what cannot be parsed and
by the validation rules. A source yields a ``Dataset`` triple of DataFrames.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankfold.functions.scalar import bad_double, bad_ts, parse_double, parse_ts
from rankfold.operators import lookup, validate
from rankfold.sources import records

ITEM_COLUMNS = ["item_id", "title", "item_type", "description", "features", "metadata"]
USER_COLUMNS = ["user_id", "preferences"]
INTERACTION_COLUMNS = ["user_id", "item_id", "interaction_type", "value", "timestamp"]


@dataclass
class Dataset:
    """What every loader yields. ``*_rejected`` carry a ``reason``."""
    items: DataFrame
    users: DataFrame
    interactions: DataFrame
    items_rejected: DataFrame | None = None
    users_rejected: DataFrame | None = None
    interactions_rejected: DataFrame | None = None


def _strings(cols: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in cols])


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names a file, asked of the file system that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _empty(spark: SparkSession, cols: list[str]) -> DataFrame:
    return spark.createDataFrame([], T.StructType([*_strings(cols), T.StructField("seq", T.LongType())]))


def _csv_rows(spark: SparkSession, path: str | None, cols: list[str], json_cols: list[str]) -> DataFrame:
    """Cells as text, by the header of their own file; JSON columns that it does not have
    are '{}', others null."""
    if not path or not _exists(spark, path):
        return _empty(spark, cols)
    rows = records.read(spark, path, "csv")
    options = {"escape": '"', "quote": '"', "mode": "PERMISSIVE"}
    heads: dict[str, list[str]] = {}
    for r in rows.where("first").select("file", "text").collect():  # one row a file
        heads.setdefault(r["text"].rstrip("\r"), []).append(r["file"])
    out = None
    for head, files in heads.items():
        names = [c.strip("\ufeff") for c in next(csv.reader([head]))]
        body = rows.where(~F.col("first"))
        body = body if len(heads) == 1 else body.where(F.col("file").isin(files))
        cell = F.from_csv("text", ", ".join(f"_c{i} string" for i in range(len(names))), options)
        at = {c: f"_c{i}" for i, c in enumerate(names)}
        body = body.select("seq", cell.alias("c"))
        part = body.select(*[
            F.col(f"c.{at[c]}").alias(c) if c in at else F.lit("{}" if c in json_cols else None).cast("string").alias(c)
            for c in cols], "seq")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else _empty(spark, cols)


def load_csv(spark: SparkSession, items_path: str | None = None, users_path: str | None = None,
             interactions_path: str | None = None) -> Dataset:
    """CSV files; a missing file yields no rows. An absent JSON column reads as '{}',
    an empty cell in one is invalid. Numbers and times that are there but cannot be parsed
    reject their row; empty ones are null."""
    items = _csv_rows(spark, items_path, ITEM_COLUMNS, ["features", "metadata"])
    users = _csv_rows(spark, users_path, USER_COLUMNS, ["preferences"])
    inter = _csv_rows(spark, interactions_path, INTERACTION_COLUMNS, [])
    inter = inter.withColumn("_bad_value", bad_double(F.col("value"))).withColumn("_bad_time", bad_ts(F.col("timestamp"))) \
        .withColumn("value", parse_double(F.col("value"))).withColumn("timestamp", parse_ts(F.col("timestamp")))
    return _split(items, users, inter)


def _split(items: DataFrame, users: DataFrame, inter: DataFrame) -> Dataset:
    out = []
    for df, cols, rules in ((items, ITEM_COLUMNS, validate.item_rules()), (users, USER_COLUMNS, validate.user_rules()),
                            (inter, INTERACTION_COLUMNS, validate.interaction_rules())):
        marks = [c for c in df.columns if c.startswith("_bad_")]
        parsed = [(c.removeprefix("_bad_") + " not readable", ~F.col(c)) for c in marks]
        good, bad = validate.split(df.select(*cols, "seq", *marks), parsed + rules)
        out.append((good.drop(*marks), bad.drop(*marks)))
    (ia, ir), (ua, ur), (xa, xr) = out
    return Dataset(ia, ua, xa, ir, ur, xr)


def _json_rows(spark: SparkSession, path: str | None, cols: list[str], json_cols: list[str]) -> DataFrame:
    """Fields of every object. A record that is no object, or a text field that holds
    another type, is marked unreadable; ``features`` and the like keep their JSON text, an
    absent one is '{}' and an explicit null stays null (invalid)."""
    if not path or not _exists(spark, path):
        return _empty(spark, cols)
    v = records.read(spark, path, "json").select("seq", F.try_parse_json("text").alias("v"))
    field = lambda c: F.try_variant_get("v", f"$.{c}", "variant")
    kind = lambda c: F.schema_of_variant(field(c))

    def text(c: str) -> Column:
        return F.when(kind(c) == "STRING", F.try_variant_get("v", f"$.{c}", "string"))

    out, bad = ["seq"], {"object": F.coalesce(~F.schema_of_variant("v").startswith("OBJECT"), F.lit(True))}
    there = lambda c: F.coalesce(kind(c) != "VOID", F.lit(False))
    for c in cols:
        if c in json_cols:
            value = F.when(field(c).isNull(), F.lit("{}")).when(there(c), F.to_json(field(c)))
        elif c == "value":
            value = F.when(kind(c) == "STRING", parse_double(text(c))).otherwise(F.try_variant_get("v", "$.value", "double"))
            bad["value"] = there(c) & value.isNull()
        elif c == "timestamp":
            # what counts as false is no time; another type than text is unreadable
            value = parse_ts(text(c))
            zero = F.coalesce(F.try_variant_get("v", "$.timestamp", "double") == 0, F.lit(False))
            bad["time"] = F.when(kind(c) == "STRING", bad_ts(text(c))).otherwise(there(c) & ~zero)
        else:
            value = text(c)
            bad[c] = there(c) & value.isNull()
        out.append(value.alias(c))
    return v.select(*out, *[F.coalesce(b, F.lit(False)).alias(f"_bad_{c}") for c, b in bad.items()])


def load_json(spark: SparkSession, items_path: str | None = None, users_path: str | None = None,
              interactions_path: str | None = None) -> Dataset:
    """A JSON array of objects or one object after another (JSON Lines), told apart
    by nothing: both are objects with something between them.

    Nested objects (features, metadata, preferences) are kept as JSON text; an explicit
    null there is invalid, an absent key defaults to '{}'. An object that cannot be parsed
    is rejected alone."""
    items = _json_rows(spark, items_path, ITEM_COLUMNS, ["features", "metadata"])
    users = _json_rows(spark, users_path, USER_COLUMNS, ["preferences"])
    inter = _json_rows(spark, interactions_path, INTERACTION_COLUMNS, [])
    if "_bad_value" not in inter.columns:
        inter = inter.withColumn("value", F.lit(None).cast("double")) \
            .withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))
    return _split(items, users, inter)


def load_export_dir(spark: SparkSession, export_dir: str) -> Dataset:
    """Items.json, users.json, interactions.json under one folder."""
    d = export_dir.rstrip("/")
    return load_json(spark, f"{d}/items.json", f"{d}/users.json", f"{d}/interactions.json")


def load_parquet(spark: SparkSession, base: str, active_only: bool = True) -> Dataset:
    """The store's own tables (items/, users/, interactions/) as Parquet; active rows
    only unless asked otherwise (the filter reaches the scan)."""
    b = base.rstrip("/")
    tables = [spark.read.parquet(f"{b}/{t}") for t in ("items", "users", "interactions")]
    return Dataset(*[lookup.active(t) if active_only else t for t in tables])


def load_jdbc(spark: SparkSession, url: str, properties: dict, active_only: bool = True,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int | None = None) -> Dataset:
    """S11 over JDBC: the three training scans, active rows only; an optional
    numeric partition column splits each scan across tasks."""
    def read(tbl):
        kw = {}
        if partition_column and num_partitions:
            kw = dict(column=partition_column, lowerBound=lower, upperBound=upper,
                      numPartitions=num_partitions)
        df = spark.read.jdbc(url, tbl, properties=properties, **kw)
        if active_only and "is_active" in df.columns:
            df = df.where(F.col("is_active"))
        return df
    return Dataset(read("items"), read("users"), read("interactions"))
