"""Structured Streaming forms of the continuous operators.

Sources are file streams (any folder or glob of Parquet files); every query
checkpoints in shared storage. A query that is given a ``base`` folder keeps its
checkpoint and its table there and resumes after a restart; without one it runs
once, in a fresh folder under ``spark.checkpoint.dir``. Sinks write one folder per
micro-batch and overwrite it when the micro-batch is replayed, so a replay leaves
the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.operators import changes, validate
from rankfold.operators.strength import strength_aggregates
from rankfold.session import checkpoint_dir
from rankfold.sources import views as V
from rankfold.sources.files import _exists

EPOCH = "epoch_id"


def _path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex[:10]}"


def events_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """``events`` as a file stream (schema taken from the batch table)."""
    glob = f"{sf_dir.rstrip('/')}/events*.parquet"
    schema = spark.read.parquet(glob).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(glob)


def run_available_now(df: DataFrame, name: str, mode: str, batch_fn: Callable | None = None,
                      out_path: str | None = None, state_partitions: int | None = None,
                      checkpoint: str | None = None) -> str:
    """Run a stream to the end of its current input (availableNow trigger); with a
    ``checkpoint`` folder, from where the last run stopped.

    The number of state-store partitions is fixed when a stateful query first
    starts (and kept in its checkpoint); it is sized here to the cluster
    (2 x default parallelism unless given) instead of inheriting the batch
    shuffle setting."""
    spark = df.sparkSession
    parts = state_partitions or 2 * spark.sparkContext.defaultParallelism
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or _path(spark, f"{name}-ckpt")) \
            .trigger(availableNow=True)
        if batch_fn is not None:
            q = w.foreachBatch(batch_fn).start()
        else:
            q = w.format("parquet").option("path", out_path).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return out_path or ""


def write_epoch(batch: DataFrame, path: str, epoch: int) -> None:
    """Write a micro-batch to its own folder of a Parquet table (column ``epoch_id``)."""
    batch.write.mode("overwrite").parquet(f"{path}/{EPOCH}={epoch}")


def epoch_time(spark: SparkSession, path: str, epoch: int):
    """The time at which an epoch was first begun, written down before its rows, so that a
    replay stamps the same one."""
    at = f"{path.rstrip('/')}-times/{EPOCH}={epoch}"
    if not _exists(spark, f"{at}/*.parquet"):
        spark.range(1).select(F.current_timestamp().cast("timestamp_ntz").alias("at")).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at).first()["at"]


class VersionedTable:
    """A keyed table maintained by micro-batches. Each one adds its rows as an epoch
    of the table at ``path``; the rows of a key are those of the last epoch that has
    the key. Writing an epoch costs what it holds; reading merges all epochs, and the
    table's state is nowhere but in its folder. ``compact`` writes the current rows
    as one epoch of another folder, to go on from there."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def upsert(self, batch: DataFrame, epoch: int) -> None:
        write_epoch(batch, self.path, epoch)

    def read(self, before: int | None = None) -> DataFrame | None:
        """Current rows, or those before an epoch (None: the table has no epoch yet)."""
        if not _exists(self.spark, f"{self.path}/{EPOCH}=*/*.parquet"):
            return None
        rows = self.spark.read.parquet(self.path)
        if before is not None:
            rows = rows.where(F.col(EPOCH) < before)
        last = rows.groupBy(*self.keys).agg(F.max(EPOCH).alias(EPOCH))
        return rows.join(last, [*self.keys, EPOCH], "left_semi").drop(EPOCH)

    def compact(self, path: str, epoch: int) -> VersionedTable:
        """The table up to ``epoch``, written as that epoch of the folder ``path``."""
        out = VersionedTable(self.spark, path, self.keys)
        rows = self.read(before=epoch + 1)
        if rows is not None:
            out.upsert(rows, epoch)
        return out


# --- R3: running statistics ----------------------------------------------------------------

def running_stats(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """Interaction counts by type, maintained by a streaming aggregation
    (complete mode: at most 7 rows of state); total added on read."""
    inter = validate.valid_interactions(V.interactions_from_events(events_stream(spark, sf_dir)))
    agg = inter.groupBy("interaction_type").agg(F.count(F.lit(1)).alias("n"))
    base = base or _path(spark, "running-stats")
    table = VersionedTable(spark, f"{base}/table", ["interaction_type"])
    run_available_now(agg, "running-stats", "complete", table.upsert, checkpoint=f"{base}/checkpoint")
    res = table.read()
    total = res.agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("type"), "n")
    return (res.select(F.col("interaction_type").alias("type"), "n").unionByName(total)
            .select(F.lit("interactions").alias("kind"), "type", F.col("n").cast("long").alias("n")))


# --- R4: running strength ----------------------------------------------------------------------

def stream_strength(spark: SparkSession, sf_dir: str, max_files: int | None = None,
                    base: str | None = None) -> DataFrame:
    """The strength fold as a streaming aggregation. Its buffers are max()
    values (last rating, last sequence per weight class), so the state per
    (user, item) is a few numbers and any split of the log into micro-batches
    gives the batch result; updated pairs are upserted per micro-batch."""
    inter = validate.valid_interactions(V.interactions_from_events(events_stream(spark, sf_dir, max_files)))
    aggs, strength = strength_aggregates("seq")
    agg = inter.groupBy("user_id", "item_id").agg(*aggs) \
        .select("user_id", "item_id", strength.alias("strength"))
    base = base or _path(spark, "strength")
    table = VersionedTable(spark, f"{base}/table", ["user_id", "item_id"])
    run_available_now(agg, "strength", "update", table.upsert, checkpoint=f"{base}/checkpoint")
    return table.read()


# --- R1 / R2 / R7: micro-batch ingest and refresh -------------------------------------------------

def ingest_interactions(stream: DataFrame, items_path: str, users_path: str, out_path: str,
                        rejects_path: str) -> Callable[[DataFrame, int], None]:
    """R1 batch function: validate (V3), create unknown users (U3, before the
    item check), foreign-key check (J1), write accepted rows (stamped with an id and
    a default timestamp, U7) and rejected rows as an epoch of their tables. Users
    that exist are not created again, ids derive from the table, the epoch and ``seq``,
    and times from when the epoch first began, so a replayed epoch changes nothing."""
    def fn(batch: DataFrame, epoch: int):
        spark = batch.sparkSession
        if "timestamp" not in batch.columns:
            batch = batch.withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))
        items = spark.read.parquet(items_path)
        users = spark.read.parquet(users_path)
        now = F.lit(epoch_time(spark, out_path, epoch)).cast("timestamp_ntz")
        ok, bad = validate.split(batch, validate.interaction_rules())
        new_users = changes.get_or_create_users(users, ok, now).where("created").drop("created")
        new_users.write.mode("append").parquet(users_path)
        unknown = changes.check_items(ok, items)[1]
        write_epoch(changes.record_interactions(ok, items, now, F.lit(f"{out_path}#{epoch}")), out_path, epoch)
        write_epoch(bad.unionByName(unknown.withColumn("reason", F.lit("unknown item"))), rejects_path, epoch)
    return fn


def ingest_items(table: VersionedTable, seq: str = "seq") -> Callable[[DataFrame, int], None]:
    """R2 batch function: first insert wins (U1); rows of known ids are partial
    updates (U4). Known is what the epochs before hold, so a replay decides alike."""
    def fn(batch: DataFrame, epoch: int):
        ok, _ = validate.split(batch, validate.item_rules())
        cur = table.read(before=epoch)
        if cur is None:
            first, _ = changes.first_wins(ok, "item_id", seq)
            table.upsert(first.drop(seq), epoch)
            return
        fresh = ok.join(cur.select("item_id"), "item_id", "left_anti")
        first, _ = changes.first_wins(fresh, "item_id", seq)
        touched = cur.join(ok.select("item_id"), "item_id", "left_semi")
        upd = ok.join(cur.select("item_id"), "item_id", "left_semi")
        table.upsert(changes.update_items(touched, upd).unionByName(first.drop(seq).select(*cur.columns)), epoch)
    return fn


def refresh_recommendations(table: VersionedTable, recompute: Callable[[DataFrame], DataFrame]):
    """R7 batch function: users with new interactions get their stored rows
    recomputed and replaced (keyed upsert by user)."""
    def fn(batch: DataFrame, epoch: int):
        users = batch.select("user_id").distinct()
        table.upsert(recompute(users), epoch)
    return fn
