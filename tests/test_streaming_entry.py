"""Streaming forms equal their batch forms; the driver contract holds."""

import os

import pandas as pd
from pyspark.sql import functions as F

from rankfold.operators import stats as S
from rankfold.operators import strength, validate
from rankfold.sources import views as V
from rankfold.streaming import streams
from tests.conftest import SF001


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_stream_strength_equals_batch(spark):
    batch = strength.strength_fold(validate.valid_interactions(V.interactions_raw_v(spark, SF001)))
    stream = streams.stream_strength(spark, SF001)
    assert _rows(stream, ["user_id", "item_id", "strength"]) == _rows(batch, ["user_id", "item_id", "strength"])


def test_stream_strength_many_batches(spark, tmp_dir):
    """Split the log into several files: one micro-batch per file."""
    ev = V.table(spark, SF001, "events").toPandas().sort_values("event_id")
    parts = [ev.iloc[j * len(ev) // 4:(j + 1) * len(ev) // 4] for j in range(4)]
    for j, p in enumerate(parts):
        p.to_parquet(os.path.join(tmp_dir, f"events{j}.parquet"), index=False, coerce_timestamps="us")
    stream = streams.stream_strength(spark, tmp_dir, max_files=1)
    batch = strength.strength_fold(validate.valid_interactions(V.interactions_raw_v(spark, SF001)))
    assert _rows(stream, ["user_id", "item_id", "strength"]) == _rows(batch, ["user_id", "item_id", "strength"])


def test_running_stats_equals_batch(spark):
    got = streams.running_stats(spark, SF001)
    want = S.interaction_stats(validate.valid_interactions(V.interactions_raw_v(spark, SF001)))
    key = ["kind", "type", "n"]
    as_text = lambda df: sorted(str(tuple(r[c] for c in key)) for r in df.collect())
    assert as_text(got) == as_text(want)


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["item_id", "rank", "other_id", "score"]
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 45


def test_micro_batch_ingest(spark, tmp_dir):
    """Validation, user creation before the item check, FK check, appends."""
    items_p, users_p = f"{tmp_dir}/items", f"{tmp_dir}/users"
    spark.createDataFrame([("i1",)], "item_id string").write.parquet(items_p)
    spark.createDataFrame([("u1", "{}", None, None)],
                          "user_id string, preferences string, is_active boolean, created_at timestamp_ntz") \
        .write.parquet(users_p)
    src = f"{tmp_dir}/in"
    os.makedirs(src)
    pd.DataFrame({"seq": [1, 2, 3], "user_id": ["u1", "u2", "u3"], "item_id": ["i1", "zz", "i1"],
                  "interaction_type": ["like", "view", "view"], "value": [None, None, 11.0]}) \
        .to_parquet(f"{src}/part0.parquet", index=False)
    schema = "seq long, user_id string, item_id string, interaction_type string, value double"
    stream = spark.readStream.schema(schema).parquet(src)
    fn = streams.ingest_interactions(stream, items_p, users_p, f"{tmp_dir}/out", f"{tmp_dir}/rej")
    streams.run_available_now(stream, "ingest-test", "append", fn)
    first = spark.read.parquet(f"{tmp_dir}/out").collect()
    fn(spark.read.schema(schema).parquet(src), 0)  # the epoch once more
    (row,) = spark.read.parquet(f"{tmp_dir}/out").collect()
    assert row.seq == 1 and row.interaction_id and row.timestamp is not None
    assert first == [row]  # the replay gives the same row, id and time included
    assert spark.read.parquet(users_p).count() == 2
    assert spark.read.parquet(f"{tmp_dir}/rej").count() == 2
    rej = {r.seq: r.reason for r in spark.read.parquet(f"{tmp_dir}/rej").collect()}
    assert rej == {2: "unknown item", 3: "value range"}
    assert {r.user_id for r in spark.read.parquet(users_p).collect()} == {"u1", "u2"}


def test_stream_restart(spark, tmp_dir):
    """A second run with the same base folder reads only new files and ends at the batch result."""
    ev = V.table(spark, SF001, "events").toPandas().sort_values("event_id")
    src, n = f"{tmp_dir}/src", len(ev)
    os.makedirs(src)
    for j, part in enumerate([ev.iloc[:n // 2], ev.iloc[n // 2:]]):
        part.to_parquet(f"{src}/events{j}.parquet", index=False, coerce_timestamps="us")
        stream = streams.stream_strength(spark, src, base=f"{tmp_dir}/strength")
        counts = streams.running_stats(spark, src, base=f"{tmp_dir}/stats")
    raw = validate.valid_interactions(V.interactions_raw_v(spark, SF001))
    cols = ["user_id", "item_id", "strength"]
    want = _rows(strength.strength_fold(raw), cols)
    assert _rows(stream, cols) == want
    assert _rows(streams.stream_strength(spark, src, base=f"{tmp_dir}/strength"), cols) == want
    epochs = spark.read.parquet(f"{tmp_dir}/strength/table").groupBy(streams.EPOCH).count().collect()
    assert len(epochs) == 2 and all(r["count"] <= len(want) for r in epochs)
    as_text = lambda df: sorted(str((r.kind, r.type, r.n)) for r in df.collect())
    assert as_text(counts) == as_text(S.interaction_stats(raw))


def test_versioned_table_replay_and_compaction(spark, tmp_dir):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    t = streams.VersionedTable(spark, f"{tmp_dir}/t", ["k"])
    assert t.read() is None
    t.upsert(rows(("a", 1), ("b", 1)), 0)
    for _ in range(2):
        t.upsert(rows(("a", 2), ("c", 2)), 1)
    again = streams.VersionedTable(spark, f"{tmp_dir}/t", ["k"])
    assert _rows(again.read(), ["k", "v"]) == [("a", 2), ("b", 1), ("c", 2)]
    assert _rows(again.read(before=1), ["k", "v"]) == [("a", 1), ("b", 1)]
    small = again.compact(f"{tmp_dir}/t2", 1)
    small.upsert(rows(("b", 3)), 2)
    assert _rows(small.read(), ["k", "v"]) == [("a", 2), ("b", 3), ("c", 2)]


def test_versioned_refresh(spark, tmp_dir):
    """Users with new interactions get their stored rows replaced."""
    t = streams.VersionedTable(spark, f"{tmp_dir}/recs", ["user_id"])
    t.upsert(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "user_id string, rank int, item_id string"), 0)
    fn = streams.refresh_recommendations(
        t, lambda users: users.select("user_id", F.lit(1).alias("rank"), F.lit("new").alias("item_id")))
    fn(spark.createDataFrame([("a",), ("a",)], "user_id string"), 1)
    assert sorted((r.user_id, r.item_id) for r in t.read().collect()) == [("a", "new"), ("b", "y")]


def test_item_ingest_first_wins_and_updates(spark, tmp_dir):
    """R2: new ids inserted (first wins inside a batch), known ids updated."""
    src = f"{tmp_dir}/items_in"
    os.makedirs(src)
    cols = ["item_id", "title", "item_type", "description", "features", "metadata", "seq"]
    pd.DataFrame([["a", "A", "book", "d", "{}", "{}", 1], ["a", "A-dup", "book", "d", "{}", "{}", 2],
                  ["b", "B", "song", "d", "{}", "{}", 3]], columns=cols).to_parquet(f"{src}/p0.parquet", index=False)
    pd.DataFrame([["a", "A-new", "book", "d", "{}", "{}", 4], ["c", "C", "movie", "d", "{}", "{}", 5]],
                 columns=cols).to_parquet(f"{src}/p1.parquet", index=False)
    schema = ("item_id string, title string, item_type string, description string, features string, "
              "metadata string, seq long")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    table = streams.VersionedTable(spark, f"{tmp_dir}/items", ["item_id"])
    fn = streams.ingest_items(table)
    streams.run_available_now(stream, "items-ingest", "append", fn)
    fn(spark.read.schema(schema).parquet(f"{src}/p1.parquet"), 1)  # the epoch once more
    got = {r.item_id: r.title for r in table.read().collect()}
    assert got == {"a": "A-new", "b": "B", "c": "C"}


def test_import_files_csv(spark, tmp_dir):
    from rankfold.sources import files
    from rankfold.sources.importer import import_files
    with open(f"{tmp_dir}/items.csv", "w") as f:
        f.write("item_id,title,item_type,description,features,metadata\nx,X,book,,{},{}\n")
    with open(f"{tmp_dir}/users.csv", "w") as f:
        f.write("user_id,preferences\nu,{}\n")
    with open(f"{tmp_dir}/interactions.csv", "w") as f:
        f.write("user_id,item_id,interaction_type,value,timestamp\nu,x,like,,\nv,x,view,,\n")
    empty = files.Dataset(
        spark.createDataFrame([], "item_id string, title string, item_type string, description string, "
                                  "features string, metadata string"),
        spark.createDataFrame([], "user_id string, preferences string"),
        spark.createDataFrame([], "seq long, user_id string, item_id string, interaction_type string, "
                                  "value double, timestamp timestamp_ntz"))
    res = import_files(empty, "csv", f"{tmp_dir}/items.csv", f"{tmp_dir}/users.csv", f"{tmp_dir}/interactions.csv")
    stats = {r.entity: (r.imported, r.skipped) for r in res.stats.collect()}
    assert stats == {"items": (1, 0), "users": (1, 0), "interactions": (2, 0), "users_auto_created": (1, 0)}
