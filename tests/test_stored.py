"""Stored results: what a change makes stale, and computing only that."""

import datetime as dt

from pyspark.sql import functions as F

from rankfold.operators import changes, stored

T = dt.datetime(2024, 5, 1)
ROWS = "result_key string, user_id string, strategy string, item_ids array<string>, computed_at timestamp_ntz, expires_at timestamp_ntz"


def hour(n):
    return T + dt.timedelta(hours=n)


def table(spark):
    return spark.createDataFrame([
        ("h", "u1", "hybrid", ["a", "b"], hour(1), hour(9)), ("c", "u1", "content_based", ["b"], hour(3), hour(9)),
        ("k", "u2", "collaborative", ["c"], hour(1), hour(9)), ("old", "u3", "hybrid", ["a"], hour(0), hour(2)),
        ("none", "u4", "hybrid", [], hour(5), hour(9))], ROWS)


def now(n):
    return F.lit(hour(n)).cast("timestamp_ntz")


def reasons(df):
    return {r.result_key: r.reason for r in df.collect()}


def test_each_change_marks_exactly_its_rows(spark):
    s = table(spark)
    log = lambda *r: spark.createDataFrame(list(r), "user_id string, timestamp timestamp_ntz")
    moved = lambda *r: spark.createDataFrame(list(r), "item_id string, changed_at timestamp_ntz")
    trained = lambda *r: spark.createDataFrame(list(r), "model string, trained_at timestamp_ntz")
    assert reasons(stored.stale(s, now(1))) == {}
    assert reasons(stored.stale(s, now(2))) == {"old": "expired"}
    assert reasons(stored.stale(s, now(1), interactions=log(("u1", hour(2)), ("u1", hour(1)), ("u9", hour(5))))) == {"h": "interaction"}
    assert reasons(stored.stale(s, now(1), changed_items=moved(("b", hour(2)), ("b", hour(4)), ("zz", hour(5))))) == {"h": "item", "c": "item"}
    assert reasons(stored.stale(s, now(1), trainings=trained(("content", hour(2))))) == {"h": "trained", "old": "trained"}
    assert reasons(stored.stale(s, now(1), trainings=trained(("collaborative", hour(4)), ("content", hour(1))))) == {
        "h": "trained", "k": "trained", "old": "trained"}
    assert reasons(stored.stale(s, now(2), log(("u1", hour(8)), ("u3", hour(8))), moved(("c", hour(8))), trained(("content", hour(2))))) == {
        "old": "expired", "h": "trained", "c": "interaction", "k": "item"}
    assert {(r.item_id, r.result_key) for r in stored.index(s).collect()} == {("a", "h"), ("b", "h"), ("b", "c"), ("c", "k"), ("a", "old")}


def test_only_what_is_missing_or_stale_is_computed(spark):
    asked = spark.createDataFrame([("h", "u1", "hybrid"), ("c", "u1", "content_based"), ("new", "u7", "hybrid"), ("new", "u7", "hybrid")],
                                  "result_key string, user_id string, strategy string")
    computed = []

    def compute(missing):
        computed.extend(sorted(r.result_key for r in missing.collect()))
        return missing.select("result_key", F.array(F.lit("x")).alias("item_ids"))

    moved = spark.createDataFrame([("a", hour(2))], "item_id string, changed_at timestamp_ntz")
    answers, after = stored.get_or_compute(asked, table(spark), compute, now(2), ttl_s=60, changed_items=moved)
    assert computed == ["h", "new"]
    got = {r.result_key: (r.hit, r.item_ids) for r in answers.collect()}
    assert got == {"c": (True, ["b"]), "h": (False, ["x"]), "new": (False, ["x"])}
    rows = {r.result_key: r for r in after.collect()}
    assert set(rows) == {"h", "c", "k", "old", "none", "new"}
    assert rows["h"].computed_at == hour(2) and rows["h"].expires_at == hour(2) + dt.timedelta(seconds=60)
    assert rows["new"].user_id == "u7" and rows["old"].item_ids == ["a"]
    again, _ = stored.get_or_compute(asked, after, compute, now(2), changed_items=moved)
    assert computed == ["h", "new"] and all(r.hit for r in again.collect())


def test_derived_ids(spark):
    items = spark.createDataFrame([("i",)], "item_id string")
    x = spark.createDataFrame([(1, "u", "i", None), (2, "u", "i", None), (3, "u", "zz", None)],
                              "seq long, user_id string, item_id string, timestamp timestamp_ntz")
    one = [tuple(r) for r in changes.record_interactions(x, items, now(1), "a").orderBy("seq").collect()]
    two = [tuple(r) for r in changes.record_interactions(x.repartition(3), items, now(1), F.lit("a")).orderBy("seq").collect()]
    other = changes.record_interactions(x, items, now(1), "b").collect()
    assert one == two and len(one) == 2
    ids = {r[-2] for r in one} | {r.interaction_id for r in other}
    assert len(ids) == 4 and all(len(i) == 36 for i in ids)


def test_stored_lists_are_built_once(spark):
    rows = spark.createDataFrame([(1, "u", "i1"), (1, "u", "i2"), (2, "v", "i1")], "result_key long, user_id string, item string")
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    kept = rows.groupBy("result_key", "user_id").agg(F.collect_set("item").alias("item_ids")).select(
        "result_key", "user_id", F.lit("hybrid").alias("strategy"), "item_ids", at.alias("computed_at"),
        F.lit("2024-03-01").cast("timestamp_ntz").alias("expires_at"))
    moved = spark.createDataFrame([("i2",)], "item_id string").withColumn("changed_at", F.lit("2024-01-05").cast("timestamp_ntz"))
    asked = spark.createDataFrame([(1, "u", "hybrid"), (2, "v", "hybrid")], "result_key long, user_id string, strategy string")
    answers, after = stored.get_or_compute(
        asked, kept, lambda x: x.select("result_key", F.array(F.lit("new")).alias("item_ids")),
        F.lit("2024-02-01").cast("timestamp_ntz"), changed_items=moved)
    assert "collect_set" not in answers._jdf.queryExecution().toString()
    assert sorted((r.result_key, r.hit, r.item_ids) for r in answers.collect()) == [(1, False, ["new"]), (2, True, ["i1"])]
    assert after.count() == 2
