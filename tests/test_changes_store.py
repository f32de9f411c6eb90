"""Change application, readers, import, stores."""

import json
import os

from pyspark.sql import functions as F

from rankfold.operators import changes as U
from rankfold.operators import collab as K
from rankfold.operators import content as C
from rankfold.operators import strength
from rankfold.sources import files, store
from rankfold.sources.importer import import_dataset


def test_insert_first_wins(spark, fix_items):
    batch = spark.createDataFrame(
        [("mv_11", "dup", "movie", None, "{}", "{}", 1), ("new", "A", "book", None, "{}", "{}", 2),
         ("new", "B", "book", None, "{}", "{}", 3)],
        "item_id string, title string, item_type string, description string, features string, "
        "metadata string, seq long")
    table = fix_items.select("item_id", "title", "item_type", "description", "features", "metadata")
    new, inserted, rejected = U.insert_new(table, batch, "item_id", "seq")
    assert [r.title for r in inserted.collect()] == ["A"]
    assert sorted(r.reason for r in rejected.collect()) == ["already exists", "duplicate in batch"]
    assert new.count() == 6


def test_update_null_keeps(spark, fix_items):
    upd = spark.createDataFrame([("mv_11", None, "new desc", 1), ("mv_11", "T2", None, 2)],
                                "item_id string, title string, description string, seq long")
    items = fix_items.withColumn("updated_at", F.col("created_at"))
    r = {x.item_id: x for x in U.update_items(items, upd).collect()}
    assert r["mv_11"].title == "T2" and r["mv_11"].description == "new desc"
    assert r["mv_12"].title == "Night Ferry"


def test_activate_unknown_version(spark):
    arts = spark.createDataFrame([("m", "1", True), ("m", "2", False), ("o", "1", True)],
                                 "model_name string, model_version string, is_active boolean")
    got = {(r.model_name, r.model_version): r.is_active for r in U.activate_model(arts, "m", "9").collect()}
    assert got == {("m", "1"): False, ("m", "2"): False, ("o", "1"): True}
    got = {(r.model_name, r.model_version): r.is_active for r in U.activate_model(arts, "m", "2").collect()}
    assert got[("m", "2")] is True and got[("m", "1")] is False


def test_get_or_create_and_fk(spark, fix_items, fix_interactions):
    users = spark.createDataFrame([("user_1", "{}")], "user_id string, preferences string")
    extra = fix_interactions.unionByName(spark.createDataFrame(
        [(9, "user_9", "ghost", "view", None)], fix_interactions.schema))
    all_users = U.get_or_create_users(users, extra)
    created = {r.user_id for r in all_users.where("created").collect()}
    assert created == {"user_2", "user_3", "user_9"}  # user_9 created though its item is unknown
    ok, bad = U.check_items(extra, fix_items)
    assert [r.item_id for r in bad.collect()] == ["ghost"] and ok.count() == 7


def test_delete(spark, fix_items, fix_interactions):
    ids = spark.createDataFrame([("mv_11",)], "item_id string")
    soft, _ = U.delete_items(fix_items, ids)
    assert {r.item_id for r in soft.where("NOT is_active").collect()} == {"mv_11"}
    hard, inter = U.delete_items(fix_items, ids, fix_interactions, hard=True)
    assert hard.count() == 4 and inter.where("item_id = 'mv_11'").count() == 0


def test_csv_reader_rules(spark, tmp_dir):
    p = os.path.join(tmp_dir, "items.csv")
    with open(p, "w") as f:
        f.write('item_id,title,item_type,description,features,metadata\n'
                'a,Title A,movie,"multi\nline",{},{}\n'
                'b,Title B,movie,,,{}\n'
                'c,Title C,gadget,,{},{}\n')
    ds = files.load_csv(spark, items_path=p)
    assert [r.item_id for r in ds.items.collect()] == ["a"]
    reasons = {r.item_id: r.reason for r in ds.items_rejected.collect()}
    assert reasons == {"b": "features object", "c": "item_type"}
    p2 = os.path.join(tmp_dir, "items2.csv")
    with open(p2, "w") as f:
        f.write("item_id,title,item_type\nx,X,book\n")
    ds2 = files.load_csv(spark, items_path=p2)
    assert [(r.item_id, r.features) for r in ds2.items.collect()] == [("x", "{}")]
    assert files.load_csv(spark, items_path=os.path.join(tmp_dir, "missing.csv")).items.count() == 0
    p3 = os.path.join(tmp_dir, "interactions.csv")
    with open(p3, "w") as f:
        f.write("user_id,item_id,interaction_type,value,timestamp\n"
                "u,a,rating,8,2024-01-02T03:04:05\nu,a,view,,\nu,a,rating,,\n")
    ds3 = files.load_csv(spark, interactions_path=p3)
    rows = sorted(ds3.interactions.collect(), key=lambda r: r.seq)
    assert [(r.value, r.timestamp is not None) for r in rows] == [(8.0, True), (None, False)]


def test_json_reader_and_import(spark, tmp_dir):
    d = tmp_dir
    json.dump([{"item_id": "a", "title": "A", "item_type": "book", "features": {"genre": "x"}},
               {"item_id": "a", "title": "A2", "item_type": "book"},
               {"item_id": "b", "title": "B", "item_type": "song"}], open(f"{d}/items.json", "w"))
    json.dump([{"user_id": "u1", "preferences": {"k": 1}}], open(f"{d}/users.json", "w"))
    json.dump([{"user_id": "u1", "item_id": "a", "interaction_type": "like"},
               {"user_id": "u2", "item_id": "zz", "interaction_type": "view"},
               {"user_id": "u3", "item_id": "b", "interaction_type": "view", "value": 11}],
              open(f"{d}/interactions.json", "w"))
    batch = files.load_export_dir(spark, d)
    empty = files.Dataset(
        spark.createDataFrame([], "item_id string, title string, item_type string, description string, "
                                  "features string, metadata string"),
        spark.createDataFrame([], "user_id string, preferences string"),
        spark.createDataFrame([], "seq long, user_id string, item_id string, interaction_type string, "
                                  "value double, timestamp timestamp_ntz"))
    res = import_dataset(empty, batch)
    stats = {r.entity: (r.imported, r.skipped) for r in res.stats.collect()}
    assert stats["items"] == (2, 1)
    assert stats["users"] == (1, 0)
    assert stats["interactions"] == (1, 1)       # value 11 dropped by the loader, not counted
    assert stats["users_auto_created"] == (1, 0)  # u2, created before its item check failed


def test_model_save_load(spark, fix_items, fix_interactions, tmp_dir):
    cm = C.train(fix_items)
    km = K.train(strength.strength_fold(fix_interactions))
    store.save_hybrid(tmp_dir, cm, km)
    cm2, km2, conf = store.load_hybrid(spark, tmp_dir)
    a = sorted((r.item_id, r.other_id, round(r.score, 9)) for r in C.similar_items(cm, 3).collect())
    b = sorted((r.item_id, r.other_id, round(r.score, 9)) for r in C.similar_items(cm2, 3).collect())
    assert a == b
    assert km2.k == km.k and abs(km2.global_mean - km.global_mean) < 1e-12
    pairs = strength.touched_items(fix_interactions)
    p1 = sorted((r.user_id, r.item_id, round(r.prediction, 6)) for r in K.predict_rating(km, pairs).collect())
    p2 = sorted((r.user_id, r.item_id, round(r.prediction, 6)) for r in K.predict_rating(km2, pairs).collect())
    assert p1 == p2
    assert conf["is_content_trained"] and conf["is_collaborative_trained"]
    none_c, none_k, _ = store.load_hybrid(spark, os.path.join(tmp_dir, "absent"))
    assert none_c is None and none_k is None


def test_logs_artifacts_and_expiry(spark, tmp_dir):
    recs = spark.createDataFrame([("u", 2, "b"), ("u", 1, "a")], "user_id string, rank int, item_id string")
    rows = store.log_rows(recs, "hybrid", 10).collect()
    assert rows[0].recommended_items == ["a", "b"] and rows[0].num_returned == 2
    path = os.path.join(tmp_dir, "artifacts")
    row = ("m", "1", "svd", "/x", "{}", "{}", 1, 1, 1, False, None)
    assert store.save_artifact(spark, path, [row]).count() == 1
    assert store.save_artifact(spark, path, [row, ("m", "2") + row[2:]]).count() == 1
    assert spark.read.parquet(path).count() == 2
    stored = store.store_results(recs, {"n": 10, "strategy": "hybrid"}, ttl_s=3600)
    req = spark.createDataFrame([("u",), ("v",)], "user_id string")
    assert [r.user_id for r in store.misses(req, stored).collect()] == ["v"]
    expired = store.store_results(recs, {"n": 10}, ttl_s=-1)
    assert store.misses(req, expired).count() == 2


def test_record_interactions_and_pages(spark, fix_items, fix_interactions):
    from rankfold.operators import lookup as L
    batch = fix_interactions.withColumn("timestamp", F.lit(None).cast("timestamp_ntz")).unionByName(
        spark.createDataFrame([(9, "user_1", "ghost", "view", None, None)],
                              "seq long, user_id string, item_id string, interaction_type string, "
                              "value double, timestamp timestamp_ntz"))
    rec = U.record_interactions(batch, fix_items).collect()
    assert len(rec) == 7 and all(r.interaction_id and r.timestamp is not None for r in rec)
    assert len({r.interaction_id for r in rec}) == 7
    soft, _ = U.delete_items(fix_items, spark.createDataFrame([("bk_22",)], "item_id string"))
    assert "bk_22" not in {r.item_id for r in L.active(soft).collect()}
    page = L.page(fix_items, [F.col("created_at").desc(), F.col("item_id")], offset=1, limit=2,
                  where=F.col("item_type") == "movie").collect()
    assert [r.item_id for r in page] == ["mv_12", "mv_13"]


def test_readers_take_globs_and_keep_file_order(spark, tmp_dir):
    import os
    from rankfold.sources import files

    with open(os.path.join(tmp_dir, "a.csv"), "w") as f:
        f.write("user_id,preferences\nu1,{}\n")
    with open(os.path.join(tmp_dir, "b.csv"), "w") as f:
        f.write("user_id,preferences\n" + "".join(f"v{i},{{}}\n" for i in range(5000)))
    raw = files.load_csv(spark, users_path=os.path.join(tmp_dir, "*.csv")).users
    rows = [r.user_id for r in raw.orderBy("seq").select("user_id").collect()]
    assert rows == ["u1"] + [f"v{i}" for i in range(5000)]
    assert files.load_csv(spark, users_path=os.path.join(tmp_dir, "*.none")).users.count() == 0


def test_text_that_looks_falsy_is_kept(spark):
    from pyspark.sql import functions as F
    from rankfold.functions.jsonfields import truthy_text

    rows = [('{"k":"0"}',), ('{"k":"false"}',), ('{"k":0}',), ('{"k":false}',), ('{"k":""}',), ("{}",)]
    got = [r[0] for r in spark.createDataFrame(rows, "j string").select(truthy_text(F.col("j"), "k")).collect()]
    assert got == ["0", "false", None, None, None, None]
