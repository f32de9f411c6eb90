"""Readers: records at any split size, arrival order, what is dropped and why."""

import csv
import io
import json
import random

import pytest

from rankfold.functions.scalar import bad_double, bad_ts, parse_double, parse_ts
from rankfold.operators import strength
from rankfold.sources import files, records


@pytest.fixture()
def split_size(spark):
    """Sets the bytes of a split; back to the default afterwards."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    yield lambda n: [spark.conf.set(k, str(v)) for k, v in zip(keys, (n, 0))]
    for k in keys:
        spark.conf.unset(k)


def cell(rng):
    kind = rng.randrange(6)
    if kind == 0:
        return "".join(rng.choice('ab,"\n é') for _ in range(rng.randrange(12)))
    if kind == 1:
        return '"' * rng.randrange(4)
    return "".join(rng.choice("abc d") for _ in range(rng.randrange(8)))


def test_csv_records_at_any_split(spark, tmp_dir, split_size):
    rng = random.Random(21)
    want = []
    for f in ("a", "b"):
        rows = [[cell(rng) for _ in range(3)] for _ in range(60)]
        buffer = io.StringIO()
        out = csv.writer(buffer, lineterminator="\n")
        out.writerows(rows)
        text = buffer.getvalue() + '5" disk,x"y,"z"\n\nlast,"1""2","open\nend'
        with open(f"{tmp_dir}/{f}.csv", "w", newline="") as g:
            g.write(text)
        want += [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    for size in (60, 377, 1 << 20):
        split_size(size)
        got = sorted(records.read(spark, f"{tmp_dir}/*.csv", "csv").collect(), key=lambda r: r.seq)
        assert [r.seq for r in got] == list(range(len(want)))
        assert [next(csv.reader(io.StringIO(r.text, newline=""))) for r in got] == want
        assert [r.seq for r in got if r["first"]] == [0, len(want) // 2]


def value(rng, deep=0):
    kind = rng.randrange(7 if deep < 3 else 4)
    if kind < 2:
        return "".join(rng.choice('a{}[]"\\,:\n\té') for _ in range(rng.randrange(10)))
    if kind == 2:
        return rng.choice([None, True, 1, -2.5, ""])
    if kind == 3:
        return [value(rng, 3) for _ in range(rng.randrange(3))]
    return {f"k{i}" + str(value(rng, 9)): value(rng, deep + 1) for i in range(rng.randrange(4))} if kind < 6 else {}


def test_json_records_at_any_split(spark, tmp_dir, split_size):
    rng = random.Random(22)
    texts, want = {}, []
    for f, indent in (("a", None), ("b", 1), ("c", "lines"), ("d", "empty")):
        rows = [] if indent == "empty" else [{"n": i, "x": value(rng), str(value(rng, 9)): value(rng)} for i in range(50)]
        texts[f] = "\n".join(map(json.dumps, rows)) if indent == "lines" else json.dumps(rows, indent=indent, ensure_ascii=False) + "\n"
        with open(f"{tmp_dir}/{f}.json", "w") as g:
            g.write(texts[f])
        want += rows
    for size in (150, 1000, 1 << 20):
        split_size(size)
        got = sorted(records.read(spark, f"{tmp_dir}/*.json", "json").collect(), key=lambda r: r.seq)
        assert [r.seq for r in got] == list(range(len(want)))
        assert [json.loads(r.text) for r in got] == want


def test_strengths_do_not_depend_on_splits(spark, tmp_dir, split_size):
    """Order decides the fold (a rating replaces what came before): one file, several split sizes."""
    rng = random.Random(23)
    rows = [{"user_id": f"u{rng.randrange(5)}", "item_id": f"i{rng.randrange(6)}",
             "interaction_type": rng.choice(["view", "like", "dislike", "rating"]), "value": rng.randrange(11)} for _ in range(1500)]
    with open(f"{tmp_dir}/x.json", "w") as f:
        f.write("\n".join(map(json.dumps, rows)))
    with open(f"{tmp_dir}/x.csv", "w") as f:
        out = csv.DictWriter(f, list(rows[0]))
        out.writeheader()
        out.writerows(rows)
    seen = set()
    for size in (9_000, 1 << 24):
        split_size(size)
        for ds in (files.load_json(spark, interactions_path=f"{tmp_dir}/x.json"),
                   files.load_csv(spark, interactions_path=f"{tmp_dir}/x.csv")):
            log = ds.interactions
            assert log.select("seq").distinct().count() == 1500
            seen.add(tuple(sorted(tuple(r) for r in strength.strength_fold(log).collect())))
    assert len(seen) == 1


def test_numbers_and_times(spark):
    numbers = {"": (None, False), "8": (8.0, False), " 7.5 ": (7.5, False), "1_0": (10.0, False), "1e1": (10.0, False), ".5": (.5, False),
               "5.": (5.0, False), "abc": (None, True), " ": (None, True), "8d": (None, True), "1__0": (None, True), "0x1": (None, True)}
    times = {"": (None, False), "2024-01-02": ("2024-01-02 00:00:00", False), "2024-01-02T03:04:05": ("2024-01-02 03:04:05", False),
             "2024-01-02 03:04": ("2024-01-02 03:04:00", False), "2024-01-02T03:04:05Z": ("2024-01-02 03:04:05", False),
             "2024-01-02T03:04:05+02:00": ("2024-01-02 01:04:05", False), "2024-01-02T03:04:05.1234567-0130": ("2024-01-02 04:34:05.123456", False),
             "20240102T030405": ("2024-01-02 03:04:05", False), "garbage": (None, True), "2024-13-01": (None, True),
             "2024-01-02T25:00:00": (None, True), "2024-01-02T03:04:05+99:00": (None, True), "2024-02-30": (None, True)}
    for cases, parse, bad in ((numbers, parse_double, bad_double), (times, parse_ts, bad_ts)):
        df = spark.createDataFrame([(c,) for c in [*cases, None]], "c string")
        got = {r[0]: (r[1], r[2]) for r in df.select("c", parse(df.c).cast("string") if parse is parse_ts else parse(df.c), bad(df.c)).collect()}
        assert got == {**cases, None: (None, False)}


def test_unreadable_csv_cells_reject_their_row(spark, tmp_dir):
    with open(f"{tmp_dir}/x.csv", "w") as f:
        f.write("user_id,item_id,interaction_type,value,timestamp\nu,a,view,abc,\nu,b,view,,garbage\nu,c,view,,2024-01-02T00:00:00Z\n"
                "u,d,rating,9,2024-01-02T00:00:00+02:00\nu,e,rating,11,\nu,f\n")
    ds = files.load_csv(spark, interactions_path=f"{tmp_dir}/x.csv")
    assert {(r.item_id, r.seq, str(r.timestamp)) for r in ds.interactions.collect()} == {
        ("c", 3, "2024-01-02 00:00:00"), ("d", 4, "2024-01-01 22:00:00")}
    assert {r.item_id: r.reason for r in ds.interactions_rejected.collect()} == {
        "a": "value not readable", "b": "time not readable", "e": "value range", "f": "interaction_type"}


def test_files_with_their_own_headers(spark, tmp_dir):
    with open(f"{tmp_dir}/1.csv", "w") as f:
        f.write("item_id,title,item_type\na,A,book\n")
    with open(f"{tmp_dir}/2.csv", "w") as f:
        f.write('title,features,item_id,item_type\nB,"{""k"":1}",b,song\nC,,c,song\n')
    open(f"{tmp_dir}/3.csv", "w").close()
    ds = files.load_csv(spark, items_path=f"{tmp_dir}/*.csv")
    assert {(r.item_id, r.title, r.features, r.metadata) for r in ds.items.collect()} == {("a", "A", "{}", "{}"), ("b", "B", '{"k":1}', "{}")}
    assert [(r.item_id, r.reason) for r in ds.items_rejected.collect()] == [("c", "features object")]


def test_json_absent_null_and_wrong_types(spark, tmp_dir):
    ok = {"title": "T", "item_type": "book"}
    rows = [{"item_id": "absent", **ok}, {"item_id": "null", **ok, "features": None}, {"item_id": "list", **ok, "metadata": []},
            {"item_id": "full", **ok, "features": {"a": [1, {"b": None}]}, "description": None}, {"item_id": 5, **ok},
            {"item_id": "title", "title": 7, "item_type": "book"}, {"item_id": "text", **ok, "features": "{}"}]
    with open(f"{tmp_dir}/i.json", "w") as f:
        f.write(json.dumps(rows)[:-1] + ', {"item_id": broken}, {"item_id": "after", "title": "T", "item_type": "song"}]')
    ds = files.load_json(spark, items_path=f"{tmp_dir}/i.json")
    assert {(r.item_id, r.features, r.seq) for r in ds.items.collect()} == {
        ("absent", "{}", 0), ("full", '{"a":[1,{"b":null}]}', 3), ("after", "{}", 8)}
    reasons = {r.seq: r.reason for r in ds.items_rejected.collect()}
    assert reasons == {1: "features object", 2: "metadata object", 4: "item_id not readable", 5: "title not readable",
                       6: "features object", 7: "object not readable"}
    log = [{"v": 1}, {"value": "8"}, {"value": "x"}, {"value": None}, {"value": True}, {"value": [1]}, {"timestamp": ""},
           {"timestamp": 0}, {"timestamp": 5}, {"timestamp": "2024-01-02T03:04:05+01:00"}, {"timestamp": "soon"}, {"timestamp": None}]
    with open(f"{tmp_dir}/x.json", "w") as f:
        json.dump([{"user_id": "u", "item_id": "i", "interaction_type": "view", **x} for x in log], f)
    ds = files.load_json(spark, interactions_path=f"{tmp_dir}/x.json")
    assert {(r.seq, r.value, str(r.timestamp)) for r in ds.interactions.collect()} == {
        (0, None, "None"), (1, 8.0, "None"), (3, None, "None"), (4, 1.0, "None"), (6, None, "None"), (7, None, "None"),
        (9, None, "2024-01-02 02:04:05"), (11, None, "None")}
    assert {r.seq: r.reason for r in ds.interactions_rejected.collect()} == {
        2: "value not readable", 5: "value not readable", 8: "time not readable", 10: "time not readable"}


def test_parquet_reads_active_rows(spark, tmp_dir):
    for t in ("items", "users", "interactions"):
        spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, is_active boolean").write.parquet(f"{tmp_dir}/{t}")
    assert {r.id for r in files.load_parquet(spark, tmp_dir).items.collect()} == {1, 3}
    assert files.load_parquet(spark, tmp_dir, active_only=False).users.count() == 3
