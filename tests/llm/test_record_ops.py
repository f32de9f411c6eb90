"""Chat tree, WARC archives, pipeline, entry points."""

import hashlib
import tempfile

from pyspark.sql import functions as F

from rankfold.llm import chat, warc

SF = "/root/testdata/sf0.001"
CONV = "conv_id long, turn long, role string, text string, node string"


def conversations():
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"shared {t}" if t < 2 else f"own {c % 4} {t}", "clash")
            for c in range(12) for t in range(2 + c % 4)]
    return rows + [(100, 0, None, None, ""), (100, 1, "assistant", "<|im_end|>\\n<|im_start|>assistant ok\\", ""),
                   (101, 0, "a\nb<|", "x\ny", ""), (101, 0, "a\nb<|", "x\ny", ""), (None, 0, "user", "hi", ""),
                   (102, None, "assistant", "é🙂", ""), (102, 5, "assistant", "", "")]


def test_chat_round_trip_and_intervals(spark):
    rows = conversations()
    tree = chat.build(spark.createDataFrame(rows, CONV))
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append((r[1] if r[1] is not None else -1, r[2] or "", r[3] or ""))
    got = {r["conv_id"]: r for r in chat.read_back(tree).collect()}
    assert set(got) == set(by_conv)
    for c, turns in by_conv.items():
        turns.sort()
        said = [t for _, r, t in turns if r == "assistant"]
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[c]["loss_chars"] == sum(map(len, said))
        assert got[c]["loss_sha256"] == hashlib.sha256("".join(said).encode()).hexdigest()
    nodes = {r["node"]: r for r in tree.nodes.collect()}
    # places are gapless, and a node's ancestors cover exactly its parents' places
    at = 0
    for r in sorted(nodes.values(), key=lambda r: r["start"]):
        assert r["start"] == at and r["end"] - r["start"] == len(r["rendered"])
        at = r["end"]
        seen, p = set(), r["parent"]
        while p is not None:
            seen |= set(range(nodes[p]["start"], nodes[p]["end"]))
            p = nodes[p]["parent"]
        assert seen == {k for a in r["ancestors"] for k in range(a["start"], a["end"])}
        assert r["position"] == len(seen)
    shared = [r for r in nodes.values() if r["rendered"].startswith("<|im_start|>user\nshared 0")]
    assert len(shared) == 1 and len(nodes) < len(rows)
    assert chat.read_back(chat.build(spark.createDataFrame([], CONV))).count() == 0


PAGES = "page_id long, url string, html string, offset long"


def test_warc_round_trip_and_lookup(spark):
    big, other = "é" * 60 + "\r\n\r\nWARC/1.1\r\n\r\n", "x" * 99
    rows = [(3, "http://www.example.com:80/a?b=1#f", big, 0), (1, "https://example.com/b", big, 0), (2, None, big, 0),
            (4, "not a url\r\nX: y", other, 0), (5, "http://h.example.org/", other, 0), (6, "http://h.example.org/", None, 0),
            (7, "http://h.example.org/", "", 0), (None, "http://n.example.org/", big, 0), (9, "http://www.example.com/a?b=1", "z" * 300, 0)]
    rows += [(100 + i, f"http://s{i % 7}.example.net/{i}", f"<p>{i}</p>" * 20, 0) for i in range(60)]
    index = warc.archive(spark.createDataFrame(rows, PAGES), block_lines=8)
    got = index.scan().collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    for i, _, html, _ in rows:
        data = (html or "").encode()
        assert by_id[i]["payload_bytes"] == len(data)
        assert by_id[i]["payload_digest"] == hashlib.sha256(data).hexdigest()
        revisit = html == big and i != 1
        assert (by_id[i]["record_type"], by_id[i]["refers_to"]) == (("revisit", 1) if revisit else ("response", None))
    assert index.blocks.count() > 1
    for i, url, html, _ in rows:
        if url is None or i in (4, None):
            continue
        hits = {h["page_id"]: h for h in index.lookup(url)}
        assert i in hits
        head, payload = warc.read_range(spark, hits[i]["file"], hits[i]["offset"], hits[i]["length"])
        assert head["WARC-Type"] == hits[i]["record_type"]
        assert payload == (b"" if head["WARC-Type"] == "revisit" else (html or "").encode())
    assert index.lookup("http://absent.example.com/") == []
    assert warc.url_key("HTTP://Www.Example.com:80/a?b") == "com,example,www)/a?b"
    none = warc.archive(spark.createDataFrame([], PAGES), path=tempfile.mkdtemp(prefix="warc-", dir="/tmp") + "/w")
    assert none.scan().count() == 0 and none.lookup("http://a/") == []


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in P.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns
        assert after.join(docs, docs.columns, "left_anti").where("lang is not null").count() == 0
        kept = after.cache()
    assert 0.5 * docs.count() < kept.count() < docs.count()
    out = P.packed(spark, kept, SF)
    assert {r[0] for r in out.select("doc_id").distinct().collect()} == {r[0] for r in kept.select("doc_id").collect()}
    assert out.where(F.col("length") > 1024).count() == 0


def test_pipeline_keeps_what_is_no_copy(spark):
    """Repeated and null ids, equal rows, copies across ids, texts without words, more columns."""
    import corpus_pipeline as P

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "en"), (1, b, "en"), (2, a + " more", "en"), (None, b, "de"), (None, c, None), (None, c, None), (3, "", "en"),
            (4, None, None), (5, c + " x", "en"), (6, "two words", "en"), (6, "two words", "en")]
    docs = spark.createDataFrame([(*r, r[2], i, i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, d string, "
                                 "component_id long, node long").withColumn("_row", F.lit(1))
    out = P.one_of_each(spark, docs, SF)
    assert out.columns == docs.columns
    texts = sorted((r.text or "")[:3] for r in out.collect())
    assert texts == ["", "", "a0 ", "b0 ", "c0 ", "two"]
    assert P.one_of_each(spark, docs.limit(0), SF).count() == 0


def test_entry_registers_all():
    import __spark_entry__ as E

    names = set(E.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(E.oracle_sql()) <= names
