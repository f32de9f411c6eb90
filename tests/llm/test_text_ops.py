"""License scan, BPE, packing, language ID, quality on small tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankfold.llm import bpe, langid, license, packing, quality
from rankfold.llm.common import crc_mod
from rankfold.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "\n\n", "a", "<|endoftext|>x<|endoftext|>", "don't  stop\t\r\n 12３④ ñÉß", "🙂🙂 ​ x",
       "\x1c\x1d \x85  y", "x" * 5000, "ab " * 4000, "%%% ||| ..."]


def docs(spark, texts):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, score int")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary())


def test_bpe_equals_library(spark, tokenizer):
    rng = random.Random(4)
    texts = ODD + ["".join(chr(rng.choice([32, 10, 39, rng.randrange(33, 127), rng.randrange(160, 0x2FF),
                                           rng.randrange(0x370, 0xD7FF), rng.randrange(0x1F300, 0x1F700)]))
                           for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    got = {r["doc_id"]: r for r in bpe.round_trip(docs(spark, texts), vocabulary()).collect()}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        packed = np.asarray(ids, "<u4").tobytes()
        assert got[i]["n_tokens"] == len(ids), t
        assert got[i]["ids_sha256"] == hashlib.sha256(packed).hexdigest(), t
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest(), t
    assert bpe.round_trip(docs(spark, texts).limit(0), vocabulary()).count() == 0
    ids = bpe.encode(docs(spark, texts[:6]), vocabulary())
    assert {r[0]: r[1] for r in bpe.decode(ids, vocabulary()).collect()} == {i: t or "" for i, t in enumerate(texts[:6])}


def test_license_scan_of_many_places(spark):
    """Suppression stays linear: tens of thousands of places in one text."""
    n = 40_000
    got = license.scan(docs(spark, ["all rights reserved " * n, "gplv3 " * 3])).collect()
    row = next(r for r in got if r["doc_id"] == 0)
    assert (row["n_base"], row["first_word"], row["last_word"], len(row["spans"])) == (n, 0, 3 * (n - 1), n)
    assert {r["start"] % 3 for r in row["spans"]} == {0}


def test_marks_are_no_letters(spark):
    train = spark.createDataFrame([(i, "the cat and the dog", "en") for i in range(5)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    texts = ["\u2764\ufe0f", "\u0301", "\u0301 12", "e\u0301", "the cat"]
    got = {r["text"]: r["lang_pred"] for r in langid.predict(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()}
    assert [got[t] for t in texts[:3]] == ["und"] * 3 and "und" not in (got[texts[3]], got[texts[4]])
    assert langid.gram_counts("e\u0301a")[1] == 2


def test_packing_takes_long_blank_runs(spark):
    texts = ["a" + " " * 600_000 + "b", "\n" * 700_000, " \t" * 300_000 + "<|endoftext|>x"]
    parts = packing.pieces(docs(spark, texts), vocabulary()).groupBy("doc_id").agg(F.sum("length").alias("n"))
    ids = {r["doc_id"]: r["n_tokens"] for r in bpe.encode(docs(spark, texts), vocabulary()).collect()}
    assert {r["doc_id"]: r["n"] for r in parts.collect()} == {i: n + 1 for i, n in ids.items()}


def test_packing_pieces_and_capacities(spark, tokenizer):
    texts = ODD + ["word " * 3000, "a b c", "a b c"]
    parts = packing.pieces(docs(spark, texts), vocabulary())
    rows = packing.pack(parts).collect()
    import zlib
    for i, t in enumerate(texts):
        ids = np.asarray([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r["start"] == at and 0 < r["length"] <= 1024
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and all(r["length"] == 1024 for r in own[1:])
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(by_seq) <= -(-total // 1024) + 1
    assert packing.pack(parts.limit(0)).count() == 0
    few = packing.pack(parts, max_docs=2, max_attention=600_000.0, rule="dot").collect()
    for s in {r["sequence_id"] for r in few}:
        own = [r for r in few if r["sequence_id"] == s]
        assert len(own) <= 2 and (len(own) == 1 or sum(r["length"] ** 2 for r in own) <= 600_000)


def test_packing_is_near_the_bound(spark):
    rows = packing.pack(packing.pieces(spark.read.parquet(f"{SF}/documents.parquet"), vocabulary()), group=64) \
        .agg(F.sum("length"), F.countDistinct("sequence_id"), F.max("sequence_id")).first()
    assert rows[1] <= rows[0] / 1024 * 1.05 + 5


def plain_base(text):
    import re
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for phrase, label in license.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_base_columns(spark):
    texts = ODD + ["cc by cc by CC-BY", "All rights\nreserved. all rights reserved", "ÉCC BY cc byé", "kk cc by",
                   "the GNU General Public License, general public licenses", "cc by " * 3000]
    texts += [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for r in license.scan(docs(spark, texts)).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert license.scan(docs(spark, texts).limit(0)).count() == 0


def test_license_rules_and_suppression(spark):
    cases = {"Released under the MIT License.": "mit", "SPDX-License-Identifier: MPL-2.0": "mpl-2.0",
             "under the Apache License, Version 2.0": "apache-2.0", "BSD 3-Clause License": "bsd-3-clause",
             "GNU Lesser General Public License v2.1": "gpl,lgpl-2.1", "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa",
             "Creative Commons Attribution Non-Commercial": "cc-by-nc", "nothing here": ""}
    got = [r["labels"] for r in license.scan(docs(spark, list(cases))).orderBy("doc_id").collect()]
    assert got == list(cases.values())
    # every rule implies a stem of the gate
    import re
    for r in license.rules():
        needed = re.sub(r"\(\?:[^()]*\)\?", "", r["pattern"])
        groups = re.findall(r"\(\?:([^()]*)\)", needed)
        assert any(s in needed or s in r["anchor"] for s in license.STEMS) or r["anchor"].strip() in needed or groups


def test_language_id(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(d.where(crc_mod("doc_id", 3) != 1))
    p = langid.predict(d, model)
    assert p.count() == d.count() and set(d.columns) < set(p.columns)
    assert langid.held_out_accuracy(p.where(crc_mod("doc_id", 3) == 1), F.col("lang")) > 0.97
    assert p.where("rejected").count() <= 0.01 * d.count()
    odd = {r["doc_id"]: r for r in langid.predict(docs(spark, ODD).select("doc_id", "text"), model).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["rejected"] and odd[i]["score"] == 0 for i in (0, 1, 2, 3, 11))
    assert odd[9]["lang_pred"] != "und"
    none = langid.fit(d.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs(spark, ODD).select("text"), none).collect()} == {"und"}
    # chunks of a long text count the same grams
    text = "Abc déf 12 ghi. " * 100
    whole, n = langid.gram_counts(text)
    size, langid.CHUNK = langid.CHUNK, 7
    parts, m = langid.gram_counts(text)
    langid.CHUNK = size
    assert n == m and (whole == parts).all()


def test_text_helpers_equal_plain_ones():
    import regex
    texts = [*filter(None, ODD), " a", "a ", "\u0301", "e\u0301a \u0130X", "\x00a\x1cb\x1d", "\x85 a\xa0b\n\n", "a-b  c\tcc\r\n!"]
    for t in texts:
        plain = regex.sub(r"[^\p{L}\p{M}]+", " ", t.lower()).strip(" ")
        grams, letters = langid.gram_counts(t)
        assert letters == len(regex.findall(r"\p{L}", t.lower()))
        again, _ = langid.gram_counts(plain)
        assert (grams == again).all()
        raw = t.encode()
        words, got = raw.split(), dict(zip(quality.NAMES, quality.statistics(t), strict=True))
        assert got["word_bytes"] == (np.mean([len(w) for w in words]) if words else 0)
        assert got["lone"] == (np.mean([len(w) == 1 for w in words]) if words else 0)
        assert got["ends"] == (np.mean([w[-1:] in (b".", b",") for w in words]) if words else 0)
        assert got["blank"] == sum(raw.count(c) for c in (b" ", b"\t", b"\r", b"\x0b", b"\x0c")) / max(1, len(raw))


def test_quality(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    stats = quality.with_statistics(d)
    held = crc_mod("doc_id", 4) == 2
    model = quality.fit(quality.with_labels(stats.where(~held), labels))
    got = quality.score(stats.where(held), model).join(labels, "doc_id").select("score", "predicted", "quality").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.93 * len(got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert quality.score(quality.with_statistics(docs(spark, ODD).select("doc_id", "text")), model).count() == len(ODD)
    empty = quality.fit(quality.with_labels(stats.limit(0), labels))
    assert {r["score"] for r in quality.score(stats.limit(5), empty).collect()} == {0.5}
    x, y = quality.isotonic(np.arange(5.0), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert list(x) == [0, 0, 1, 2, 3, 4] and list(y) == [0, 0, 0.5, 0.5, 1, 1]


def plain_scan(text):
    import re
    norm = "".join(f" {w} " for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()))
    found = set()
    for r in license.rules():
        for m in re.finditer(r["pattern"], norm):
            start = len(norm[:m.start()].split())
            found.add((start, -start - len(m[0].split()), -r["priority"], r["label"], r["confidence"]))
    kept = []
    for d in sorted(found):
        if not any(k[1] <= d[1] and k[2] <= d[2] for k in kept):
            kept.append(d)
    return ",".join(sorted({d[3] for d in kept} | set(filter(None, plain_base(text)[4].split(","))))), \
        max((d[4] for d in kept), default=0.0)


def test_license_prefilter_loses_no_rule(spark):
    rng = random.Random(6)
    texts = ["Distributed under GPLv2", "released under Apache 2.0", "MPL 2.0", "MS-PL", "see 0BSD", "MIT-0", "licenced under x",
             "GNU Library General Public License version 2", "licensed under the x", "copyrighted material",
             "Creative Commons Attribution NonCommercial NoDerivatives"]
    named = [n for _, _, names, shorts in license.FAMILIES for n in names + shorts]
    named += [p for *_, p in license.NOTICES]
    named += [f.replace(" N", f" {names[0]}").replace("S", shorts[0]) for _, _, f in license.FRAMES
              for _, _, names, shorts in license.FAMILIES]
    for p in named:
        for keep in (0, 0.5, 1):
            words = []
            for core, optional in license._tokens(p):
                if not optional or rng.random() < keep:
                    words.append(rng.choice(core[1:-1].split("|")) if core.startswith("(") else core)
            texts.append("xx " + " ".join(words).replace(r"\d{4}", "1999").replace(r"\d", "4").replace(".*", "zz")
                         .replace("[cs]", "c").replace("v?", rng.choice(["v", ""])) + " yy")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license.scan(docs(spark, texts)).collect()}
    wrong = [(t, got[i], plain_scan(t)) for i, t in enumerate(texts) if got[i] != plain_scan(t)]
    assert not wrong, (len(wrong), len(texts), wrong[:8])
    assert all(got[i][0] for i in range(11))


def test_language_limits_reject_unlearned_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = "Η γλώσσα αυτή δεν περιέχεται στα κείμενα από τα οποία έμαθε το μοντέλο. "
    hindi = "यह भाषा उन पाठों में नहीं है जिनसे मॉडल ने सीखा है। "
    one = d.limit(1).select(F.lit(-5).cast("long").alias("doc_id"), F.lit(hindi).alias("text"), "lang")
    model = langid.fit(d.select("doc_id", "text", "lang").unionByName(one))
    assert (model.limits < 1).all(), model.limits
    texts = [odd[:24], odd[:60], odd * 4, odd * 40]
    assert [r["rejected"] for r in langid.predict(docs(spark, texts).select("doc_id", "text"), model)
            .orderBy("doc_id").collect()] == [True] * 4, model.limits
    short = d.select("doc_id", F.substring("text", 1, 60).alias("text"))
    assert langid.predict(short, model).where("rejected").count() <= 0.03 * d.count()


def test_packing_document_and_attention_capacities_bind(spark):
    parts = packing.pieces(docs(spark, ["a b c"] * 40), vocabulary())

    def sequences(**capacities):
        rows = packing.pack(parts, **capacities).select("sequence_id", "length").collect()
        assert {r["length"] for r in rows} == {4}
        return len({r["sequence_id"] for r in rows})

    assert (sequences(), sequences(max_docs=4), sequences(max_attention=64.0)) == (1, 10, 10)
