"""Runs of words, spelling variants, line dedup against brute force on small tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np

from rankfold.llm import linedup, spelling, squares
from rankfold.llm.queries import op11_runs, op12_spelling, op13_line_dedup

DOCS = "doc_id long, text string, runs string, word string, version long, n long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", 0, 0) for i, t in rows], DOCS)


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def repeated(rng):
    n, k = rng.randrange(0, 140), rng.choice([1, 2, 2, 3, 5])
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n >= 10:
            a, p, m = rng.randrange(n), rng.randrange(1, 22), rng.randrange(1, n)
            for i in range(a + p, min(n, a + m)):
                w[i] = w[i - p]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for _ in range(1500):
        texts = [repeated(rng) for _ in range(rng.randrange(1, 5))]
        got = squares.runs_of([[str(x) for x in w] for w in texts])
        assert got == [plain_runs(w) for w in texts]


def test_runs_do_not_depend_on_the_chunks():
    rng = random.Random(12)
    for _ in range(60):
        w = np.array(sum((repeated(rng) for _ in range(6)), []), np.int64)
        whole = squares.Catchers(6)
        at, q = whole.append(w)
        steps, got = squares.Catchers(6), []
        i = 0
        while i < len(w):
            k = rng.randrange(1, 40)
            got.append(steps.append(w[i:i + k]))
            i += k
        assert sorted(zip(at.tolist(), q.tolist())) == sorted(
            zip(np.concatenate([g[0] for g in got]).tolist(), np.concatenate([g[1] for g in got]).tolist()))


def test_long_runs_stay_linear():
    assert squares.runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    w = np.tile(np.arange(70_001), 5)
    assert squares.runs(w) == [(0, len(w), 70_001)]
    blocks = np.tile(np.array([1] * 50 + [2]), 3000)
    got = squares.runs(blocks)
    assert len(got) == 3001 and (0, len(blocks), 51) in got


def test_op11_contract(spark, tmp_dir):
    rng = random.Random(13)
    rows = [(i, " \t".join(f"w{x}" for x in repeated(rng))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, " \n\x0b"), (None, "a b " * 9), (503, "x " * 40000), (3, rows[3][1]),
             (504, "é é é é é é é"), (505, "a\x1ca a a a a a")]
    table(spark, rows).write.parquet(f"{tmp_dir}/documents.parquet")
    want = Counter()
    for i, text in rows:
        words = [w for w in squares.WORD.findall(text or "")]
        n, h = len(words), 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        found = plain_runs(words) if n < 5000 else [(0, n, 1)]
        best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1]
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        want[(i, len(found), *(best[0] if best else (None,) * 3), 1000 * best[0][1] // best[0][2] if best else None,
              hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
              hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in op11_runs(spark, tmp_dir).collect()) == want
    full = squares.find_runs(spark.read.parquet(f"{tmp_dir}/documents.parquet"))
    assert full.columns == ["doc_id", "runs", "collapsed"] and full.count() == len(rows)
    assert squares.digests(table(spark, [])).count() == 0


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def plain_variants(rows):
    n = Counter()
    for i, text in rows:
        for raw in spelling.RUN.findall(text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            n[word] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, c, len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w, c in n.items()}


def test_op12_contract(spark, tmp_dir):
    rng = random.Random(14)
    base = ["haarlem", "ABERNE", "zürich", "Ärger", "nanana", "banana", "aaaaa", "aaaaaa", "words", "verylongwordindeed"]
    letters = "abcdeéñ÷×Z"

    def word():
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            k = rng.randrange(len(w) + 1)
            op = rng.randrange(3)
            w[k:k + (op > 0)] = [] if op == 2 else [rng.choice(letters)]
        return "".join(w)

    rows = [(i, " ".join(word() for _ in range(60))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "1 2 ., ’"), (None, "Straße straße straße straße"), (203, ("q" * 9000 + " ") * 3),
             (204, ("q" * 9001 + ".") * 7), (5, rows[5][1]), (205, "ÀÿÀÿÀÿ " * 4 + "àÿÀÿÀÿ " * 9)]
    table(spark, rows).write.parquet(f"{tmp_dir}/documents.parquet")
    got = op12_spelling(spark, tmp_dir).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = plain_variants(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(r[3] and r[5] != r[3] for r in want)  # a chain of forms
    assert spelling.group_variants(spelling.counts(table(spark, []))).count() == 0


def test_table_of_words_is_written_out_when_full(spark, monkeypatch):
    rows = [(i, "alpha beta5gamma delta epsilon") for i in range(50)]
    monkeypatch.setattr(spelling, "TABLE_WORDS", 3)
    got = {tuple(r) for r in spelling.counts(table(spark, rows)).collect()}
    assert got == {("alpha", 50), ("gamma", 50), ("delta", 50), ("epsilon", 50)}


def plain_lines(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    split = [(i, (t or "").split("\n")) for i, t in rows]
    held = {}
    for i, lines in split:
        for x in lines:
            if len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(-1 if i is None else i)
    gone = {k: max(ids) for k, ids in held.items() if len(ids) >= 3}
    out = Counter()
    for i, lines in split:
        stay = [x for x in lines if key(x) not in gone or gone[key(x)] == (-1 if i is None else i)]
        out[(i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())] += 1
    return out


def line_rows(rng):
    common = [f"  A Line number {k} that is Long enough É" for k in range(12)] + ["short line", "", "19 code points 1234", "   "]
    rows = []
    for i in range(200):
        lines = [rng.choice(common) if rng.random() < .6 else f"line {rng.random()} of {i} alone" for _ in range(rng.randrange(1, 30))]
        lines.append("\tTHE SAME notice in every document \x0c" if i % 3 else "The same NOTICE in every document")
        rows.append((i, "\n".join(x.upper().replace("É", "É") if rng.random() < .2 else x for x in lines)))
    rows += [(300, None), (301, ""), (302, "\n\n"), (303, "x" * 20), (304, "X" * 20), (303, "x" * 20), (None, "y" * 25),
             (None, "other\n" + "y" * 25 + "\nz"), (305, "Y" * 25 + "\r"), (306, "tail\n" + "y" * 25), (7, rows[7][1]),
             (8, "second text of an id\nThe same NOTICE in every document"), (307, "a" * 300_000 + "\nq"), (308, " " * 20),
             (309, " " * 20), (310, " " + " " * 20)]
    return rows


def test_op13_contract(spark, tmp_dir):
    rows = line_rows(random.Random(15))
    table(spark, rows).repartition(5).write.parquet(f"{tmp_dir}/documents.parquet")
    got = Counter(tuple(r) for r in op13_line_dedup(spark, tmp_dir).collect())
    want = plain_lines(rows)
    assert got == want
    assert linedup.deduplicate(table(spark, [])).count() == 0


def test_hot_hashes_change_no_result(spark):
    docs = table(spark, line_rows(random.Random(16)))
    lines = linedup.line_hashes(docs).cache()
    hot = linedup.hot_hashes(lines)
    assert 0 < len(hot) <= linedup.HOT_KEYS
    notice = linedup.line_hashes(table(spark, [(1, "The same NOTICE in every document")])).first()["h1"]
    assert notice in hot
    every = [r[0] for r in lines.select("h1").distinct().collect()]
    want = Counter(tuple(r) for r in linedup.dropped_lines(lines, []).distinct().collect())
    for keys in (hot, hot[:1], every):
        assert Counter(tuple(r) for r in linedup.dropped_lines(lines, keys).distinct().collect()) == want
    plan = linedup.dropped_lines(lines, hot)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "rangepartitioning(h1" in plan


def test_bitmaps_hold_runs_of_kept_lines(spark):
    line = "one line that repeats everywhere"
    rows = [(1, f"{line}\na\nb\n{line}\n{line}\nc"), (2, f"x\n{line}"), (3, line)]
    got = {r["doc"]: r for r in linedup.keep_bitmaps(table(spark, rows)).collect()}
    assert set(got) == {1, 2} and got[1]["n_dropped"] == 3
    assert [tuple(x) for x in got[1]["keep"]] == [(1, 2), (5, 2**31 - 6)]
    assert [tuple(x) for x in got[2]["keep"]] == [(0, 1), (2, 2**31 - 3)]
