"""Most frequent terms from bounded tables, against plain counting."""

import random
from collections import Counter

import pytest

from rankfold.operators import heavy


def plain(rows, n, min_df):
    total, df = Counter(), Counter()
    for r in rows:
        own = Counter(r) + Counter(" ".join(p) for p in zip(r, r[1:]))
        total.update(own)
        df.update(own.keys())
    best = sorted((t for t in total if df[t] >= min_df), key=lambda t: (-total[t], t))[:n]
    return {t: (df[t], total[t]) for t in best}


@pytest.mark.parametrize("n, min_df, size", [(40, 1, 60), (40, 1, 5), (25, 12, 30), (10_000, 1, 16), (30, 1, None)])
def test_vocabulary_is_exact_however_small_the_tables(spark, n, min_df, size):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(300)]
    rows = [[words[min(299, int(rng.paretovariate(.6)) - 1)] for _ in range(rng.randrange(0, 30))] for _ in range(200)]
    rows[3] = ["rare"] * 500  # many times in one list
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "item_id long, toks array<string>").repartition(7)
    vocab, counts = heavy.frequent_terms(df, "toks", n, min_df, size)
    want = plain(rows, n, min_df)
    assert {r.term: (r.df, r.total) for r in vocab.collect()} == want
    for r in counts.collect():
        own = Counter(rows[r.item_id]) + Counter(" ".join(p) for p in zip(rows[r.item_id], rows[r.item_id][1:]))
        got = dict(zip(r.terms, r.counts))
        assert all(own[t] == c for t, c in got.items())
        assert {t: c for t, c in own.items() if t in want} == {t: c for t, c in got.items() if t in want}


def test_tables_stay_bounded_and_errors_hold():
    rng = random.Random(5)
    true, table, error = Counter(), Counter(), 0
    for _ in range(3000):
        t = f"t{int(rng.paretovariate(.8))}"
        true[t] += 1
        table[t] += 1
        if len(table) > 40:
            kept, off = heavy._cut(table, 20)
            assert len(kept) <= 20
            table, error = Counter(kept), error + off
    assert error and all(table[t] <= c <= table[t] + error for t, c in true.items())


def test_no_lists_and_no_tokens(spark):
    for rows in ([], [(1, []), (2, None)]):
        vocab, counts = heavy.frequent_terms(spark.createDataFrame(rows, "item_id long, toks array<string>"), "toks", 5)
        assert vocab.count() == 0 and counts.count() == len(rows)


def test_batches_count_as_lists_do():
    """Words with and without blanks, empty and missing lists; a cut batch keeps its bounds, whatever its size."""
    import pyarrow as pa

    rng = random.Random(6)
    for blank in (False, True):
        words = [f"w{i}" for i in range(60)] + ["w1 w2"] * blank
        rows = [None, [], *[[rng.choice(words) for _ in range(rng.randrange(40))] for _ in range(50)]]
        lists = pa.array(rows, pa.list_(pa.string()))
        true = sum((heavy.terms_of(r or []) for r in rows), Counter())
        assert (heavy._coded(lists) is None) == blank
        assert heavy._batch_table(lists, 10_000) == (true, 0)
        low, off = heavy._batch_table(lists, 30)
        assert off and len(low) <= 30 and all(low.get(t, 0) <= c <= low.get(t, 0) + off for t, c in true.items())
        wanted = sorted(rng.sample(sorted(true), 200) + ["w1 w2 w3", "none"])
        split = [t.partition(" ") for t in wanted]
        got = heavy._row_counts(lists, pa.array(wanted), {t: i for i, t in enumerate(wanted)},
                                pa.array([a if s else None for a, s, _ in split], pa.string()),
                                pa.array([b if s else None for _, s, b in split], pa.string()))
        want = [(i, t, c) for i, r in enumerate(rows) for t, c in sorted(heavy.terms_of(r or []).items()) if t in wanted]
        assert [(int(i), wanted[t], int(c)) for i, t, c in got] == want
