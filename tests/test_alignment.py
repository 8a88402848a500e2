"""Word alignment against tables of distances."""

import random
import time
from collections import Counter

import pytest

from test_text import edits as distance
from test_whole_texts import documents, pair, sf, tokens  # noqa: F401
from uttera.functions.text import NUMBERS
from uttera.operators import alignment as al
from uttera.operators.dsp import edit_distance
from uttera.plans.queries import QUERIES


def holds(ref, hyp):
    pairs = al.aligned(ref, hyp)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False))
    hits, s, d, i = al.counts(ref, hyp, pairs)
    assert hits + s + d == len(ref) and hits + s + i == len(hyp)
    return s + d + i


@pytest.mark.parametrize("table", [16_000_000, 100, 1])
def test_500_pairs(monkeypatch, table):
    monkeypatch.setattr(al, "TABLE", table)
    rng = random.Random(table)
    for _ in range(500):
        some = "abcdefgh"[: rng.randrange(1, 9)]
        ref, hyp = ([rng.choice(some) for _ in range(rng.randrange(40))] for _ in range(2))
        if rng.random() < 0.5:
            hyp = [x for x in ref if rng.random() < 0.8]
        want = distance(ref, hyp)
        assert holds(ref, hyp) == want == edit_distance(ref, hyp)
        assert al.column(ref, hyp).tolist() == [distance(ref[:k], hyp) for k in range(len(ref) + 1)]


def test_long_text():
    rng = random.Random(3)
    ref = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    hyp = [w if rng.random() < 0.9 else rng.choice(["x", f"w{rng.randrange(3000)}"]) for w in ref if rng.random() < 0.95]
    start = time.perf_counter()
    assert holds(ref, hyp) == edit_distance(ref, hyp)
    assert time.perf_counter() - start < 30
    assert holds([], hyp) == len(hyp) and holds(ref, []) == len(ref) and holds(ref, ref) == 0


def test_edits_rebuild_both_texts():
    rng = random.Random(5)
    for _ in range(50):
        ref, hyp = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        rows = list(al.edits(ref, hyp))
        assert [r[3] for r in rows if r[1] is not None] == ref and [r[4] for r in rows if r[2] is not None] == hyp
        assert sum(r[0] != al.MATCH for r in rows) == distance(ref, hyp)
        assert list(al.edits(ref, hyp, matches=False)) == [r for r in rows if r[0] != al.MATCH]


def test_rows(spark):
    df = spark.createDataFrame([("k", ["a", "b", "c"], ["a", "x"]), (None, None, ["y"]), ("e", [], []), ("k", ["a"], ["a"])], "kind string, r array<string>, h array<string>").withColumnRenamed("kind", "id")
    got = [tuple(r) for r in al.edit_rows(df, "id", "r", "h").collect()]
    want = [(None, al.INSERTION, None, 0, None, "y"), ("k", al.DELETION, 2, None, "c", None), ("k", al.MATCH, 0, 0, "a", "a"), ("k", al.MATCH, 0, 0, "a", "a"), ("k", al.SUBSTITUTION, 1, 1, "b", "x")]
    by_kind = lambda rows: Counter(r[1] for r in rows)
    assert len(got) == 5 and by_kind(got) == by_kind(want)
    counted = df.select("id", al.alignment_counts(df.r, df.h).alias("c")).select("id", "c.*").collect()
    assert [tuple(r)[1:] for r in counted][1:] == [(None,) * 4, (0, 0, 0, 0), (1, 0, 0, 0)] and sum(tuple(counted[0])[2:]) == 2


def test_queries(spark, sf):  # noqa: F811
    rows = {r.doc_id: r for r in QUERIES["word_alignment"](spark, sf).collect()}
    total = 0
    for k, text, *_ in documents():
        r, h = ([NUMBERS.get(x, x) for x in tokens(" ".join(side))] for side in pair(text))
        want = distance(r, h)
        assert (rows[k].n_ref, rows[k].n_hyp, rows[k].substitutions + rows[k].deletions + rows[k].insertions) == (len(r), len(h), want)
        total += want
    assert sum(r.n for r in QUERIES["word_confusions"](spark, sf).collect()) == total
