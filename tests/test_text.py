"""Text metrics against direct computation and published values."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from uttera.functions import text as T
from uttera.operators.dsp import translation_edits
from uttera.sources.sinks import one_decimal, submission


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_edits(spark):
    rng = random.Random(1)
    pairs = [([rng.choice("abc") for _ in range(rng.randrange(7))], [rng.choice("abc") for _ in range(rng.randrange(9))]) for _ in range(60)]
    df = spark.createDataFrame(pairs, "r array<string>, h array<string>")
    for r in df.select("r", "h", T.word_edits(F.col("r"), F.col("h")).alias("e")).collect():
        assert r.e == edits(r.r, r.h)


def test_normalisation(spark):
    rows = [("Co-op,  said  He!",), ("¿quê?",), ("",), (None,), ("Nine oito três",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r.x for r in df.select(T.number_normalised(T.tokens(F.col("t"))).alias("x")).collect()]
    assert got == [["coop", "said", "he"], ["¿quê"], [], [], ["9", "8", "3"]]


def test_f1_and_thinking(spark):
    rows = [(["a", "b", "b"], ["b", "b", "c"]), ([], []), ([], ["a"]), (["a"], ["a"])]
    df = spark.createDataFrame(rows, "g array<string>, p array<string>")
    assert [round(r.f, 4) for r in df.select(T.token_f1(F.col("g"), F.col("p")).alias("f")).collect()] == [0.6667, 1.0, 0.0, 1.0]
    one = spark.createDataFrame([("<think>\nno\n</think> yes",)], "t string").select(T.without_thinking(F.col("t"))).first()
    assert one[0] == "yes"


def test_rounding(spark):
    values = [2.25, 2.35, 7.0, 0.15, 0.35, 0.45, 1.05, 8.35, 33.45, 0.25, 0.75, -0.04, -0.25, 1e300, 123456789012345.65, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = [r[0] for r in df.select(one_decimal(F.col("x"))).collect()]
    assert got == [None if x is None else f"{x:.1f}" for x in values]
    assert got[3:9] == ["0.1", "0.3", "0.5", "1.1", "8.3", "33.5"]


def test_submission_keeps_places(spark):
    dev = spark.createDataFrame([("b", 1.25, 0), ("a", 2.0, 1)], "fileid string, hyp double, place int")
    out = submission(dev, dev.limit(0).unionByName(spark.createDataFrame([("0", 3.0, 0)], dev.schema)), order="place")
    assert [tuple(r) for r in out.collect()] == [("b", "1.2"), ("a", "2.0"), ("0", "3.0")] and out.columns == ["fileId", "Age"]


def test_blanks_of_any_script(spark):
    text = "a\u00a0b\u2003c\x1cd\x85e\u3000 f\u200bg"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.tokens(F.col("t"))).first()[0] == text.split()


def test_bags(spark):
    rng = random.Random(8)
    rows = [([rng.choice("abcde") for _ in range(rng.randrange(9))], [rng.choice("bcdef") for _ in range(rng.randrange(9))]) for _ in range(80)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = [r[0] for r in df.select(T.bag_overlap(F.col("a"), F.col("b"))).collect()]
    assert got == [(Counter(a) & Counter(b)).total() for a, b in rows]


def test_shifts():
    assert translation_edits("a b c d".split(), "c d a b".split()) == 1
    assert translation_edits("a b".split(), []) == 2
    assert translation_edits("a b c".split(), "a b c".split()) == 0


@pytest.mark.parametrize("scores, n, expected", [([(1, 76), (15, 78)], 154, 0.1039), ([(0, 76), (88, 78)], 154, 0.5714)])
def test_pooled_rate(scores, n, expected):
    assert round(sum(e for e, _ in scores) / n, 4) == expected
