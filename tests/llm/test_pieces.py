import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from uttera.llm import pieces
from uttera.session import ship

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.Lattice(PATH)


def every(model, s, at=0):
    """(score, ids) of every segmentation."""
    if at == len(s):
        return [(0.0, ())]
    return [(score + rest, ids + tail) for end, ids, score in model.edges(s, at) for rest, tail in every(model, s, end)]


def test_segments_against_all(model):
    rng = random.Random(2)
    for _ in range(60):
        s = "▁" * rng.randrange(3) + "".join(rng.choice("theinaçé漢\x01s") for _ in range(rng.randrange(1, 9)))
        want = sorted(every(model, s), key=lambda x: -x[0])
        for n in (1, 3, 7):
            got = model.n_best(s, n)
            assert [x for x, _ in got] == [x for x, _ in want[:n]]
            assert all((x, ids) in want for x, ids in got) and len({ids for _, ids in got}) == len(got)


def test_texts_against_all(model):
    for text in ("the in", "a", "  x  y", "an é", "\n\t", "e s", "漢 \u2581", "a,", "(e", ",a b"):
        want = sorted(every(model, pieces.normal(text)), key=lambda x: -x[0])[:4]
        got = model.encode(text, 4)
        assert [x for x, _ in got] == [x for x, _ in want]
        _, top, scores = model.best(text, 4)
        assert top == want[0][0] and scores == [x for x, _ in want]
        for _, ids in got:
            assert model.decode(ids) == text.replace("▁", " ")


def test_decode_as_the_library(model):
    for text in ("Hello  world\n x", "é漢😀", "a▁b"):
        assert model.decode(model.processor.encode(text)) == model.processor.decode(model.processor.encode(text))


def test_long_segment(model):
    got = model.n_best("a" * 20_000, 4)
    assert len(got) == 4 and got[0][0] >= got[3][0]


def test_table(spark):
    ship(spark)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "the cat"), (3, "the cat"), (4, "word " * 30_000)], "doc_id long, text string").withColumn("b", F.lit(1))
    got = pieces.n_best_texts(df, PATH).collect()
    assert [(r.n_pieces, r.best_score, r.n_best) for r in got[:2]] == [(0, 0.0, 1)] * 2
    assert got[2] == got[3] and all(r.round_trip for r in got) and got[4].n_best == 4
    assert pieces.n_best_texts(df.limit(0), PATH).count() == 0
