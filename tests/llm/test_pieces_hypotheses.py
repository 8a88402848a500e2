"""All n best segmentations leave the operator and are digested and decoded."""

import hashlib
from array import array

import public_tokenizers
from pyspark.sql import functions as F

from uttera.llm import pieces
from uttera.session import ship

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", "the cat", "  x  y", "an é 漢", "a▁b\n\t", "The whole job, not only the best of it. " * 40]


def test_every_hypothesis(spark):
    ship(spark)
    model = pieces.Lattice(PATH)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    given = {r.doc_id: r.hypotheses for r in pieces.n_best(df, PATH).collect()}
    checked = {r.doc_id: r for r in pieces.n_best_texts(df, PATH).collect()}
    for k, text in enumerate(TEXTS):
        want = model.encode(text or "", pieces.N_BEST)
        assert [(h.score, list(h.ids)) for h in given[k]] == want and len({tuple(ids) for _, ids in want}) == len(want)
        row = checked[k]
        digests = [hashlib.sha256(array("i", ids).tobytes()).hexdigest() for _, ids in want]
        assert [(h.score, h.n_pieces, h.pieces_sha256) for h in row.hypotheses] == [(s, len(ids), d) for (s, ids), d in zip(want, digests, strict=True)]
        assert row.round_trip and all(h.round_trip for h in row.hypotheses)
        assert (row.n_best, row.pieces_sha256, row.best_score, row.last_score) == (len(want), digests[0], want[0][0], want[-1][0])
    assert len(given[6]) == pieces.N_BEST


def test_wrong_ids_are_seen(spark):
    ship(spark)
    df = spark.createDataFrame([("the cat", [(0.0, pieces.Lattice(PATH).encode("the cat")[0][1]), (0.0, [5])])], f"text string, h {pieces.HYPOTHESES}")
    got = df.select(pieces.checked_column(F.col("text"), F.col("h"), PATH).alias("c")).first().c
    assert [x.round_trip for x in got] == [True, False]
