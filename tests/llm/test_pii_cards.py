"""Cards whose digits stand in groups of one or two, in texts without other signs of personal data."""

import pytest

from test_pii import plain
from uttera.llm import pii
from uttera.session import ship

CARDS = ["4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "41 11 11 11 11 11 11 11", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "41-11 11-1 1 11 11 11 11"]


@pytest.mark.parametrize("card", CARDS)
def test_base_span(card):
    text = f"pay {card} now"
    got = [(s, e, k) for s, e, k, ok in pii.base_spans(text) if ok]
    assert got == plain(text) == [(4, 4 + len(card), "card")]


def test_table(spark):
    ship(spark)
    df = spark.createDataFrame([(k, f"pay {c} now") for k, c in enumerate(CARDS)], "doc_id long, text string")
    for r in pii.find_spans(df).collect():
        assert r.base_sha256 == pii.digest(pii.joined(plain(f"pay {CARDS[r.doc_id]} now")))
    assert [r.text for r in pii.masked(df).collect()] == ["pay <CARD> now"] * len(CARDS)
