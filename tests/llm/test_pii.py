import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from uttera.llm import pii
from uttera.session import ship

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The contract's patterns and checks, as they are written."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    good = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 12 <= len(digits(s)) <= 19 and pii.luhn(digits(s)),
        "phone": lambda s: 9 <= len(digits(s)) <= 15,
    }
    out = [(m.start(), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text) if good[k](m[0])]
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


PARTS = ["a@b.c", "@", ".", "x.y", "1.2.3.4", "0255.1.1.1", "999", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (415) 555-0100", "+", "-", " ", "é", "b@c.d.@e.f", "12", "%", "555-123-4567", "0"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_base_spans(text):
    got = sorted(((s, e, k) for s, e, k, ok in pii.base_spans(text) if ok), key=lambda x: (x[0], pii.KINDS.index(x[2])))
    assert got == plain(text)
    base = {x[:3] for x in pii.candidates(text) if x[3]}
    assert base == set(got)


def test_long_runs_are_linear():
    for ch in ("a", "1", "@", "+", "1.", "a@", "- ", "4 "):
        pii.candidates(ch * 200_000)


def test_estimates():
    counts = {("phone", "11121"): 50, ("phone", "21201"): 40, ("phone", "21211"): 10, ("card", "11121"): 30, ("card", "01121"): 20, ("card", "00121"): 9}
    take = pii.accepted(counts)
    assert "card/01121" not in take and "card/00121" not in take and "phone/21201" not in take
    assert pii.estimate({}) == {} and pii.accepted({}) == []


def test_table(spark):
    ship(spark)
    texts = [None, "", "mail a.b@x.com now", "mail a.b@x.com now", "ip 10.0.0.1", "x" * 3_000 + " q@r.st", "call +14155550100", "card 4111 1111 1111 1111", "clean words only"] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("base", F.lit(1))
    got = {r.doc_id: r for r in pii.find_spans(df).collect()}
    for i, t in enumerate(texts):
        want = pii.joined(plain(t or ""))
        assert got[i].base_sha256 == pii.digest(want)
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
        assert got[i].n_email == sum(k == "email" for *_, k in plain(t or ""))
    assert got[8].spans == ""
    masked = {r.doc_id: r for r in pii.masked(df).collect()}
    assert masked[0].text is None and masked[2].text == "mail <EMAIL> now" and masked[8].text == "clean words only" and masked[7].text == "card <CARD>"
    assert pii.find_spans(df.limit(0)).count() == 0 and pii.masked(df.limit(0)).count() == 0
