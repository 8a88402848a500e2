"""The learned part: EM against a span-by-span computation, spans that it adds, what it leaves alone."""

import math
import re

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from uttera.llm import pii
from uttera.session import ship


def one_by_one(spans, rounds=100):
    """EM over single spans (kind, votes), in plain loops."""
    post = {}
    for x in set(spans):
        cast = [int(c) for c in x[1] if c != "2"]
        post[x] = {"1": 1.0, "0": 0.0}.get(x[1][0], (sum(cast) + 0.5) / (len(cast) + 1))
    for _ in range(rounds):
        right = {}
        for j in range(len(pii.LABELERS)):
            for vote, of in (("1", lambda p: p), ("0", lambda p: 1 - p)):
                n = sum(of(post[x]) for x in spans if x[1][j] != "2")
                hit = sum(of(post[x]) for x in spans if x[1][j] == vote)
                right[j, vote] = (hit + (n * pii.WEIGHT + 1) * pii.BELIEF) / (n + n * pii.WEIGHT + 1)
        nxt = dict(post)
        for x in set(spans):
            if x[1][0] != "2":
                continue
            open_ = [post[y] for y in spans if y[0] == x[0] and y[1][0] == "2"]
            m = len(open_)
            prior = (sum(open_) + (m * pii.WEIGHT + 1) / 2) / (m + m * pii.WEIGHT + 1)
            yes, no = math.log(prior), math.log(1 - prior)
            for j, c in enumerate(x[1]):
                if c != "2":
                    yes += math.log(right[j, "1"] if c == "1" else 1 - right[j, "1"])
                    no += math.log(right[j, "0"] if c == "0" else 1 - right[j, "0"])
            nxt[x] = 1 / (1 + math.exp(max(-50, min(50, no - yes))))
        post = nxt
    return post


PATTERN = st.tuples(st.sampled_from(pii.KINDS), st.text("012", min_size=5, max_size=5))


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(PATTERN, st.integers(1, 6), max_size=5))
def test_em_against_single_spans(counts):
    want = one_by_one([x for x, n in counts.items() for _ in range(n)])
    assert pii.estimate(counts) == pytest.approx(want, abs=1e-7)


def test_secrets_are_added(spark):
    """On the documents table: all keys in an assignment, and nothing in the same texts without their keys."""
    ship(spark)
    path = "/root/testdata/sf0.01/documents.parquet"
    texts = dict(zip(*pq.read_table(path, columns=["doc_id", "text"]).to_pydict().values(), strict=True))
    keys = {i: [m.span(1) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t or "")] for i, t in texts.items()}
    assert sum(map(len, keys.values())) >= 10
    for r in pii.find_spans(spark.read.parquet(path)).collect():
        added = [x for x in r.spans.split(",") if x.startswith("secret:")]
        assert added == [f"secret:{a}:{b}" for a, b in keys[r.doc_id]] and r.n_added == len(added)


@pytest.mark.parametrize("text", ["version 1.2.3 of the internationalisation-and-localisation guide", "see /usr/share/python3/site-packages/module", "a" * 40 + "1", "x" * 100])
def test_long_words_are_no_secrets(text):
    texts = [f'token = "{k:040x}"' for k in range(16**39, 16**39 + 50)] + [text]
    counts = {}
    for t in texts:
        for *_, kind, _, v in pii.candidates(t):
            counts[kind, v] = counts.get((kind, v), 0) + 1
    take = pii.accepted(counts)
    assert not [x for x in pii.candidates(text) if f"{x[2]}/{x[4]}" in take]


def test_masked_secret(spark):
    ship(spark)
    df = spark.createDataFrame([(k, f'key = "{(k + 7) * 0x9E3779B97F4A7C15F39CC0605CEDC8341082276B:040x}"'[:47] + '" end') for k in range(20)], "doc_id long, text string")
    assert {r.text for r in pii.masked(df).collect()} == {'key = "<SECRET>" end'}
