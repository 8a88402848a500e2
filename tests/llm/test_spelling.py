"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from uttera.llm import spelling as sp
from uttera.llm.common import written
from uttera.session import ship


def near(a, b):
    """By definition: one insertion, deletion or replacement."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    n = Counter()
    for id_, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    links = {w: sorted((-c, v) for v, c in n.items() if near(v, w)) for w in n}
    form = {w: links[w][0][1] if links[w] and -links[w][0][0] >= 5 * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(links[w]), n[form[w]] if form[w] else 0) for w in n)


def run(spark, docs, **kw):
    ship(spark)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as word", "'x' as form").repartition(3)
    out = sp.variants(df, **kw)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in out.collect())


def corpus(seed, alphabet, words, texts):
    r = random.Random(seed)
    base = ["".join(r.choice(alphabet) for _ in range(r.randint(6, 9))) for _ in range(words)]
    out = []
    for i in range(texts):
        text = []
        for _ in range(120):
            w = base[min(int(r.paretovariate(0.6)) - 1, words - 1)]
            if r.random() < 0.35:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice(alphabet) + w[k:], w[:k] + r.choice(alphabet) + w[k + 1 :]])
            text.append(r.choice([w, w, w.upper(), w.title()]) + r.choice([" ", "1", "Ā", ", ", "\U0001f600"]))
        out.append((r.choice([i, i, None, 3]), "".join(text)))
    return out


@pytest.mark.parametrize("tile", [2000, 3, 1])
def test_equals_brute_force(spark, tile):
    docs = corpus(tile, "abÿé", 25, 40) + [(7, None), (8, ""), (9, "× ÷÷÷÷÷÷ " * 6), (9, "× ÷÷÷÷÷÷ " * 6)]
    got = run(spark, docs, tile=tile)
    assert got == brute(docs) and sum(bool(r[1]) for r in got) > 20


def test_chains_ties_long_words_and_none(spark):
    text = "aaaaaa " * 3200 + "aaaaab " * 640 + "aaaabb " * 126 + "aaabbb " * 25 + "zzzzzzz " * 30 + "zzzzzzy " * 30 + "zzzzzzx " * 5 + ("q" * 5000 + " ") * 6 + ("q" * 5001 + " ") * 31
    got = run(spark, [(1, text)])
    assert got == brute([(1, text)])
    assert {r[0]: r[2] for r in got}["aaabbb"] == "aaaaaa" and {r[0]: r[1] for r in got}["zzzzzzx"] == "zzzzzzy"
    assert run(spark, []) == [] and run(spark, [(1, None), (None, "")]) == []


def test_candidates_lose_no_pair():
    r = random.Random(1)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(6, 8))) for _ in range(300)})
    for m in (6, 7, 8):
        own = [w for w in words if len(w) == m]
        index = sp.Postings(own)
        for w in words:
            got = {own[i] for i in index.candidates(w, m - len(w))} if m - len(w) in (0, 1) else set()
            assert {v for v in own if near(v, w) and len(v) >= len(w)} <= got
    assert all(sp.one_edit(a, b) == (near(a, b) and len(a) <= len(b)) for a in words for b in words)


def test_every_pair_shares_a_tile():
    r = random.Random(2)
    rank = {g: i for i, g in enumerate(sorted({x + y for x in " abc" for y in " abc"}, key=lambda _: r.random()))}
    tiles = lambda w: sorted((rank[g], p) for p, g in enumerate(sp.bigrams(w)))[:3]
    for _ in range(3000):
        a = "".join(r.choice("abc") for _ in range(r.randint(6, 9)))
        k = r.randrange(len(a))
        assert set(tiles(a)) & set(tiles(a[:k] + r.choice("abc") + a[k + 1 :]))
        own = set(tiles(a[:k] + r.choice("abc") + a[k:]))
        assert any((g, p + s) in own for g, p in tiles(a) for s in (0, 1))


def test_pairs_once(spark):
    words = spark.createDataFrame([("abcdef", 5), ("abcdeg", 6), ("abcdefg", 7)], "word string, n long")
    assert sorted(tuple(r) for r in sp.one_edit_pairs(written(words, "w")).collect()) == [("abcdef", 5, "abcdefg", 7), ("abcdef", 5, "abcdeg", 6), ("abcdeg", 6, "abcdefg", 7)]
