"""Scores of whole texts and answers against brute force, where the texts are longer than a few words."""

import random
import time

import pytest

from test_text import edits
from uttera.functions.text import NUMBERS, PUNCTUATION
from uttera.operators.dsp import edit_distance, translation_edits
from uttera.plans.queries import QUERIES
from uttera.session import ship

DROP = str.maketrans("", "", PUNCTUATION)


def tokens(text):
    return text.lower().translate(DROP).split()


def documents():
    rng = random.Random(4)
    word = lambda: rng.choice(["Nine", "eight", "oito,", "co-op", "-", "the", "é"]) if rng.random() < 0.3 else f"w{rng.randrange(30)}"
    return [(k, " ".join(word() for _ in range(n)), "en" if k % 2 else "pt", "s", 0) for k, n in enumerate((0, 1, 11, 12, 13, 30, 61, 90))]


def pair(text):
    w = text.split()
    return w, [("eight" if i % 7 == 0 else x) for i, x in enumerate(w, 1) if i % 5]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    ship(spark)
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_word_errors_of_whole_texts(spark, sf):
    want, sums = [], {}
    for k, text, lang, *_ in documents():
        r, h = ([NUMBERS.get(x, x) for x in tokens(" ".join(side))] for side in pair(text))
        want.append((k, len(r), edits(r, h)))
        for key in (lang, "all"):
            sums[key] = [a + b for a, b in zip(sums.get(key, (0, 0)), want[-1][1:], strict=True)]
    assert sorted(map(tuple, QUERIES["wer_pairs"](spark, sf).collect())) == want
    got = {r.lang: [r.n_ref, r.edits] for r in QUERIES["wer_corpus"](spark, sf).collect()}
    assert got == sums and got["all"][0] > 190


def test_translation_edits_of_whole_texts(spark, sf):
    got = {r.doc_id: (r.n_ref, r.edits) for r in QUERIES["ter"](spark, sf).collect()}
    for k, text, *_ in documents():
        r = tokens(text)
        half = (len(r) - 5) // 2
        h = [*r[5 : 5 + half], *r[:5], *r[5 + half :]] if len(r) >= 20 else list(r)
        h = ["eight" if i % 400 == 0 else w for i, w in enumerate(h, 1)]
        assert got[k] == (len(r), greedy(r, h) if len(r) < 40 else translation_edits(r, h))
    assert got[7][1] <= 1 + 5


def test_shifts_of_a_long_text():
    rng = random.Random(1)
    ref = [f"w{rng.randrange(2000)}" for _ in range(3000)]
    hyp = list(ref)
    for _ in range(10):
        i, n = rng.randrange(len(hyp) - 12), rng.randint(3, 9)
        block = hyp[i : i + n]
        del hyp[i : i + n]
        at = rng.randrange(len(hyp))
        hyp[at:at] = block
    start = time.perf_counter()
    assert translation_edits(ref, hyp) <= 12 and time.perf_counter() - start < 60


def greedy(ref, hyp, max_shift=10):
    """translation_edits with every shift tried."""
    best, shifts = edits(ref, hyp), 0
    grams = {tuple(ref[i : i + n]) for n in range(1, max_shift + 1) for i in range(len(ref) - n + 1)}
    while best:
        found = None
        for i in range(len(hyp)):
            for n in range(1, min(max_shift, len(hyp) - i) + 1):
                block, rest = hyp[i : i + n], hyp[:i] + hyp[i + n :]
                if tuple(block) not in grams:
                    break
                for at in range(len(rest) + 1):
                    d = edits(ref, moved := rest[:at] + block + rest[at:])
                    if d + 1 < best and (found is None or d < found[0]):
                        found = (d, moved)
        if found is None:
            break
        best, hyp, shifts = found[0], found[1], shifts + 1
    return best + shifts


@pytest.mark.parametrize("cells", [25_000_000, 0])
def test_distances_against_all(monkeypatch, cells):
    monkeypatch.setattr("uttera.operators.dsp.CELLS", cells)
    rng = random.Random(9)
    for _ in range(250):
        some = "abcdefgh"[: rng.randrange(1, 9)]
        ref = [rng.choice(some) for _ in range(rng.randrange(12))]
        hyp = list(ref)
        for _ in range(rng.randrange(4)):
            i, n = rng.randrange(len(hyp) + 1), rng.randrange(1, 4)
            block, hyp = hyp[i : i + n], hyp[:i] + hyp[i + n :]
            at = rng.randrange(len(hyp) + 1)
            hyp = hyp[:at] + block + [rng.choice(some + "z")] * rng.randrange(2) + hyp[at:]
        assert edit_distance(ref, hyp) == edits(ref, hyp)
        assert translation_edits(ref, hyp) == greedy(ref, hyp)


def test_answers_are_scored_whole(spark, tmp_path):
    ship(spark)
    rng = random.Random(6)
    answers = [" ".join(rng.choice(["Co-op", "a,", "b", "c", "é"]) + str(rng.randrange(4)) for _ in range(n)) for n in (0, 2, 3, 12, 13, 14, 40)]
    turns = [(k, t, "user" if t % 2 == 0 else "assistant", x) for k, a in enumerate(answers) for t, x in ((k * 2, "q"), (k * 2 + 1, a))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in QUERIES["em_f1_turns"](spark, str(tmp_path)).collect()}
    rows = {r.conv_id: r for r in QUERIES["em_f1_rollup"](spark, str(tmp_path)).collect()}
    for k, answer in enumerate(answers):
        gold = tokens(answer)
        pred = {0: gold, 1: ["well", *gold, "indeed"], 2: gold[3:]}[k * 2 % 3]
        common = sum(min(gold.count(w), pred.count(w)) for w in set(gold))
        f1 = 1.0 if not gold and not pred else 0.0 if not gold or not pred else 2 * common / (len(gold) + len(pred))
        held = int(" ".join(gold) in " ".join(pred))
        assert (got[k].em_strict, got[k].em_contains, got[k].f1) == (int(gold == pred), held, round(f1, 6))
        assert (rows[k].em, rows[k].em_contains, rows[k].f1) == (int(gold == pred), held, round(f1, 6))
    assert got[4].f1 == round(2 * 10 / 23, 6) and [got[k].em_contains for k in (4, 5)] == [0, 1]
