"""The search of many segments at once against the whole search of each."""

import random

import numpy as np
import public_tokenizers
from uttera.llm import pieces
from uttera.llm.common import Recent

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_many_against_each():
    model = pieces.Lattice(PATH)
    rng = random.Random(5)
    letters = "▁theinaosrlécß漢\x00\n😀,.("
    segments = list({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(3_000)}) + ["▁internationalisation", "a" * 200]
    for s, (ids, score, loss) in zip(segments, model.search(segments), strict=True):
        want = model.n_best(s, 2)
        assert (score, tuple(np.frombuffer(ids, np.int32))) == want[0], s
        assert loss == (want[0][0] - want[1][0] if len(want) > 1 else pieces.INFINITE), s


def test_results_do_not_depend_on_the_cache(monkeypatch):
    texts = [f"some words {k} and {k % 7} others é漢 " * 3 for k in range(300)]
    want = pieces.Lattice(PATH).encoded(texts)
    monkeypatch.setattr(pieces, "CACHE", 20)
    model = pieces.Lattice(PATH)
    assert [x for k in range(0, 300, 10) for x in model.encoded(texts[k : k + 10])] == want
    assert [model.encoded([t])[0] for t in texts] == want


def test_recent():
    known = Recent(2, {"a": 0})
    known.update(b=1, c=2, d=3)
    known.age()
    assert dict(known) == {"a": 0} and known.unknown({"a", "b", "x"}) == {"x"} and known["b"] == 1 and "b" in known
    known.update(e=4, f=5)
    known.age()
    assert known.unknown({"a", "b", "c", "d", "e"}) == {"c", "d"}
