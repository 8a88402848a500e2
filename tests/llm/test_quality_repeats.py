"""What fit() of the classifier sends to the driver where documents repeat."""

import numpy as np

from uttera.llm import quality_classifier as q


def _tables(spark, copies):
    rows = [(i, f"{'buy now cheap' if i % 3 else 'a river runs north'} word{i % 7} " + " ".join(f"w{i * 31 + j}" for j in range(40))) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    return spark.createDataFrame(rows * copies, "doc_id long, text string").repartition(8), labels, rows


def test_copies_are_featured_once(spark, monkeypatch):
    docs, labels, rows = _tables(spark, 50)
    sent, seen, old, train = [], [], type(docs).collect, q.train

    def collect(df):
        out = old(df)
        sent.append(sum(len(r["f"]) for r in out if "f" in r))
        return out

    monkeypatch.setattr(type(docs), "collect", collect)
    monkeypatch.setattr(q, "train", lambda x, good, *a: seen.append((x, good)) or train(x, good, *a))
    q.fit(docs, labels)
    assert sum(sent) == sum(len(q.slots(t)) for _, t in rows)
    # all rows are trained on, copies as often as they occur (the fifth that is held out aside)
    x = sorted((r for i, t in rows for r in [(i, q.slots(t))] * 50), key=lambda r: r)
    keep = np.arange(len(x)) % 5 != 4
    assert [list(f) for f in seen[0][0]] == [f for (_, f), k in zip(x, keep, strict=True) if k]


def test_the_bound_cuts_the_largest_hashes(spark, monkeypatch):
    docs, labels, _ = _tables(spark, 7)
    seen = []
    monkeypatch.setattr(q, "train", lambda x, good, *a: seen.append(len(x)) or q.Evidence(np.zeros(q.WIDTH), 0.0))
    q.fit(docs, labels, sample=60)
    assert seen == [96]  # four fifths of 120
