"""The pipeline on a small table without labels against plain Python: odd rows, near copies, personal data."""

import random
import re

from uttera.session import ship

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return len(w) < 50 or 100 * len(again) > 50 * len(w)


def shingles(text):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def stay(docs):
    """Ids of the smallest document of each group of near copies."""
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}
    for i in sorted(docs):
        for j in sorted(docs):
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    return {i for i, r in root.items() if r == i}


def test_against_plain_python(spark, tmp_path):
    import corpus_pipeline

    ship(spark)
    rng = random.Random(2)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    long = text(200)
    docs = {1: long, 2: long, 3: [*long[:100], "x", *long[101:]], 4: [*long[:20], *text(180)], 5: text(60), 6: text(49), 7: ["a", "b", "c"] * 40}
    docs |= {8: [*text(60), "a.b@mail.example.com", "4111", "1111", "1111", "1111", "end"], 9: [*docs[5][:-1], "y"]}
    rows = {i: " ".join(w) for i, w in docs.items()}
    odd = [(10, None), (11, ""), (12, " \t\n"), (None, None), (5, rows[5])]
    data = [(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in [*rows.items(), *odd]]
    types = "doc_id long, text string, lang string, source string, n_chars long, quality string, quality_rules int"
    sf = str(tmp_path / "sf")
    spark.createDataFrame(data, types).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    kept = stay({i: t for i, t in rows.items() if not fails(t)})
    assert kept == {1, 4, 5, 8}
    got, sizes = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        columns = got.columns
        stage(spark, got, sf).write.parquet(str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name))
        sizes.append(got.count())
        if name != "packing":
            assert got.columns == columns
        if name == "pii":
            texts = {r.doc_id: (r.text, r.n_chars) for r in got.collect()}
            masked = {i: rows[i].replace("a.b@mail.example.com", "<EMAIL>").replace("4111 1111 1111 1111", "<CARD>") for i in kept}
            assert texts == {i: (t, len(t)) for i, t in masked.items()}
    assert sizes == [8, 8, 4, 4, 4]  # a repeated row is a copy of the other
    assert {r.doc_id for r in got.collect()} == kept
    assert len({(r.bucket_length, r.batch, r.slot) for r in got.collect()}) == len(kept)


def test_empty_table(spark, tmp_path):
    import corpus_pipeline

    ship(spark)
    sf = str(tmp_path / "sf")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
