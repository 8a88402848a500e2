"""Each stage takes effect and keeps the table's columns; the whole run is the stages one after another."""

import oracle
from uttera.llm import pii
from uttera.session import ship


def test_stages(spark, tmp_path):
    import corpus_pipeline

    ship(spark)
    docs = spark.read.parquet(f"{oracle.SF}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, oracle.SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "pii":
            assert not any(pii.base_spans(r.text) and any(x[3] for x in pii.base_spans(r.text)) for r in docs.collect())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] == sizes[4] == sizes[5]
    assert {"doc_id", "bucket_length", "batch", "slot"} <= set(docs.columns)
    key = ["doc_id", "bucket_length", "batch", "slot"]
    run = corpus_pipeline.run(spark, oracle.SF).select(*key)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.select(*key).collect()))
