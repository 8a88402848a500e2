"""Sources that fail: statuses, retries, fallback file by file, resume."""

import pytest
from pyspark.sql import functions as F

from uttera.sources import faulty


@pytest.fixture
def source(spark, tmp_path):
    for k in range(4):
        spark.range(k * 10, k * 10 + 5 + k).select(F.col("id").cast("string").alias("ID"), F.lit("x").alias("wav")).coalesce(1).write.parquet(f"{tmp_path}/f{k}")
    (tmp_path / "broken.parquet").write_bytes(b"PAR1 this is no Parquet file")
    return tmp_path, [f"{tmp_path}/f{k}" for k in range(4)] + [f"{tmp_path}/broken.parquet", f"{tmp_path}/missing.parquet"]


def test_statuses_and_no_lost_rows(spark, source):
    folder, urls = source
    waits = []
    rows = faulty.read_all(spark, urls, f"{folder}/out", f"{folder}/status", batch=3, sleep=waits.append)
    assert sorted(int(r.ID) for r in rows.select("ID").collect()) == sorted(i for k in range(4) for i in range(k * 10, k * 10 + 5 + k))
    got = {r.url.rsplit("/", 1)[-1]: (r.status, r.attempts, r.rows) for r in faulty.status(spark, f"{folder}/status").collect()}
    assert [got[f"f{k}"] for k in range(4)] == [("read", 1, 5 + k) for k in range(4)]
    assert got["broken.parquet"] == ("given up", 2, 0) and got["missing.parquet"][0] == "given up" and got["missing.parquet"][2] == 0
    reasons = {r.url.rsplit("/", 1)[-1]: r.reason for r in faulty.status(spark, f"{folder}/status").collect()}
    assert reasons["f0"] is None and reasons["broken.parquet"] and reasons["missing.parquet"]
    assert waits and set(waits) == {10.0}


def test_resume_and_again(spark, source):
    folder, urls = source
    calls = []

    def read(s, some):
        calls.append(list(some))
        return s.read.parquet(*some)

    faulty.read_all(spark, urls[:2], f"{folder}/out", f"{folder}/status", read=read)
    faulty.read_all(spark, urls, f"{folder}/out", f"{folder}/status", read=read, sleep=lambda _: None)
    assert calls[0] == urls[:2] and all(u not in urls[:2] for some in calls[1:] for u in some)
    n = len(calls)
    assert faulty.read_all(spark, urls, f"{folder}/out", f"{folder}/status", read=read, sleep=lambda _: None).count() == 26 and len(calls) == n
    spark.range(3).select(F.col("id").cast("string").alias("ID"), F.lit("x").alias("wav")).write.parquet(urls[5])
    assert faulty.read_all(spark, urls, f"{folder}/out", f"{folder}/status", read=read, sleep=lambda _: None, again=True).count() == 29
    last = {r.url: r.status for r in faulty.status(spark, f"{folder}/status").collect()}
    assert last[urls[5]] == "read" and last[urls[4]] == "given up" and len(last) == 6


def test_transient_failures_are_tried_again(spark, source):
    folder, urls = source
    waits, left = [], [3]

    def flaky(s, some):
        if left[0]:
            left[0] -= 1
            raise OSError("503 Service Unavailable")
        return s.read.parquet(*some)

    faulty.read_all(spark, urls[:2], f"{folder}/out", f"{folder}/status", read=flaky, sleep=waits.append)
    assert waits == [15.0, 30.0, 60.0] and {(r.status, r.attempts) for r in faulty.status(spark, f"{folder}/status").collect()} == {("retried", 4)}
    left[0], waits[:] = 99, []
    faulty.read_all(spark, urls[2:3], f"{folder}/out2", f"{folder}/status2", read=flaky, sleep=waits.append)
    assert waits == [15.0, 30.0, 60.0, 120.0, 240.0, 300.0] and faulty.status(spark, f"{folder}/status2").first().reason == "503 Service Unavailable"
    assert faulty.read_all(spark, [], f"{folder}/out3", f"{folder}/status3").count() == 0
