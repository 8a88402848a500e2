"""Stages called one by one where only the driver has the repository on its path."""

import os
import subprocess
import sys
from pathlib import Path

import oracle

CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", "file://" + sys.argv[3] + "/shared").getOrCreate()
import corpus_pipeline
docs = spark.read.parquet(sys.argv[2] + "/documents.parquet")
for name, stage in corpus_pipeline.STAGES:
    stage(spark, docs, sys.argv[2]).write.parquet(sys.argv[3] + "/" + name)
    docs = spark.read.parquet(sys.argv[3] + "/" + name)
    print("ENDED", name, docs.count() > 0)
"""


def test_stages_send_the_package(tmp_path):
    import corpus_pipeline

    root = Path(corpus_pipeline.__file__).parent
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", CODE, str(root), oracle.SF, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert [x.split()[1:] for x in said.stdout.splitlines() if x.startswith("ENDED")] == [[name, "True"] for name, _ in corpus_pipeline.STAGES], said.stderr[-2000:]
