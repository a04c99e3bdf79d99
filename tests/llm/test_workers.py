"""Queries on executors that have no copy of the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

RUN = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = (
    SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
    .config("spark.executorEnv.PYTHONPATH", "").getOrCreate()
)
for name in {names!r}:
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_every_query_with_python_tasks_runs_from_an_empty_folder(tmp_path):
    names = ["op2_shingle_join", "op3_byte_bpe", "op4_radix_dedup", "op7_section_token_counts", "op8_quality_classifier", "op10_learned_partitions",
             "op11_multi_index", "op12_ranked_search", "op13_phrase_mining", "pipeline"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", RUN.format(root=ROOT, names=names)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.split()[0] in names] == names
