"""Task functions reach the workers by value: a session started elsewhere needs no package path."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for name in ("vector_topk", "retrieve_topk", "tree_attribution"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_need_no_package_path(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True,
        timeout=400,
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert "vector_topk 40" in done.stdout
