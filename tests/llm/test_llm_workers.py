"""The corpus operators run where the package cannot be imported on executors."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent.parent
CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from tickforge.llm.catalog import QUERIES
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
for name, query in QUERIES.items():
    assert query(spark, {sf!r}).count(), name
print("all ran")
"""


def test_no_import_on_workers(tmp_path, sf):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT), sf=sf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "all ran" in out.stdout, out.stderr[-2000:]
