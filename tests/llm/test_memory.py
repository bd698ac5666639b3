"""Executors give back the heap that a stage has filled."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent.parent
CODE = """
import re, sys, time
from pathlib import Path
sys.path.insert(0, {root!r})
import psutil
from pyspark.sql import SparkSession, functions as F
from tickforge.llm._common import release
spark = (SparkSession.builder.master("local-cluster[1,2,1400]").config("spark.executor.memory", "1000m").config("spark.local.dir", {tmp!r})
         .config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate())
held = lambda: [sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", Path(f"/proc/{{p.pid}}/smaps_rollup").read_text()))) // 1024
                for p in psutil.Process().children(recursive=True) if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline())]
spark.range(3_000_000).select((F.col("id") % 1000).alias("k"), F.concat(F.lit("x" * 100), "id").alias("v")).groupBy("k").agg(F.collect_list("v")).write.format("noop").mode("overwrite").save()
before = held()[0]
release(spark)
time.sleep(3)  # the memory is unmapped in the background
print("MB", before, held()[0])
"""


def test_release_shrinks_executors(tmp_path):
    import pyspark

    (tmp_path / "home/work").mkdir(parents=True)  # executors work below Spark's home
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(tmp_path / "home"), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1"}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT), tmp=str(tmp_path))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    before, after = map(int, out.stdout.split("MB")[1].split())
    assert before > 600 and after < 0.7 * before, (before, after)
