"""Python workers get the package from any working folder."""

import os
import subprocess
import sys

PROGRAM = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as contract
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", contract.queries()["ext_iforest"](spark, "/root/testdata/sf0.001").limit(3).count())
"""


def test_workers_find_the_package_from_another_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", PROGRAM.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600
    )
    assert "rows 3" in done.stdout, done.stderr[-2000:]
