"""The entry module works from any folder: its code is sent to the Python workers."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import importlib.util, sys
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry", sys.argv[1])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", entry.entry(spark).count())
"""


def test_entry_from_another_folder(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT, os.path.join(REPO, "__spark_entry__.py")],
        cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300,
    )
    assert "rows 10" in run.stdout, run.stderr[-3000:]


LACKING = """
import importlib.util, sys
sys.modules["tiktoken"] = sys.modules["tokenizers"] = sys.modules["xxhash"] = None
spec = importlib.util.spec_from_file_location("entry", sys.argv[1])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
print(*sorted(entry.queries()))
"""


def test_the_core_stays_where_a_library_of_the_rest_lacks():
    run = subprocess.run([sys.executable, "-c", LACKING, os.path.join(REPO, "__spark_entry__.py")], capture_output=True, text=True, timeout=300)
    from catalog.queries import QUERIES

    assert run.stdout.split() == sorted(QUERIES), run.stdout + run.stderr[-3000:]
