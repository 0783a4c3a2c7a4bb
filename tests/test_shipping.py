"""Executors import the package even when the driver runs outside the repository."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"

SCRIPT = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry_mod", "{REPO}/__spark_entry__.py")
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
q = m.queries()
names = [n for n in ("vector_search_batch", "hash_embed") if n in q]
for n in names:
    assert q[n](spark, "{SF}").count() > 0, n
print("OK", len(names))
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_udf_queries_from_another_working_directory(tmp_path):
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=600,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "OK" in out.stdout, out.stderr[-3000:]
