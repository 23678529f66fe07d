"""The public functions work in an application that called nothing before, with
workers that cannot import the package from their own path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import os, sys
sys.path.insert(0, {root!r})  # the driver's path only: workers start in another folder
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from budgetlens.llm import {module}
docs = spark.createDataFrame([(i, "some words that go on and on " * (i % 3 + 2), "en" if i % 2 else "fr") for i in range(6)], "doc_id long, text string, lang string")
print("rows", len({call}.collect()))
"""
CALLS = {"superminhash": "superminhash.near_duplicates(docs)", "passages": "passages.seeds(docs.selectExpr('doc_id as doc', 'text'))",
         "langid": "langid.predict(docs, langid.train(docs))", "triefrontier": "triefrontier.word_counts(docs)"}


def test_functions_ship_the_package(tmp_path):
    for module, call in CALLS.items():
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, module=module, call=call)], cwd=tmp_path,
                              env=env, capture_output=True, text=True, timeout=180)
        assert "rows" in done.stdout, (module, done.stderr[-2000:])
