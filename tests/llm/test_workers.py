"""Operators on workers that have no copy of the package."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import importlib.util, sys
sys.path.insert(0, sys.argv[1])
from tickledger.llm import queries
from tickledger.session import local_session

spark = local_session("far", 4, **{"spark.sql.shuffle.partitions": "4"})
found = spark.sparkContext.parallelize([0], 1).mapPartitions(lambda _: [importlib.util.find_spec("tickledger") is not None])
assert found.collect() == [False]
for name in sys.argv[3:]:
    print("rows", name, len(queries.QUERIES[name](spark, sys.argv[2]).collect()))
"""


def test_functions_travel_by_value(tmp_path, sf_dir):
    names = ["op3_language", "op5_decontamination", "op8_bpe", "op9_main_text", "op11_token_alignment", "op12_substring_dedup", "op13_prefix_trie"]
    environment = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    done = subprocess.run([sys.executable, "-c", SCRIPT, REPO, sf_dir, *names], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=900)
    assert [line.split()[1] for line in done.stdout.splitlines() if line.startswith("rows")] == names, done.stderr[-2000:]
