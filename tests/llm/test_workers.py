"""The operators that send objects of the library run where workers cannot import it."""

import os
import subprocess
import sys

import pytest

SF_DIR = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: The driver finds the library by its own path only, which workers do not inherit.
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
outside = spark.range(1).mapInPandas(
    lambda parts: (p.assign(id=int(__import__("importlib.util").util.find_spec("tablescope") is not None)) for p in parts), "id long")
assert outside.first()[0] == 0, "workers see the library"
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
for name in sys.argv[3:]:
    print(name, entry.queries()[name](spark, sys.argv[2]).count() > 0)
"""


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not mounted")
def test_without_the_library_on_the_workers(tmp_path):
    names = ["op5_html_main_text", "op8_toxicity", "op12_filter_interaction_audit", "op13_language_id", "str_throttle"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    (tmp_path / "run.py").write_text(SCRIPT)
    done = subprocess.run([sys.executable, "run.py", ROOT, SF_DIR, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [line for line in done.stdout.splitlines() if line.split()[0] in names] == [f"{n} True" for n in names]
