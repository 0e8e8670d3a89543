"""The driver's contract, as a process without a Spark session sees it."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_can_be_listed_without_a_session():
    code = "import __spark_entry__ as e; print('NAMES', *e.queries()); assert e.oracle_sql()"
    got = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr[-800:]
    names = got.stdout.rpartition("NAMES")[2].split()
    assert all(any(n.startswith(f"p{i}_") for n in names) for i in range(1, 11))
