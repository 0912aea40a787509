"""The driver contract loads without a JVM, a Spark jar or a session."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]

PROBE = """
import glob, sys
real = glob.glob
glob.glob = lambda p, *a, **k: [] if str(p).endswith(".jar") else real(p, *a, **k)
import __spark_entry__ as e
qs, sqls = e.queries(), e.oracle_sql()
assert set(sqls) <= set(qs)
print("KEYS", len(qs), len(sqls))
"""


def test_queries_and_oracles_load_without_spark_jars():
    out = subprocess.run([sys.executable, "-c", PROBE], cwd=REPO, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    n, m = map(int, out.stdout.split("KEYS")[1].split())
    assert n >= 88 and m >= 84
