"""The driver contract from a foreign working directory with a plain SparkSession.

Queries whose work runs in executor Python (workbook decoding) must not
depend on the driver's cwd or sys.path: the package is shipped to executors.
"""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = textwrap.dedent(f"""
    import importlib.util, json
    spec = importlib.util.spec_from_file_location("__spark_entry__", {os.path.join(ROOT, "__spark_entry__.py")!r})
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "4").getOrCreate())
    out = {{"entry": m.entry(spark).count(),
           "workbook": m.queries()["workbook_content_metrics"](spark, "/root/testdata/sf0.001").count(),
           "own": sorted(m.catalog.QUERIES), "oracles": sorted(m.oracle_sql()), "queries": sorted(m.queries())}}
    print("RESULT " + json.dumps(out))
    spark.stop()
""")


def test_contract_from_foreign_cwd(scratch):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    proc = subprocess.run([sys.executable, "-c", SCRIPT], cwd=scratch, env=env, capture_output=True, text=True,
                          timeout=900)
    line = [ln for ln in proc.stdout.splitlines() if ln.startswith("RESULT ")]
    assert line, proc.stderr[-3000:]
    import json

    got = json.loads(line[0][len("RESULT "):])
    assert got["entry"] > 0 and got["workbook"] > 0
    assert set(got["own"]) <= set(got["oracles"]) <= set(got["queries"])
