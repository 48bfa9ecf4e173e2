"""Compare registered queries with their SQL: check.py [sf] [name ...]."""

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from pyspark.sql import SparkSession  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tests.compare import compare, duck  # noqa: E402
from tracewright.session import build_session, drop_scratch  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(queries())
    sf_dir = f"/root/testdata/sf{sf}"
    if os.environ.get("CHECK_PLAIN"):  # nothing but Spark's defaults
        spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config(
            "spark.ui.enabled", "false").getOrCreate()
    else:
        spark = build_session(master="local[8]", extra={
            "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = duck(sf_dir), oracle_sql(), 0
    for name in names:
        t = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, queries()[name], sql[name], sf_dir)
            else:
                n = queries()[name](spark, sf_dir).count()
                problem = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - t:.1f}s"
              f"{'' if name in sql else ' (rows only)'} {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} good")
    drop_scratch(spark)
    spark.stop()
