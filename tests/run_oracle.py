"""Compare every registered query, or those named, with its SQL: run_oracle.py [sf] [name...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from pyspark.sql import SparkSession

import __spark_entry__ as entry
from tests.compare import connect, difference

if __name__ == "__main__":
    sf = "/root/testdata/" + (sys.argv[1] if len(sys.argv) > 1 else "sf0.01")
    wanted = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            if name in sqls:
                why = difference(fn(spark, sf), con, sqls[name])
            else:
                n = fn(spark, sf).count()
                why = None if n else "EMPTY (no SQL)"
        except Exception as e:  # keep going, report at the end
            why = f"{type(e).__name__}: {str(e)[:700]}"
        bad += why is not None
        print(f"{'ok  ' if why is None else 'FAIL'} {name} {time.time() - t:.1f}s {why or ''}", flush=True)
    print("failures", bad)
