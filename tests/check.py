"""Run queries against their oracle: python tests/check.py [sf_dir] [name ...]"""

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from compare import compare, duck  # noqa: E402
from tidemark.session import get_spark  # noqa: E402
import __spark_entry__ as entry  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = get_spark("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                         "spark.driver.memory": "16g", "spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1"})
spark.sparkContext.setLogLevel("ERROR")
con = duck(sf)
queries, oracle = entry.queries(), entry.oracle_sql()
bad = 0
start = time.time()
for name, fn in queries.items():
    if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
        continue
    t = time.time()
    try:
        df = fn(spark, sf)
        if name in oracle:
            err = compare(df, con, oracle[name])
        else:
            err = None if df.count() >= 0 else "x"
    except Exception as e:  # noqa: BLE001
        err = f"{type(e).__name__}: {str(e)[:1500]}"
    bad += err is not None
    print(f"{'ok  ' if err is None else 'FAIL'} {name} {time.time() - t:.2f}s{'' if name in oracle else ' (no oracle)'} {err or ''}", flush=True)
print(f"{bad} failed, {time.time() - start:.0f}s; queries {len(queries)}, oracles {len(oracle)}")
