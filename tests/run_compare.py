"""Compare registered queries with their SQL: python tests/run_compare.py SF_DIR [name-prefix ...]."""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from tests.compare import connect, differences  # noqa: E402
from voxlake.plans import catalog  # noqa: E402
from voxlake.session import build_session  # noqa: E402

sf_dir, prefixes = sys.argv[1], sys.argv[2:]
spark = build_session(cpus=8, **{"spark.sql.shuffle.partitions": "8"})
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf_dir)
for name, fn in catalog.QUERIES.items():
    if prefixes and not any(name.startswith(p) for p in prefixes):
        continue
    t = time.time()
    try:
        if name in catalog.ORACLES:
            bad = differences(spark, con, sf_dir, fn, catalog.ORACLES[name])
            verdict = "; ".join(bad) if bad else "ok"
        else:
            verdict = f"rows {len(fn(spark, sf_dir).collect())}"
    except Exception as e:  # noqa: BLE001
        verdict = "ERROR " + str(e)[:900].replace("\n", " ")
    print(f"{name}: {verdict} ({time.time() - t:.1f}s)", flush=True)
