"""Run all registered queries against DuckDB: python tests/run_all.py [folder] [name ...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import compare  # noqa: E402

from fieldtally.plans import REGISTRY  # noqa: E402
from fieldtally.session import local_session  # noqa: E402

folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
chosen = sys.argv[2:]
spark = local_session(8)
con = compare.connect(folder)
bad = 0
for name, item in REGISTRY.items():
    if chosen and name not in chosen:
        continue
    start = time.time()
    try:
        text = compare.differences(item.plan(spark, folder), con, item.sql) if item.sql else "no SQL"
    except Exception as error:
        text = "ERROR " + str(error)[:1500]
        if chosen:
            traceback.print_exc()
    bad += text is not None
    print(f"{'ok  ' if text is None else 'BAD '} {name} {time.time() - start:.1f}s {text or ''}", flush=True)
print(len(REGISTRY), "queries,", bad, "bad")
