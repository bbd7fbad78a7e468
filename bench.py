"""Time the registered queries.

    BENCH_SF_DIR  folder of the tables   (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores            (default 8)
    BENCH_ONLY    comma-separated names  (default: all)

Queries of the operators for training data are not timed here: they have budgets of
their own (README).  Prints one JSON line.  Every query is run in full into a sink that keeps
nothing: first all in turn to warm up, on the smallest tables beside the given
ones, then once each for the time.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldtally.plans import REGISTRY  # noqa: E402
from fieldtally.session import local_session  # noqa: E402


def run(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    REGISTRY[name].plan(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    chosen = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n] or list(REGISTRY)
    spark = local_session(cores)
    smallest = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    for name in chosen:
        run(spark, smallest if os.path.isdir(smallest) else folder, name)
    times = {name: round(run(spark, folder, name), 3) for name in chosen}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of all registered queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
