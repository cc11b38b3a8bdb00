"""Time the registered queries and print one JSON line.

BENCH_SF_DIR  folder of the tables  (default /root/testdata/sf0.1)
BENCH_CPUS    local cores           (default 8)
BENCH_ONLY    comma-separated name prefixes, default the headline queries; ``all`` for every query
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kinweave.plans.catalogue import QUERIES  # noqa: E402
from kinweave.session import build_session  # noqa: E402

HEADLINE = [
    "a01_", "a02_", "a06_", "a07_", "a09_", "a11_label", "a12_", "a15_", "a18_", "a23_", "a25_", "a26_", "a31_", "a33_infobox",
    "d01_", "d05_", "g08_quantile_flag", "g12_", "j07_", "j13_", "n01_edges", "n05_", "n09_components", "n12_", "n14_betweenness",
    "n15_communities", "n23_", "s03_", "s10_", "s11_", "u05_", "w01_", "w08_", "x09_", "x12_", "x22_",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = os.environ.get("BENCH_ONLY")
    prefixes = HEADLINE if not only else [""] if only == "all" else only.split(",")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["a01_endogamy_by_country"](spark, sf_dir).collect()  # warm-up, not timed
    times = {}
    for name, fn in QUERIES.items():
        if any(name.startswith(p) for p in prefixes):
            start = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
            print(name, times[name], file=sys.stderr, flush=True)
    found = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "kinship_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(found.group(1)) if found else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
