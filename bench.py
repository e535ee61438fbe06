"""Benchmark: run the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set).  Each query is executed
in full with the ``noop`` sink (no collect to the driver); the time includes
any checkpoint the query takes.  One untimed warm-up run of the flagship on
the smallest data set comes first (BENCH_WARMUP_DIR).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "map_documents", "mapping_f1", "classify_docs", "fallback_header", "focus_content", "text_lines",
    "grid_markdown", "format_cells", "field_conflicts", "resolve_conflicts", "section_merge",
    "project_mapped", "value_vocabulary", "run_summary", "few_shot_messages", "html_cells",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]

    from gridmap.session import get_spark
    from gridmap.plans.catalog import QUERIES

    spark = get_spark(f"local[{cpus}]", app="gridmap-bench", shuffle_partitions=max(8, cpus * 2))
    # untimed warm-up on the smallest data set (JVM start, JIT, Python workers)
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        QUERIES["map_documents"](spark, warm).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)

    n_docs = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "map_documents_docs_per_sec": round(n_docs / times["map_documents"], 1) if "map_documents" in times else None,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
