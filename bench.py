"""Benchmark: run the query catalogue on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``.

Each query is run once to warm up, then built and run ``$BENCH_RUNS`` times
(median; the timing includes building the plan) with a ``noop`` sink, so the whole result is computed and
nothing is collected to the driver. Prints one JSON line.

The given tables are one file with one row group each, which one task reads. A
table at scale is many files, so the tables are first copied (untimed) to a
temporary folder as a few files each; the queries read the copies and do not
know of it.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gradewell.plans.catalog import QUERIES  # noqa: E402
from gradewell.session import build_session  # noqa: E402

# headline query -> driver table whose rows it processes (for rows/s)
HEADLINE = {
    "q_verifiable_reward": "conversations",
    "q_finance_reward": "lineitem",
    "q_prompt_reference": "documents",
    "q_group_advantage": "lineitem",
    "q_compare_variants": "documents",
}


TABLES = ("lineitem", "orders", "documents", "labels", "conversations", "events", "pages", "benchmark")


def spread(spark, sf_dir: str, folder: str, files: int) -> str:
    """Copies of the tables with ``files`` files each."""
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(files).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build_session(
        f"local[{cpus}]",
        app_name="gradewell-bench",
        shuffle_partitions=int(cpus) * 2,
        extra={"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    given, folder = sf_dir, tempfile.mkdtemp(prefix="gradewell-bench-")
    sf_dir = spread(spark, given, folder, int(cpus))
    timings: dict[str, float] = {}
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        samples = []
        for _ in range(runs):
            # planning is inside the timing: some operators checkpoint eagerly
            start = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(samples), 4)
    headline = {q: timings[q] for q in HEADLINE if q in timings}
    input_rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in set(HEADLINE.values())}
    throughput = {q: round(input_rows[HEADLINE[q]] / sec) for q, sec in headline.items() if sec > 0}
    sf = os.path.basename(given.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "catalogue_total_median_sec",
                "value": round(sum(timings.values()), 4),
                "unit": "sec",
                "queries": timings,
                "headline_sec": round(sum(headline.values()), 4),
                "headline_input_rows_per_sec": throughput,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                "runs": runs,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
