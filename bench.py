"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR is the folder of tables (default /root/testdata/sf0.1), BENCH_CPUS the
number of local threads (default 8). The given tables are one file of one row group each, so
whatever is computed at the scan runs in one task; the queries in ``SPLIT`` are timed again
on the same rows in several files, written before the clock starts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from checks.compare import session
from checks.registry import QUERIES

HEADLINE = (
    "pages_to_report", "filter_sections", "filter_step_report", "sections", "sections_container",
    "headings", "page_title", "clean_text", "categorize_keywords", "dedup_first",
    "page_dump_remove", "prompt_batches", "apply_replies", "category_summary", "row_numbers",
    "page_breaks", "csv_roundtrip", "url_validate", "join_source_metadata",
)
SPLIT = ("pages_to_report", "filter_sections", "sections", "clean_text")
SPLIT_TABLES = ("documents", "pages")


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def timed(spark, names, sf_dir: str) -> dict[str, float]:
    return {name: round(run(spark, name, sf_dir), 3) for name in names}


def split(spark, sf_dir: str, files: int) -> str:
    folder = tempfile.mkdtemp(prefix="bench-")
    for table in SPLIT_TABLES:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        rows.repartition(files).write.parquet(f"{folder}/{table}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(cpus)
    names = sys.argv[1:] or HEADLINE
    run(spark, "word_count", sf_dir)  # starts the executor threads
    seconds = timed(spark, names, sf_dir)
    again = timed(spark, [n for n in names if n in SPLIT], split(spark, sf_dir, 2 * cpus))
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                "unit": "sec", "queries": seconds, "sf": float(sf) if sf[:1].isdigit() else sf,
                "queries_on_split_tables": again,
            }
        )
    )


if __name__ == "__main__":
    main()
