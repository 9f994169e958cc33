"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from docengine.queries import QUERIES
from docengine.session import session

HEADLINE = [
    "J2_rank_then_filter", "J8_undone_work", "A3_hourly_with_gaps", "A12_histogram", "A13_unit_adoption", "A16_kleene", "D10_numeric_delta", "D15_group_verdict",
    "D26_requirements", "D33_protocol", "J12_period_covered", "J16_chains", "A30_fingerprint", "W13_recurring_lines", "D4_regex_plan", "J23_iou_join", "A26_confusion",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["A1_count_by_state"](spark, folder).collect()  # starts the workers
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
