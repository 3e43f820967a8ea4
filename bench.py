"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from pagelens.plans.catalog_of_cases import all_cases
from pagelens.plans.fixtures import Tables
from pagelens.session import local_session

HEADLINE = [
    "H3_hit_test", "O18_page_objects", "O10_merge_hover", "O12_connected_components", "C6_walk_tree", "C7_inherit",
    "E1_decode_codes", "P5_apply_soft_mask", "T2_pen_positions", "T5_state_asof", "H8_dominant_page", "S2_extract_records",
    "R2_drop_superseded",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    cases = all_cases()
    spark.read.parquet(f"{folder}/region.parquet").count()  # starts the session before timing
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        cases[name][0](Tables(spark, folder)).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else None,
    }))


if __name__ == "__main__":
    main()
