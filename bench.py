"""Time the headline queries; prints one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times; the median counts. The
result is written to the no-op sink, so Python never receives the rows.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from larder.plans import load_all
from larder.session import local_session

HEADLINE = [
    "win_dedupe_lowest_price", "join_substitutes", "fulltext_score", "topk_offers", "upsert_by_key",
    "insert_if_absent", "agg_ingredient_totals", "join_tiered_price", "agg_shopping_stats", "join_plan_enrich",
    "agg_plan_summary", "agg_nutrient_pivot", "agg_best_source", "agg_merge_duplicate_foods", "nested_merge_by_key",
    "join_message_visibility", "bounded_link_reachability", "win_list_admission", "parse_price", "offer_tile_json",
    "jsonld_recipe", "clean_html_text", "sanitize_lines", "dedupe_lines", "html_page_source",
    "agg_outcome_counts", "stream_message_fanout", "stream_quota_windows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    picked = sys.argv[1:] or HEADLINE
    registry = load_all()
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    times = {}
    for key in picked:
        laps = []
        for lap in range(runs + 1):
            start = time.perf_counter()
            registry[key].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if lap:
                laps.append(time.perf_counter() - start)
        times[key] = round(statistics.median(laps), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale, "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
