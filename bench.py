"""Benchmark: the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. Each query is run to the end (noop sink), so that no
column is pruned away and nothing is gathered on the driver. ``planning`` is the part of each
query's seconds before its last job starts: building the tables, jobs that settle the plan, and Catalyst.
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = (
    "site_unit", "site_unit_by_edges", "visible_units", "unit_coverage", "imagery_for_site",
    "rank_imagery_years", "rank_within_year", "top_imagery", "dedupe_spots", "number_points",
    "parse_elevations", "label_contours", "near_duplicate_lines", "to_utm", "tile_requests",
    "validate_rings", "reconcile_manifest", "validate_catalog", "sheet_readiness",
    "read_kml_polygons", "write_spot_csv", "latest_site", "tile_progress",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from sitesift.plans.catalog import QUERIES
    from sitesift.session import local_session

    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    QUERIES["unit_counts"](spark, folder).collect()  # registers the views, warms the JVM
    seconds, planning = {}, {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.time()
        df = QUERIES[name](spark, folder)
        df._jdf.queryExecution().executedPlan()
        planning[name] = round(time.time() - start, 3)
        df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "planning": planning, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
