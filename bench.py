"""Times the headline queries: one JSON line on stdout.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores. Every query runs
whole, into a sink that keeps nothing; the first pass warms the session up.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from devicelode.session import local_session  # noqa: E402
from wiring import QUERIES  # noqa: E402

HEADLINE = [
    "F2_search", "F3_paginate", "F3_paginate_deep", "F5_match_exact", "F6_match_partial", "G1_brands_with_devices", "G6_completion",
    "J1_unify", "J4_upsert", "J6_device_mentions", "J6_device_mentions_shuffled", "J9_compare", "K2_spec_rows",
    "K4_requested_specs", "K8_highlights", "N1_feature_tags_documents", "N6_analyze", "N11_tfidf_category",
    "N12_shipped_dictionaries", "E1_extract_links", "E5_extract_spec_rows", "E14_assemble_records", "R1_recommend",
    "W4_tier_slices", "W7_context", "W10_usage_running", "M2_rate_audit_minute", "M6_fold_status",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus)) if cpus.isdigit() else 8)
    QUERIES["G2_brand_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
