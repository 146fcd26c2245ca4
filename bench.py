"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

t1_build_index builds the stored index that the search queries read. A search is timed as a service would answer it: the
median of five calls after a first one; every other query by a single run."""

from __future__ import annotations

import json
import os
import statistics
import time

from stackwise.plans import registry
from stackwise.session import build_session

HEADLINE = [
    "a2_recount", "a4_facets", "a7_link_check_counts", "f2d_same_edition", "f2e_providers", "j8_two_step_left", "j11_staged_inheritance",
    "w1_keep_first", "o1_links_desc", "o13_daily_ranking", "x11_canonical_url", "x14_hash_and_public_id", "t1_build_index", "t9_recall", "t14_search", "t14_search_marks", "t16_suggest",
    "e1_judge", "e6_merge_identities", "x6_parse_fragment", "x11_parse_link", "a1_fold_links", "media_detail", "r1_rate_limit", "r6_unknown_runs", "b32_link_check_round",
]

SEARCHES = ["t9_recall", "t14_search", "t14_search_marks", "t16_suggest"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus), memory=os.environ.get("BENCH_MEMORY", "8g"))
    queries, times = registry.queries(), {}
    queries["a2_recount"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compilers

    def timed(name: str) -> float:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    for name in HEADLINE:
        took = [timed(name) for _ in range(6 if name in SEARCHES else 1)]
        times[name] = round(statistics.median(took[1:] or took), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
