"""Times headline queries and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "macro_redundancy", "flagged_sentences", "sentence_stats", "token_counts", "near_duplicate_sentences", "findings_export", "mean_of_means_index", "score_coverage", "longest_run", "event_islands",
    "majority_vote", "newest_wins_dedup", "innermost_span", "upper_median", "vote_tally", "session", "embedding_neighbours",
]


def main() -> None:
    data, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    from vellum.plans import catalog
    from vellum.session import session

    spark = session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, spark__driver__memory="12g")
    queries, took = catalog.queries(), {}
    queries["source_facets"](spark, data).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, data).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(data.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
