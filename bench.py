"""Wall seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs three times and its median counts, so the figure is that of a warm session; ``first`` has the first runs.
``first_search`` builds the search index and asks it once; the searches after it read the index.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from tidewater.plans import catalogue
from tidewater.session import local_session
from tidewater.workspace import ship

HEADLINES = [
    "tfidf_topk", "bm25_topk", "keyword_topk", "rrf_fusion", "salient_terms", "vocab_expansion", "embedding_topk", "dup_messages", "dup_conversations",
    "near_dup_jaccard", "shared_rare_links", "conv_stats", "conversation_export", "sessions", "work_blocks", "asof_join", "time_band_join", "same_session_links",
    "bfs_depth", "components", "pattern_join", "wl_fingerprint", "conflicts", "noisy_or", "entities_regex", "language_guess", "pricing_summary", "shipping_priority",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = ship(local_session(int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8)), "bench"))
    spark.range(1000).selectExpr("sum(id)").collect()  # the session is up

    def seconds(name: str) -> float:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    first, took = {"first_search": round(seconds("bm25_topk"), 3)}, {}
    for name in HEADLINES:
        runs = [seconds(name) for _ in range(3)]
        first[name], took[name] = round(runs[0], 3), round(median(runs), 3)
        print(name, first[name], took[name], file=sys.stderr)
    took["first_search"] = first.pop("first_search")
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "first": first, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
