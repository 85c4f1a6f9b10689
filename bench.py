"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from tracemill.plans import catalogue
from tracemill.session import local_session

HEADLINE = (
    "retry_groups", "tool_effectiveness", "ngram_sequences", "asof_last_purchase", "per_task_cost", "turn_latency_quantiles", "reliability_grouping_sets", "cost_trend_7d", "repo_rollup",
    "spend_by_model", "cost_by_tool_alloc", "top_expensive", "file_reread", "pin_split", "compaction_events", "compaction_risk", "message_merge", "hybrid_search", "near_dup_openers",
    "value_flow_edges", "bfs_neighborhood", "wilcoxon_ranks", "cosine_topk", "recs_ranked",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["spend_totals"](spark, sf).collect()  # start-up is not a query's
    seconds = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
