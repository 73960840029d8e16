"""Time the headline queries and print one JSON line.

One run of each query is discarded, the better of the next two counts. Environment:
BENCH_SF_DIR (default sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma-separated
names, or ``all``).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from threadlens.plans.all import PLANS  # noqa: E402
from threadlens.session import local_session  # noqa: E402

HEADLINE = (
    "thread_scan",
    "thread_summary",
    "corpus_stats",
    "typed_table_export",
    "nested_rebuild",
    "label_merge",
    "merge_errors",
    "normalise_labels",
    "batch_pack",
    "parse_first_stamp",
    "token_count",
    "entry_title_flags",
    "frame_counts",
    "frame_ratio",
    "title_subgroups_fanout",
    "timeline_dense",
    "combined_timeline",
    "length_boxstats",
    "top_titles",
    "top_authors",
    "author_samples",
    "top_words",
    "top_bigrams",
    "source_overlap",
    "mention_descriptives",
    "propneg_by_year",
    "title_creation",
    "sentiment_timeline",
    "extreme_examples",
    "lexicon_sentiment",
    "model_score",
    "negativity_logit",
)

RUNS = 2


def run(spark, sf: str, name: str) -> float:
    start = time.perf_counter()
    PLANS[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(PLANS) if asked == "all" else [n for n in asked.split(",") if n] or list(HEADLINE)
    spark = local_session("bench", cores=os.environ.get("BENCH_CPUS", "8"), memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        run(spark, sf, name)
        times[name] = round(min(run(spark, sf, name) for _ in range(RUNS)), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
