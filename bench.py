"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

import json
import os
import time

from quireflow.plans import catalog
from quireflow.session import session

HEADLINE = ["d3_corpus_duplication", "d7_copy_ratio", "w5_vector_top_k", "r1_bm25_search", "r4_hybrid_search", "k22_bootstrap_interval", "n12_benford", "a6_usage_summary", "a1_facets", "w2_latest_per_key", "n36_whole_audit", "e2_duplicate_groups"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(f"local[{os.environ.get('BENCH_CPUS', '8')}]", "bench", spark__sql__shuffle__partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["a1_facets"](spark, sf).count()  # starts the executors' threads and the code generator
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
