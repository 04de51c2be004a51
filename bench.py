"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from checks.compare import local_session
from checks.workload import LANGUAGES, QUERIES, corpus, table

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# Every registered query runs once, in this order, after the index was built (timed apart).
HEADLINE = [
    "chunk_documents", "postings", "embed_chunks", "keyword_topk", "vector_topk", "mmr_select",
    "hybrid_candidates", "rerank_topn", "quick_answer", "findings", "research_rounds", "research_report",
]


def warm_up(spark) -> None:
    """Start Python workers and compile the common plans on the smallest data folder."""
    small = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        QUERIES["quick_answer"](spark, small).collect()
    else:
        spark.range(1000).selectExpr("sum(id)").collect()


def main() -> None:
    spark = local_session(CPUS)
    spark.sparkContext.setLogLevel("OFF")
    warm_up(spark)
    names = sys.argv[1:] or HEADLINE + [name for name in QUERIES if name not in HEADLINE]
    start = time.perf_counter()
    built = corpus(spark, SF_DIR)
    built.index.forward.write.format("noop").mode("overwrite").save()
    index_build = round(time.perf_counter() - start, 3)
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    total = round(sum(seconds.values()), 3)
    documents = table(spark, SF_DIR, "documents").count()
    questions = table(spark, SF_DIR, "benchmark").count() * len(LANGUAGES)
    units = {"chunk_documents": documents, "keyword_topk": questions, "mmr_select": questions, "quick_answer": questions}
    rates = {f"{name}_per_sec": round(n / seconds[name], 1) for name, n in units.items() if seconds.get(name)}
    report = {"metric": "total_query_time", "value": total, "unit": "sec", "queries": seconds, "sf": float(sf)}
    print(json.dumps(report | {"index_build_sec": index_build, "rates": rates}))


if __name__ == "__main__":
    main()
