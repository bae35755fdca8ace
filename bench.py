"""Time the headline queries and print one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Each query runs once to
warm up and once for its time; results go to the no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

import pyspark

from claimspark.plans.queries import REGISTRY
from claimspark.session import local_session

HEADLINES = [
    "search_topk",
    "scraped_articles",
    "extractive_summary",
    "claims",
    "claim_review_exact",
    "claim_review_fuzzy",
    "claim_votes",
    "claim_votes_all",
    "classify_lexicon",
    "key_themes",
    "parse_responses",
    "analysis_summary",
    "article_upsert",
    "database_stats",
    "publish_rows",
    "analysed_articles",
]


def rows_in(spark, folder: str) -> dict[str, int]:
    return {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in ("pages", "documents", "benchmark")}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "claimspark-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINES:
        for _ in range(2):
            start = time.perf_counter()
            REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "spark": pyspark.__version__,
                "rows_in": rows_in(spark, folder),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
