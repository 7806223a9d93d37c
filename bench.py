"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line with the seconds of each."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lodestone.plans.catalogue import QUERIES

HEADLINE = """bars_weekly recent_bars returns moving_averages bollinger_bands volatility_and_volume recursive_indicators feature_rows zscore_anomalies
 detection_run trading_calendar lexicon_sentiment entity_mentions keyword_terms keyword_topk vector_topk hybrid_rrf news_correlation graph_reachable graph_impact
 position_values upsert_merge stream_tumbling""".split()
#: A second run of these is timed too: code is compiled and Python workers are there.
AGAIN = ["returns", "zscore_anomalies", "keyword_topk", "news_correlation", "graph_reachable", "position_values"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
        "spark.sql.session.timeZone": "UTC",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["date_bounds"](spark, sf).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in [*HEADLINE, *AGAIN]:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[f"{name}_warm" if name in took else name] = round(time.time() - began, 3)
    total = round(sum(took[name] for name in HEADLINE), 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
