"""Time the headline queries from raw tables to the last row and print one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

from barloom.queries import QUERIES
from barloom.session import build_session

HEADLINE = ["align_panel", "momentum_score", "top_n_sector_capped", "inverse_vol", "lexicon_score", "daily_sentiment", "sentiment_weights",
            "sector_cap", "rebalance_plan", "metrics", "trade_stats", "portfolio_equity", "walk_forward_select"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "barloom-bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["bar_coverage"](spark, folder).write.format("noop").mode("overwrite").save()   # start the engine
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
