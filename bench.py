"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query starts without kept stages, so its time covers reading the tables.
"""
from __future__ import annotations

import json
import os
import time

from priorlake.plans import base, catalog
from priorlake.session import local_session

HEADLINES = [
    "flagship", "e1_prior_mean", "e3_prior_rate", "e6_split_features", "e14_expanding_share", "c4_asof_join",
    "e17_prior_sequence", "e22_lineup_stability", "d10_outcome_rates", "d27_distribution_summary", "j6_block_bootstrap",
    "j28_halflife_sweep", "i6_ridge", "i12_two_way_ratings", "k15_live_summary",
    "i7_poisson", "i9_random_forest", "i10_boosted_trees", "i15_outcome_model",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores))
    queries = catalog.queries()
    queries["c15_cutoff_join"](spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM and warm it up
    seconds = {}
    for name in HEADLINES:
        base.forget()
        spark.catalog.clearCache()
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(os.path.normpath(folder)),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
