"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from actorlens.plans.catalog import QUERIES
from actorlens.session import build_session

HEADLINE = [
    "inner_join_bidders",
    "left_join_features",
    "count_by_country_bucket",
    "pivot_country_label",
    "profile_by_url",
    "bidder_distinct_profile",
    "gaps_by_bidder",
    "gaps_by_bidder_auction",
    "auction_responder_gaps",
    "per_bidder_features",
    "cumulative_frequency",
    "negentropy_by_attribute",
    "boxplot_by_label",
    "stratified_split",
    "knn_impute_pairs",
    "ordinal_features",
    "onehot_features",
    "auc_of_entities",
    "auc_by_group",
    "rf_cv_auc",
    "svm_cv_auc",
    "rf_submission",
    "svm_submission",
    "standardize_knn_impute",
    "rf_multiclass_accuracy",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "actorlens-bench",
        f"local[{cpus}]",
        {
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The first query of a session pays for class loading; an untimed one takes that out.
    QUERIES["profile_by_merchandise"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
