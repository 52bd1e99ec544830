"""Times the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]`` and prints one JSON line.

``BENCH_RUNS`` runs of each query (1 by default), of which the median is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "w01_shifted_rolling_mean", "w02_shifted_rolling_sum", "w05_form_points", "w06_form_points_split", "w07_shots_corners_avg",
    "w08_h2h_points", "w10_windowed_winrate", "w12_matches_last_n_days", "w13_season_points_before", "w14_table_position_before",
    "w25_cumulative_record", "x05_feature_set", "e01_elo_history", "e05_bounded_counter", "e06_state_as_of",
    "j01_join_on_match", "j06_self_range_join", "j07_asof_join", "j11_coverage", "a03_side_stats", "a08_describe",
    "n05_iqr_robust", "k05_disagreement", "v12_future_correlation", "v17_split_integrity", "r01_pearson_pairs", "r02_spearman_pairs",
    "m02_time_series_folds", "m14_class_report", "m17_roc_auc", "o03_last_n_split", "e01b_elo_time_blocks", "m04_train_forest", "t01_stream_elo",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from formline.plans.catalog import QUERIES
    from formline.session import local_session

    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/orders.parquet").count()
    QUERIES["w05_form_points"](spark, folder).write.format("noop").mode("overwrite").save()  # warm the JVM
    times = {}
    for name in names:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "1"))):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
