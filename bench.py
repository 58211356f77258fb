"""Time the registered queries; prints one JSON line.

BENCH_SF_DIR: tables (default /root/testdata/sf0.1). BENCH_CPUS: local cores (default 8).
BENCH_QUERIES: space-separated names, "all", or unset for the headline list and the model list.

`value` is the sum over the headline list alone, which has not changed since the first round; `value_all` has every query run.
`planning` is the part of each time that passed before the frame was there: short jobs for sizes and cut points, model fits.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stayline.session import local_session  # noqa: E402
from stayline.workload import QUERIES  # noqa: E402

HEADLINE = """
scan_table valid_stays exclude_event_window lookup_join pattern_join range_next_event code_counts flag_pivot
distinct_weight_score minmax_pivot last_pivot mean_pivot_units ordered_string_agg argmin_row collect_structs
first_non_null weighted_mean collapse_intervals lead_next latest_row cap_entities hash_bucket_sample
stratified_kfold random_oversample duplicate_rows missing_table describe histogram quantile_bin_rate scaler_stats
scale_features pr_curve roc_auc threshold_sweep tokenize term_frequency lemma_normalize tfidf_long embed_attach
snippet label_lead label_any_unplanned label_fractional return_rate_by_segment cohort_admission
cohort_patient global_importance
""".split()

MODELS = """
tfidf nearest_neighbors smote param_search param_search_boosted fit_gbt stacking fuse_datasets_whole batch_embed
global_importance_wide metrics_of_many_groups cohort_admission_whole cohort_patient_whole tune_and_save
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "").split()
    names = list(QUERIES) if wanted == ["all"] else wanted or [*HEADLINE, *MODELS]
    spark = local_session(cpus, "stayline-bench")
    QUERIES["scan_table"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is not measured
    times: dict[str, float] = {}
    planning: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        frame = QUERIES[name](spark, sf_dir)
        planning[name] = round(time.perf_counter() - start, 3)
        frame.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    result = {
        "metric": "total_query_seconds", "value": round(sum(times[n] for n in names if n in HEADLINE or wanted), 3), "unit": "sec",
        "queries": times, "value_all": round(sum(times.values()), 3), "planning": planning,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
