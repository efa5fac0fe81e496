"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidalframe.plans import catalog
from tidalframe.session import build_session

HEADLINE = [
    "a11_healthy_share", "c1_clean_missing", "c2_infer_numeric", "a3_null_summary", "a4_missing_by_group",
    "a6_distinct_counts", "a9_histogram", "a10_describe_exact", "a14_spearman_matrix", "a16_normal_qq_fit", "a20_roc_auc",
    "w1_stratified_split", "w2_stratified_folds", "w3_average_rank", "w5_early_stop", "w7_equalize_by_group",
    "j1_multi_year_rows", "j5_grid_lookup", "u1_drop_duplicate_rows", "m1_impute_median", "m4_fit_preprocessor",
    "m11_logistic_l2", "m18_score_linear", "r3_predict_job", "i4_gray_world_then_stretch", "i5_local_contrast",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    catalog.load_all()
    spark = build_session("bench", cores)
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
