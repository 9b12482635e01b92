"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from registry import QUERIES  # noqa: E402
from seatwise.workspace import close  # noqa: E402
from tests.session import session  # noqa: E402

HEADLINE = [
    "clean_assignments",
    "assigned_usage",
    "daily_feature_vector",
    "seat_samples",
    "contract_month_features",
    "prep_tabular_baseline",
    "prep_pooled",
    "apply_std_scaler",
    "group_split_exact",
    "write_split_sets",
    "auc_churn_months",
    "logreg_monthly",
    "sequence_monthly",
    "prep_seat_daily",
    "mlp_monthly",
    "hierarchical_monthly",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the executor threads
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    close(spark)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries, total time", "value": total, "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
