"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Prints one JSON line. ``datapool_build`` and ``model_build`` are the one-off
extraction of windows and training that the later queries read, as in production
use; every other entry is the time to build, plan and fully evaluate one query.
The list is a choice: filters and ranges, single scores, landing, the dataset cache
and model listings are left out; name them as arguments to time them.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidegauge.catalog import QUERIES
from tidegauge.catalog.models import stored_model
from tidegauge.catalog.registry import HOURLY, TUMBLING, pool
from tidegauge.session import get_spark

HEADLINE = [
    "window_features", "window_features_tumbling", "window_features_minute_slide", "stream_window_features",
    "datapool_scan", "spec_select", "spec_changes", "protocol_join", "gap_fill", "interpolate_linear",
    "estimate_window_spec", "first_difference", "sequence_windows", "horizon_target", "minmax_scale",
    "metric_bundle", "gram_matrix", "nonzero_levels", "mutual_information", "acf", "pacf", "adf_lag0", "adf",
    "croston", "croston_tsb", "ar1_fit", "ar1_forecast", "residual_anomaly", "train_forecaster", "train_run",
    "predict_run", "unit_conversion", "repair_numeric", "numeric_tsv_load", "partial_date_ranges",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up of the JVM's code paths is not part of any query.
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().write.format("noop").mode("overwrite").save()

    seconds: dict[str, float] = {}
    started = time.monotonic()
    for ws in (HOURLY, TUMBLING):
        pool(spark, sf_dir, ws)
    seconds["datapool_build"] = round(time.monotonic() - started, 3)
    started = time.monotonic()
    stored_model(spark, sf_dir)
    seconds["model_build"] = round(time.monotonic() - started, 3)
    for name in sys.argv[1:] or HEADLINE:
        started = time.monotonic()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.monotonic() - started, 3)
    spark.stop()
    result = {
        "metric": "headline query time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
