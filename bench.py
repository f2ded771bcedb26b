"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. BENCH_QUERIES=all runs every registered query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetscore.plans.registered import queries  # noqa: E402
from fleetscore.session import get_session  # noqa: E402

HEADLINE = [
    "flatten_messages", "conversation_rollup", "flatten_eval_results", "factors", "richness_facts", "benchmark_facts",
    "space_scorecard", "feedback_flags", "benchmark_runs_monthly", "benchmark_run_trend", "benchmark_question_matrix",
    "fleet_rollup", "trend_users", "trend_quality", "daily_trends", "top_questions", "recent_errors", "run_series",
    "upsert_messages", "upsert_conversations", "strict_benchmark", "benchmark_rows", "scores_snapshot", "cockpit_rank",
    "band_listing", "matrix_cells", "deterministic_findings", "evidence_bundle", "grounded_steps", "space_improvements",
    "stream_ingest_messages", "stream_daily_trend", "stream_conversation_rollup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    plans = queries()
    names = list(plans) if os.environ.get("BENCH_QUERIES") == "all" else HEADLINE
    if os.environ.get("BENCH_QUERIES") not in (None, "", "all"):
        names = os.environ["BENCH_QUERIES"].split(",")

    def run(name: str) -> float:
        start = time.perf_counter()
        plans[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("space_scorecard")  # loads classes and compiles the common code once
    times = {name: run(name) for name in names}
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
