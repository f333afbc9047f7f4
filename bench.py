"""Headline timings; prints one JSON line.

``build_records`` is the ingest job over the whole derived log, written to a table.  ``stored_*`` are
panels over that table, as dashboards run them.  ``derived_*`` run from the events table through the
record job to the result in one plan.  Every query runs once to warm up and is timed on its second run.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from checks import registry
from loadlens.operators.records import build_records
from loadlens.operators.summary import finalize_states, summary_states
from loadlens.plans import catalog as C
from loadlens.session import local_session
from loadlens.sources.request_log import request_log
from loadlens.sources.tables import read_table, write_table

STORED = (
    "total_stress", "pie_application", "top_templates", "heaviest_operations", "top_cost_indicators", "trend_template",
    "es_latency", "status_by_operation", "score_breakdown", "error_rate", "top_users",
)
DERIVED = (
    "top_templates", "trend_operation", "dlq_count", "gateway_request_rate", "analyzer_latency", "latency_report",
    "latency_overhead", "write_integrity", "compressed_bodies",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="loadlens-bench-")
    spark = local_session("bench", cores=cores, memory="16g", **{"spark.checkpoint.dir": f"{folder}/shared"})
    seconds: dict[str, float] = {}

    def run(name: str, action) -> None:
        action(0)
        started = time.perf_counter()
        action(1)
        seconds[name] = round(time.perf_counter() - started, 3)

    def materialise(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    run("build_records", lambda n: write_table(
        build_records(request_log(spark, sf_dir)), "records", f"{folder}/records{n}"))
    records = read_table(spark, "records", f"{folder}/records1")
    rows = records.count()
    for name in STORED:
        run(f"stored_{name}", lambda n, panel=C.RECORD_PANELS[name]: materialise(panel(records)))
    run("stored_rollup", lambda n: write_table(summary_states(records), "summary", f"{folder}/summary{n}"))
    summary = read_table(spark, "summary", f"{folder}/summary1")
    run("stored_summary_finalize", lambda n: materialise(finalize_states(summary, ("request_operation", "cluster_name"))))
    queries = registry.queries()
    for name in DERIVED:
        run(f"derived_{name}", lambda n, query=queries[name]: materialise(query(spark, sf_dir)))
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of all queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "records": rows,
        "records_per_second_per_core": round(rows / seconds["build_records"] / int(cores), 1),
    }))


if __name__ == "__main__":
    main()
