"""Time the headline queries and print one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma-separated names) choose data, cores and queries. The
estate that most queries read is derived from the given tables: ``queries`` are times with that, and
``queries_on_tables`` times over the same estate written to a scratch folder before.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from checks.catalogue import QUERIES
from checks.fixtures import write_views
from rehome.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
HEADLINE = (
    "workspace_map recovery_map item_id_map unique_map old_item_lookup lookup_items resolve_item "
    "git_plan role_plan report_plan model_source copy_plan pointer_plan tables_to_copy_json plan_payloads "
    "list_objects list_schema_tables src_json_records load_type_conversion extract_refs ref_status "
    "swap_all changed_definitions notebook_lakehouse_plan notebook_warehouse_plan"
)


def main() -> None:
    names = os.environ.get("BENCH_QUERIES", HEADLINE.replace(" ", ",")).split(",")
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "4g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF_DIR}/region.parquet").count()
    def timed() -> dict[str, float]:
        took = {}
        for name in names:
            start = time.perf_counter()
            # Every row and column is computed and nothing is kept.
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
        return took

    took = timed()
    write_views(spark, SF_DIR, tempfile.mkdtemp(prefix="bench-"))
    on_tables = timed()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "value_on_tables": round(sum(on_tables.values()), 3),
                "queries_on_tables": on_tables,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
