"""Times the headline queries. Prints one JSON line.

BENCH_SF_DIR: folder of the tables; BENCH_CPUS: local cores; BENCH_RUNS: timed runs per query,
of which the median counts. One run before them warms up the JVM and the file cache. Every query
is run to its end, with all columns, into Spark's `noop` sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewright.plans.all import QUERIES  # noqa: E402
from tablewright.session import build_session  # noqa: E402

HEADLINE = """
    comma_join derived_table column_field cmp_property logic_tree like_any by_example_frame
    scalar_sub_correlated exists not_exists in_sub not_in_sub gt_any gt_all ne_all
    exists_having in_sub_correlated not_in_sub_correlated lt_all_correlated
    exists_inequality in_sub_correlated_limit in_sub_correlated_max
    join_range join_between_columns join_overlap
    join_inner join_left join_left_many join_full join_theta join_chain join_self relate_fk
    agg_distinct agg_distinct_several agg_expr agg_global group_by having
    order_multi top_k page page_deep page_deep_long
    set_union set_intersect set_minus set_nested
    math_basic math_bits template
    check_pk check_fk check_length identity_ids
    update_multi update_by_key update_subquery delete_where delete_join delete_join_chain
    delete_by_key cascade_delete cascade_delete_rows fk_set_null fk_update_cascade
    insert_rows insert_select batch_insert apply_changes apply_two_plans
""".split()


def run(build, spark, folder: str) -> float:
    start = time.perf_counter()
    build(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in HEADLINE:
        run(QUERIES[name], spark, folder)
        times = [run(QUERIES[name], spark, folder) for _ in range(runs)]
        timings[name] = round(statistics.median(times), 4)
    result = {
        "metric": "sum of median query times",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
