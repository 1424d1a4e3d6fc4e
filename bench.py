"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from careerloom.plans.catalogue import QUERIES  # noqa: E402
from careerloom.session import build_session  # noqa: E402

HEADLINE = [
    "school_outcomes", "founder_owner_flags", "franchise", "cofounder_flag", "founding_year", "employee_before_founder",
    "definition_crosstab", "exp_edu_join", "person_panel", "major_category", "cofounder_events", "cofounder_strict",
    "education_matched", "fuzzy_match", "name_match", "match_types", "name_embedding", "rank_auc",
    "finance_school_year", "profile_numeric", "profile_categorical",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        "careerloom-bench",
        spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
        spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["founder_owner_flags"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is not timed
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
