"""Print the physical plans of representative queries over a stored index (the content of PLANS.md).

    python -m capindex.plans.report /root/testdata/sf0.01 > PLANS.md
"""

from __future__ import annotations

import re
import sys

from ..session import local_session, scratch_path
from ..sources import adapter as A
from ..sources import store
from . import catalog
from .guards import physical_plan

SHOWN = {
    "url_summary": "URL equality reaches the scan (row groups skipped by min/max on the sorted store)",
    "prefix_distinct": "prefix as StringStartsWith in PushedFilters; distinct as partial + final aggregate",
    "facet_arc_zero": "zero counts in one aggregation pass (count_if), no join against distinct values",
    "first_per_digest": "first capture per (url, digest) as a map-side combined min over a struct",
    "upsert_overlap": "new rows reduced per key; the old side streams through a broadcast anti join",
    "closest_bulk": "one exchange of captures + requests by (url, range); up to one range nothing is carried across borders",
    "offset_page": "global order + offset + limit as one TakeOrderedAndProject",
}

_NOISE = re.compile(r"#\d+L?|\[plan_id=\d+\]")


def main(sf_dir: str) -> None:
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    path = scratch_path(spark, "plans-store")
    store.write_layout(A.captures(spark, sf_dir), path, 8)
    caps = spark.read.parquet(path)
    print("# PLANS\n")
    print("Physical plans (`explain()`, ids stripped) of representative registered queries over the stored")
    print(f"index (range-partitioned and sorted by url, date, id), from `python -m capindex.plans.report {sf_dir}`.\n")
    for name, why in SHOWN.items():
        df = catalog.QUERIES[name](spark, sf_dir, caps)
        text = physical_plan(df, "simple")
        text = _NOISE.sub("", text).replace(path, "<store>")
        print(f"## {name}\n\n{why}.\n\n```\n{text.strip()}\n```\n")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
