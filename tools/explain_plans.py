"""Print the executed physical plan of catalogue queries and flag unwanted operators.

Usage: python tools/explain_plans.py [--sf DIR] [--no-broadcast] [name-regex ...]

For each query: number of exchanges, and whether the plan contains a cartesian product,
a nested-loop join or Python evaluation. ``--no-broadcast`` disables broadcast joins to
show the plan a large cluster gets when no side is small.
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.plans import registry  # noqa: E402
from tidemark.session import build_session  # noqa: E402

FLAGS = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--no-broadcast", action="store_true")
    ap.add_argument("--full", action="store_true", help="print the whole plan")
    ap.add_argument("patterns", nargs="*")
    a = ap.parse_args()
    spark = build_session()
    if a.no_broadcast:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    registry.load_all()
    names = sorted(registry.QUERIES)
    if a.patterns:
        names = [n for n in names if any(re.fullmatch(p, n) for p in a.patterns)]
    for n in names:
        df = registry.QUERIES[n](spark, a.sf)
        df.write.format("noop").mode("overwrite").save()  # final adaptive plan
        plan = df._jdf.queryExecution().executedPlan().toString()
        flags = [f for f in FLAGS if f in plan]
        print(f"{n}: exchanges={plan.count('Exchange')} flags={flags}")
        if a.full:
            print(plan)


if __name__ == "__main__":
    main()
