"""Print the physical plan of registered queries (key operators only, or full).

usage: python tools/show_plans.py [--full] [--sf DIR] name [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from segmenter.plans.catalog import QUERIES  # noqa: E402
from segmenter.session import build_session  # noqa: E402

KEY = re.compile(r"Exchange|WindowGroupLimit|Window |BroadcastHashJoin|SortMergeJoin|HashAggregate|"
                 r"SortAggregate|MapInPandas|FlatMapGroupsInPandas|Generate|FileScan|TakeOrdered|Scan ")


def main() -> None:
    args = sys.argv[1:]
    full = "--full" in args
    sf = "/root/testdata/sf0.1"
    if "--sf" in args:
        sf = args[args.index("--sf") + 1]
    names = [a for a in args if not a.startswith("--") and a != sf]
    spark = build_session()
    for name in names:
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        print(f"== {name}")
        for line in plan.splitlines():
            line = re.sub(r"#\d+L?", "", line)
            if full or KEY.search(line):
                print("  " + line[:200])


if __name__ == "__main__":
    main()
