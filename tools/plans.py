"""Summarise the physical plans of registered queries (shuffles, broadcasts,
scans with pushed filters).  usage: python tools/plans.py [sf_dir] [name ...]"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pricelens.plans.registry import all_queries  # noqa: E402
from pricelens.session import get_session  # noqa: E402


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    spark = get_session("local[8]", shuffle_partitions=16)
    print("| query | shuffle exchanges | broadcast exchanges | parquet scans | scans with pushed filters | python stages |")
    print("| --- | --- | --- | --- | --- | --- |")
    for name, q in all_queries().items():
        if names and name not in names:
            continue
        if q.oracle is None and not names:
            continue
        plan = q.build(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        shuffles = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan))
        bcast = len(re.findall(r"BroadcastExchange", plan))
        scans = re.findall(r"FileScan parquet[^\n]*", plan)
        pushed = sum(1 for s in scans if re.search(r"PushedFilters: \[[^\]]+\]", s) and "PushedFilters: []" not in s)
        py = len(re.findall(r"ArrowEvalPython|MapInPandas|BatchEvalPython|FlatMapGroupsInPandas", plan))
        print(f"| {name} | {shuffles} | {bcast} | {len(scans)} | {pushed} | {py} |")


if __name__ == "__main__":
    main(sys.argv)
