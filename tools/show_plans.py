"""Print the physical plans of one link-rank update and of job_metrics.

usage: python tools/show_plans.py [sf_dir]  (writes markdown to stdout)
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rankflow.plans import loop as L  # noqa: E402
from rankflow.plans import registry  # noqa: E402
from rankflow.session import local_session  # noqa: E402
from rankflow.sources import tables as TB  # noqa: E402


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    g = L.prepare(TB.co_purchase_edges(spark, sf))
    res = L.run(g, tol=None, max_iter=2)
    print(f"# Physical plans ({os.path.basename(sf)}, local[8])\n")
    print(f"## One link-rank update ({g.num_partitions} partitions, {g.num_hot} hot sources)\n")
    print("The state comes from the previous update's checkpoint; the edges are the")
    print("persisted copy made in `prepare`. `ENSURE_REQUIREMENTS` marks the only")
    print("exchange; the `REPARTITION_BY_NUM` line belongs to the cached relation's")
    print("own plan (run once, in `prepare`).\n")
    with L._LoopConf(spark, g.num_partitions, False):
        print("```\n" + plan(L.step(g, res.state)) + "```\n")
    g2 = L.prepare(TB.co_purchase_edges(spark, sf), salt_chunk=2)
    res2 = L.run(g2, tol=None, max_iter=1)
    print(f"## The same update with every source salted (salt_chunk=2, {g2.num_hot} hot)\n")
    with L._LoopConf(spark, g2.num_partitions, False):
        print("```\n" + plan(L.step(g2, res2.state)) + "```\n")
    print("## job_metrics\n")
    print("```\n" + plan(registry.get("job_metrics")(spark, sf)) + "```")


if __name__ == "__main__":
    main(sys.argv)
