"""Summarize physical plans of the headline queries (AQE final plans after a
run): exchanges, joins by strategy, windows, aggregates, scans with pushed
filters and read columns.  Usage: python tools/plan_report.py [sf_dir] > PLANS.md"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from ledgerlens.plans.registry import load_all  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, 8)
    reg = load_all()
    print("# Physical plans of the headline queries\n")
    print("The flagship queries read the persisted scored table; the two '(scoring plan)' rows show the\n"
          "plan that computes it.\n")
    print(f"Final adaptive plans after one run at `{os.path.basename(sf)}` (local[8], 8 shuffle partitions).\n")
    print("| query | shuffles | broadcast joins | sort-merge joins | windows | aggregates | scans (cols read / pushed filters) |")
    print("|---|---|---|---|---|---|---|")
    from ledgerlens.config import Config
    from ledgerlens.operators.scoring import score_transactions
    from ledgerlens.sources.tables import txn
    extra = {"(scoring plan, defaults)": lambda: score_transactions(txn(spark, sf), Config()),
             "(scoring plan, fixture)": lambda: score_transactions(txn(spark, sf, Config.fixture()), Config.fixture())}
    for name in list(extra) + HEADLINE:
        if (name not in reg and name not in extra) or name == "train_models":      # its result is a small table
            continue
        df = extra[name]() if name in extra else reg[name].build(spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        shuffles = len(re.findall(r"\bExchange hashpartitioning|\bExchange rangepartitioning|\bExchange SinglePartition|ShuffleQueryStage", plan))
        bj = plan.count("BroadcastHashJoin")
        smj = plan.count("SortMergeJoin")
        win = len(re.findall(r"\bWindow\b", plan))
        agg = len(re.findall(r"HashAggregate|ObjectHashAggregate|SortAggregate", plan))
        scans = re.findall(r"FileScan parquet [^\n]*?\[([^\]]*)\][^\n]*?PushedFilters: \[([^\]]*)\]", plan)
        scan_txt = "; ".join(f"{len(c.split(','))} / {len([x for x in p.split(', ') if x]) }" for c, p in scans[:4])
        if len(scans) > 4:
            scan_txt += f"; … ({len(scans)} scans)"
        print(f"| {name} | {shuffles} | {bj} | {smj} | {win} | {agg} | {scan_txt} |")


if __name__ == "__main__":
    main()
