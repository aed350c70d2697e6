"""Write the final physical plans (operator trees) of the main queries to
docs/PLANS.md.

usage: python tools/dump_plans.py [sf_dir]
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NAMES = ["scan", "sast_scan", "leak_scan", "history_scan", "match_advisories", "finding_stats", "gitignore_match"]


def _seq(s):
    return [s.apply(i) for i in range(s.size())]


def tree(node, depth=0, out=None):
    out = [] if out is None else out
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return tree(node.executedPlan(), depth, out)
    if name in ("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage", "TableCacheQueryStage"):
        return tree(node.plan(), depth, out)
    label = name
    if name == "WholeStageCodegen (?)" or name.startswith("WholeStageCodegen"):
        label = "*" + name
    if "Scan" in name:
        try:
            md = node.metadata()
            rs = md.get("ReadSchema")
            if rs.isDefined():
                label += f"  ReadSchema={rs.get()}"
            pf = md.get("PushedFilters")
            if pf.isDefined() and pf.get() != "[]":
                label += f"  PushedFilters={pf.get()[:120]}"
        except Exception:  # noqa: BLE001
            pass
    if name in ("Exchange", "BroadcastExchange"):
        try:
            label += "  " + str(node.outputPartitioning().toString())[:100].replace("\n", " ")
        except Exception:  # noqa: BLE001
            pass
    if name in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin"):
        label += "  " + str(node.joinType().toString())
    out.append("  " * depth + "- " + label)
    for ch in _seq(node.children()):
        tree(ch, depth + 1, out)
    return out


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from scanforge.plans.queries import QUERIES
    out = [f"# Physical plans (local[8], {os.path.basename(sf.rstrip('/'))})", "",
           "Final (post-AQE) operator trees, written by `tools/dump_plans.py`. `*WholeStageCodegen` marks the",
           "fused code-generated spans; scans show the pruned read schema. Exchanges are the only shuffles.", ""]
    for name in NAMES:
        df = QUERIES[name](spark, sf)
        df.collect()
        out += [f"## {name}", "", "```", *tree(df._jdf.queryExecution().executedPlan()), "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md")
    open(path, "w").write("\n".join(out) + "\n")
    print("wrote", path)


if __name__ == "__main__":
    main()
