"""Inspect the final (adaptive) physical plan of an executed DataFrame."""

from __future__ import annotations

import re
from dataclasses import dataclass


def final_plan(df) -> str:
    """Run ``df`` and return its final adaptive plans (query and subqueries).

    Adaptive plans print a "Final Plan" and an "Initial Plan" block; the
    lines indented under an "Initial Plan" marker are dropped.
    """
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    keep, skip_below = [], None
    for line in plan.splitlines():
        indent = len(line) - len(line.lstrip(" :|+-"))
        if skip_below is not None:
            if indent > skip_below:
                continue
            skip_below = None
        if "== Initial Plan ==" in line:
            skip_below = line.index("+-")
            continue
        keep.append(line)
    return "\n".join(keep)


@dataclass
class PlanFacts:
    scans: dict[str, int]
    read_columns: dict[str, set[str]]
    shuffles: int
    broadcast_joins: int
    sort_merge_joins: int
    windows: int


def plan_facts(plan: str) -> PlanFacts:
    scans: dict[str, int] = {}
    cols: dict[str, set[str]] = {}
    for m in re.finditer(r"FileScan parquet \[([^\]]*)\].*?\[file:[^\]]*/(\w+)\.parquet", plan):
        table = m.group(2)
        scans[table] = scans.get(table, 0) + 1
        cols.setdefault(table, set()).update(
            name for name in (re.sub(r"#\d+L?", "", c).strip() for c in m.group(1).split(",")) if name)
    return PlanFacts(scans, cols, plan.count("ShuffleQueryStage"), plan.count("BroadcastHashJoin"),
                     plan.count("SortMergeJoin"), len(re.findall(r"\bWindow\b", plan)))
