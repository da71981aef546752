"""Execute each registered query and report what its final plan does.

For every query: scans per driver table (a fact scanned more than once means
repeated work), shuffles, broadcast and sort-merge joins, windows.

    python tools/plan_audit.py [sf_dir] [name ...]      (SHOW=1 prints plans)
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wardflow import catalog  # noqa: E402
from wardflow.checks.plans import final_plan, plan_facts  # noqa: E402
from wardflow.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = local_session()
    for name, fn in catalog.queries().items():
        if only and name not in only:
            continue
        plan = final_plan(fn(spark, sf_dir))
        f = plan_facts(plan)
        print(f"{name:26s} scans={f.scans} shuffles={f.shuffles} bhj={f.broadcast_joins} "
              f"smj={f.sort_merge_joins} window={f.windows}")
        if os.environ.get("SHOW"):
            print(plan)


if __name__ == "__main__":
    main()
