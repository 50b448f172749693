"""Print the final (post-AQE) physical plans of the headline queries in tree form.

usage: python tools/plan_report.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from livepricing.plans.registry import load_all  # noqa: E402
from livepricing.session import build_session  # noqa: E402


def tree(plan: str) -> str:
    keep = []
    for line in plan.splitlines():
        if re.search(r"(Exchange|Join|Window|Aggregate|Scan|TakeOrdered|Filter|Sort |Union|Expand|Generate|Subquery)", line):
            line = re.sub(r"#\d+L?", "", line)
            keep.append(line[:170])
    return "\n".join(keep)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:] or ["recent_prices", "dynamic_pricing", "price_point_lookup", "cart_lines",
                             "category_totals", "stock_deltas"]
    spark = build_session("local[8]")
    reg = load_all()
    for n in names:
        df = reg[n].build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"### {n}\n```\n{tree(plan)}\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()
