"""Write PLANS.md: the condensed physical plan of every registered query.

python tests/show_plans.py [sf_dir] > PLANS.md

Each query is executed once (noop sink) so the adaptive plan is final; the listing
keeps the operators that decide cost at scale: exchanges, join strategies, window
group limits, aggregates, scans with their pushed filters and read schemas.
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kwspread.plans.registry import load_all  # noqa: E402
from kwspread.session import build_session  # noqa: E402

KEEP = re.compile(
    r"(Exchange|BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct|"
    r"WindowGroupLimit|Window |HashAggregate|ObjectHashAggregate|SortAggregate|TakeOrderedAndProject|Generate|"
    r"MapInPandas|MapInArrow|ArrowEvalPython|BatchEvalPython|Scan |FileScan|Scan ExistingRDD|AQEShuffleRead|Union)"
)


def condensed(df) -> list[str]:
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for line in plan.splitlines():
        if KEEP.search(line):
            line = re.sub(r"#\d+L?", "", line)
            line = re.sub(r"\[plan_id=\d+\]", "", line)
            if "FileScan" in line:
                fmt = re.search(r"FileScan (\w+)", line)
                loc = re.search(r"\[file:[^\]]*/([\w.]+)\]", line)
                pf = re.search(r"PushedFilters: (\[[^\]]*\])", line)
                rs = re.search(r"ReadSchema: (struct<[^>]*>)", line)
                indent = line[: len(line) - len(line.lstrip(" :+-"))]
                line = f"{indent}FileScan {fmt.group(1) if fmt else ''} {loc.group(1) if loc else ''} " \
                       f"PushedFilters={pf.group(1) if pf else '[]'} ReadSchema={rs.group(1) if rs else ''}"
            out.append(line[:220])
    return out


if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    print(f"# Physical plans (final adaptive plans, {os.path.basename(sf_dir)}, local[8])\n")
    print("Generated by `tests/show_plans.py`. Operators kept: exchanges, joins, group limits, aggregates, scans.\n")
    for name, q in load_all().items():
        print(f"## {name}\n\n{q.doc}\n\n```")
        try:
            print("\n".join(condensed(q.build(spark, sf_dir))))
        except Exception as e:  # keep going
            print(f"error: {e!r}"[:300])
        print("```\n")
