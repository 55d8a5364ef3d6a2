"""CLI: python tests/run_oracle.py [sf_dir] [name ...] -> one JSON line per query."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare  # noqa: E402

from kwspread.plans.registry import load_all  # noqa: E402
from kwspread.session import build_session, ship_package  # noqa: E402

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    tz = os.environ.get("KWSPREAD_TZ")  # e.g. Asia/Seoul: results must not depend on it
    spark = build_session(extra={"spark.sql.session.timeZone": tz} if tz else None)
    ship_package(spark)
    reg = load_all()
    bad = 0
    for name, q in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            r = compare(spark, name, q.build, q.sql, sf_dir)
        except Exception as e:  # report and continue
            r = {"query": name, "error": repr(e)[:800]}
        r["sec"] = round(time.time() - t0, 2)
        ok = r.get("hash_match", r.get("mode") == "rows-only") and "error" not in r
        bad += 0 if ok else 1
        print(json.dumps(r, default=str), flush=True)
    print(json.dumps({"failed": bad}))
