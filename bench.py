"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed to completion with the `noop` sink (full plan, no driver
collect), warm median of $BENCH_REPS runs after one warm-up. DuckDB runs the oracle
publishes no numbers). Prints ONE JSON line on stdout.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

HEADLINE = [
    "weekly_counts", "keyword_summary", "weekly_pivot", "first_hits", "first_window", "first_day_dump",
    "merge_clean_dedup", "dedup_id_aware", "match_all", "keyword_comments", "text_clean",
    "candidate_pool", "sample_random", "hydrate_coalesce", "flatten_threads", "reply_matches",
    "transcript_gate_semi", "new_comments_anti", "enrich_comments", "query_vs_keyword",
    "cap_after_match", "cap_before_match", "video_has_keyword", "url_filter_prefer_dedup",
    "page_extract_first_selector", "first_presence_bracket",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    with_duck = os.environ.get("BENCH_DUCKDB", "1") == "1"
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE

    from kwspread.plans.registry import load_all
    from kwspread.session import build_session, ship_package

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    ship_package(spark)
    reg = load_all()
    spark_times, duck_times = {}, {}
    for name in names:
        q = reg[name]

        def run():
            t0 = time.perf_counter()
            q.build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        run()  # warm-up
        spark_times[name] = round(statistics.median(run() for _ in range(reps)), 3)
        if with_duck and q.sql:
            from oracle import duck

            con = duck(sf_dir)
            con.sql(q.sql).fetchall()
            ts = []
            for _ in range(reps):
                t0 = time.perf_counter()
                con.sql(q.sql).fetchall()
                ts.append(time.perf_counter() - t0)
            duck_times[name] = round(statistics.median(ts), 3)
        print(f"{name}: spark {spark_times[name]}s duckdb {duck_times.get(name)}s", file=sys.stderr, flush=True)

    import pyspark

    out = {
        "metric": "sum_of_warm_median_query_sec",
        "value": round(sum(spark_times.values()), 3),
        "unit": "sec",
        "queries": spark_times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "duckdb_queries": duck_times,
        "duckdb_value": round(sum(duck_times.values()), 3) if duck_times else None,
        "spark_version": pyspark.__version__,
        "cpus": int(cpus),
        "reps": reps,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
