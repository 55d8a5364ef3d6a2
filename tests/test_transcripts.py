"""Transcripts of any length, joins against a large store, sketches that add up."""

import random

import pytest
from pyspark.sql import functions as F

from kwspread.operators import comments as C
from kwspread.operators import diffusion as D
from kwspread.operators import transcripts as TR


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def many_parts(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def hot_rows(seed=1):
    rng = random.Random(seed)
    hot = [("hot", 3 * k, f"s{k} " + rng.choice(["kw", "k", "w x"])) for k in range(900)]
    rest = [(f"v{k % 300}", k, rng.choice([None, "", "a kw", "k", "w"])) for k in range(1_800)]
    rows = hot + rest + [(None, 1, "kw"), (None, 5, "w")]
    rng.shuffle(rows)
    return rows


def test_positions_of_a_hot_video_come_from_many_tasks(spark, many_parts):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "video_id string, turn long, text string")
    placed = TR.with_positions(df.select("video_id", "turn"))
    got = {(r.video_id, r.turn): r.pos for r in placed.collect()}
    want = {}
    for v in {r[0] for r in rows}:
        for k, t in enumerate(sorted(r[1] for r in rows if r[0] == v)):
            want[v, t] = k
    assert got == want
    ranged = df.select("video_id", "turn").repartitionByRange("video_id", "turn").withColumn("p", F.spark_partition_id())
    sizes = [r["count"] for r in ranged.where("video_id = 'hot'").groupBy("p").count().collect()]
    assert len(sizes) >= 3 and max(sizes) <= len(rows) / 4  # a third of all rows, in ranges


def test_no_text_is_sorted_by_video(spark):
    df = spark.createDataFrame(hot_rows(), "video_id string, turn long, text string")
    for out in (TR.transcript_chunks(df, chunk=7), TR.assemble_transcripts(df)):
        for line in plan_of(out).splitlines():
            assert not ("Window" in line and "text" in line)


def test_chunks_are_the_transcript_in_pieces(spark, many_parts):
    rows = [r for r in hot_rows(2) if r[0] is not None]
    df = spark.createDataFrame(rows, "video_id string, turn long, text string")
    chunks = {}
    for r in TR.transcript_chunks(df, chunk=50).collect():
        chunks.setdefault(r.video_id, {})[r.chunk_no] = (r.chunk_text, r.n_segments)
    whole = {r.video_id: (r.transcript, r.n_segments) for r in TR.assemble_transcripts(df).collect()}
    for v in {r[0] for r in rows}:
        own = [t or "" for _, t in sorted((r[1], r[2]) for r in rows if r[0] == v)]
        texts = [chunks[v][k][0] for k in range(len(chunks[v]))]
        assert " ".join(texts) == " ".join(own) == whole[v][0] and whole[v][1] == len(own)
        assert max(n for _, n in chunks[v].values()) <= 50
    assert len(chunks["hot"]) == 18


def test_keyword_hits_over_ranges(spark, many_parts):
    rows = [r for r in hot_rows(3) if r[0] is not None]
    df = spark.createDataFrame(rows, "video_id string, turn long, text string")
    kws = ["kw s", "w k", "k w", "x s899", "nowhere"]
    got = {r.video_id: r.matched_keywords for r in TR.transcript_keyword_hits(df, kws).collect()}
    slow = {r.video_id: r.matched_keywords for r in TR.matched_videos(TR.assemble_transcripts(df), kws).collect()}
    assert got == slow and "hot" in got


def test_the_store_is_not_shuffled_for_a_small_batch(spark, scratch):
    spark.range(50_000).select(F.concat(F.lit("c"), "id").alias("comment_id"), F.lit("x" * 20).alias("text")).write.parquet(f"{scratch}/store")
    store = spark.read.parquet(f"{scratch}/store")
    batch = spark.createDataFrame([("c5", 1), ("new", 2), ("new", 2), ("c77", 3)], "comment_id string, k int")
    out = C.new_only(batch, store)
    assert [tuple(r) for r in out.collect()] == [("new", 2)]
    plan = plan_of(out)
    scan = next(k for k, line in enumerate(plan.splitlines()) if "Scan parquet" in line)
    above = plan.splitlines()[:scan]
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    chain, least = [], depth(plan.splitlines()[scan])
    for line in reversed(above):
        if depth(line) < least:
            chain.append(line.strip(" :+-"))
            least = depth(line)
    first = next(k for k, line in enumerate(chain) if "Join" in line)
    assert "LeftSemi" in chain[first] and "Broadcast" in chain[first] and not any("Exchange" in line for line in chain[:first])
    done = spark.createDataFrame([("a", "done"), ("b", "error"), ("z", "done")], "video_id string, status string")
    assert sorted(r.video_id for r in C.resume_todo(spark.createDataFrame([("a",), ("b",), ("c",)], "video_id string"), done).collect()) == ["b", "c"]


def test_sketches_add_up_over_weeks_and_parts(spark):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("keyword"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 60).cast("timestamp_ntz").alias("date"),
        (F.col("id") % 9_000).alias("video_id"),
    )
    first, rest = D.weekly_sketches(rows.where("date < '2024-01-20'"), "video_id"), D.weekly_sketches(rows.where("date >= '2024-01-15'"), "video_id")
    assert first.groupBy("keyword", "week").count().where("count > 1").count() == 0
    got = {r.keyword: r.n_estimated for r in D.sketched_distinct(first.unionByName(rest)).collect()}
    exact = {r.keyword: r.n for r in rows.groupBy("keyword").agg(F.count_distinct("video_id").alias("n")).collect()}
    assert got.keys() == exact.keys()
    assert all(abs(got[k] - exact[k]) <= exact[k] * D.SKETCH_ERROR for k in got)
    assert D.sketched_distinct(D.weekly_sketches(rows.where("false"), "video_id")).collect() == []
