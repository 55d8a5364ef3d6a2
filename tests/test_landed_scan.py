"""One-pass quarantine of landed pages, and the progress log they give."""

import datetime as dt
import json

from kwspread.sources import landed_scan as S

T0 = dt.datetime(2024, 5, 1)
SCHEMA = "video_id string, parent_id string, page_no int, http_status int, body string, fetched_at timestamp_ntz"


def thread(cid, text, replies=0, **more):
    return {"snippet": {"totalReplyCount": replies, "topLevelComment": {"id": cid, "snippet": {"textDisplay": text, **more}}}}


def reply(cid, text):
    return {"id": cid, "snippet": {"textDisplay": text, "likeCount": 3}}


def body(*items):
    return json.dumps({"items": list(items)})


def pages(spark, rows):
    return spark.createDataFrame([(v, p, n, s, b, T0 + dt.timedelta(milliseconds=ms)) for v, p, n, s, b, ms in rows], SCHEMA)


ROWS = [
    ("ok", None, 0, 200, body(thread("a", "kw one", 2, likeCount=5), thread("b", "nothing"), thread("", "kw no id", 1)), 0),
    ("ok", "a", 0, 200, body(reply("a1", "has KW"), reply("a1", "has KW"), reply("", "kw")), 1500),
    ("ok", "b", 0, 200, body(reply("b1", "kw but its thread tells no replies")), 1750),
    ("none", None, 0, 200, body(), 0),
    ("disabled", None, 0, 403, '{"error": {"code": 403}}', 10),
    ("cut", None, 0, 200, body(thread("c", "kw", 1)), 0),
    ("cut", "c", 0, 200, body(reply("c1", "kw"), reply("c2", "kw"))[:-30], 40),
    ("cut", "c", 1, 500, None, 50),
    ("lost", None, 0, None, None, 0),
    ("blank", None, 0, 200, " ", 0),
    ("list", None, 0, 200, "[1, 2]", 0),
    ("odd", None, 0, 200, '{"items": "no list"}', 0),
    ("other", None, 0, 200, '{"kind": "page"}', 0),
    ("nulls", None, 0, 200, '{"items": [null, {"snippet": null}]}', 0),
]


def test_every_page_leaves_a_trace(spark, scratch):
    parts = S.write_split(pages(spark, ROWS), f"{scratch}/split")
    rejected = {(r.video_id, r.parent_id, r.page_no): (r.reason, r.body) for r in parts["rejected"].collect()}
    assert {k: v[0] for k, v in rejected.items()} == {
        ("disabled", None, 0): "http_error", ("cut", "c", 0): "malformed", ("cut", "c", 1): "http_error",
        ("lost", None, 0): "no_answer", ("blank", None, 0): "no_answer", ("list", None, 0): "malformed", ("odd", None, 0): "malformed",
    }
    assert rejected["cut", "c", 0][1] == ROWS[6][4]
    assert sorted(r.video_id for r in parts["empty"].collect()) == ["none", "other"]
    rows = parts["row"].collect()
    assert all(r.body is None for r in rows)
    traced = {(r.video_id, r.parent_id, r.page_no) for p in parts.values() for r in p.collect()}
    assert traced == {r[:3] for r in ROWS}
    by_id = {(r.video_id, r.comment_id): r for r in rows}
    assert by_id["ok", "a"].like_count == 5 and by_id["ok", "b"].like_count == 0 and by_id["ok", "a1"].like_count == 3
    assert by_id["ok", "a"].total_reply_count == 2 and by_id["ok", "a1"].total_reply_count is None
    assert by_id["nulls", ""].text == "" and by_id["ok", "a1"].parent_id == "a"


def test_progress_rows(spark):
    stored = spark.createDataFrame([("a",)], "comment_id string")
    split = S.split_pages(pages(spark, ROWS))
    told = {r.video_id: r for r in S.progress_rows(split, ["kw"], stored).collect()}
    assert {v: r.status for v, r in told.items()} == {
        "ok": "done", "none": "done", "other": "done", "nulls": "done", "disabled": "http_error", "cut": "error",
        "lost": "error", "blank": "error", "list": "error", "odd": "error",
    }
    ok = told["ok"]
    assert (ok.scanned_threads, ok.reply_parents, ok.new_matches, ok.elapsed_sec) == (3, 1, 1, 1.75)
    assert ok.ts == "2024-05-01T00:00:01.750000+00:00"
    assert (told["cut"].scanned_threads, told["cut"].new_matches, told["cut"].elapsed_sec) == (0, 0, 0.05)
    assert (told["none"].scanned_threads, told["none"].new_matches) == (0, 0)
    fresh = {r.video_id: r.new_matches for r in S.progress_rows(split, ["kw"]).collect()}
    assert fresh["ok"] == 2
    assert S.progress_rows(S.split_pages(pages(spark, [])), ["kw"]).collect() == []


def test_an_id_counts_for_the_video_that_had_it_first(spark):
    rows = [("v1", None, 0, 200, body(thread("x", "kw")), 20), ("v2", None, 0, 200, body(thread("x", "kw"), thread("y", "kw")), 10)]
    told = {r.video_id: r.new_matches for r in S.progress_rows(S.split_pages(pages(spark, rows)), ["kw"]).collect()}
    assert told == {"v1": 0, "v2": 2}
