import os

from pyspark.sql import functions as F

from kwspread.operators import diffusion as D
from kwspread.sources import adapters as A
from kwspread.sources import csv_edge as E


def write(path, text, bom=True):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
        f.write(text)


def test_bom_quoted_newline_union_by_name(spark, scratch):
    write(f"{scratch}/a/x.csv", 'date,platform,source,keyword,text\n2024-01-01T00:00:00,yt,s,kw,"line1\nline2 ""q"""\n')
    write(f"{scratch}/b/y.csv", 'text,keyword,date,query\n"t2",kw,2024-01-02T00:00:00Z,q\n')
    df = E.read_csv_union(spark, {"a": f"{scratch}/a", "b": f"{scratch}/b"})
    rows = {r.src_file: r for r in df.collect()}
    assert rows["x.csv"].text == 'line1\nline2 "q"' and rows["x.csv"].query is None
    assert rows["y.csv"].platform is None and rows["y.csv"].query == "q"
    assert "date" in df.columns and "﻿date" not in df.columns
    clean = A.clean_merged(df)
    assert clean.count() == 2


def test_missing_date_column_rows_dropped(spark, scratch):
    write(f"{scratch}/c/z.csv", "commentId,text,matched_keyword\n1,hello,kw\n")
    df = A.clean_merged(E.read_csv_layout(spark, f"{scratch}/c"))
    assert df.count() == 0


def test_unparsable_dates_are_counted(spark, scratch):
    from pyspark.sql import Observation

    write(f"{scratch}/d/m.csv", "date,keyword,text\n2020-01-01,k,a\n2020/01/04,k,b\njunk,k,c\n2020-01-02T03:04:05Z,k,d\n")
    obs = Observation("parse")
    df = A.clean_merged(E.read_csv_layout(spark, f"{scratch}/d"), observation=obs)
    assert df.count() == 3
    assert obs.get == {"rows_in": 4, "unparsable_dates": 1}


def test_partitioned_dump_and_keywords(spark, scratch):
    import datetime as dt

    rows = [(dt.datetime(2024, 1, 1, 5), "p", "k", "s", "t")]
    df = spark.createDataFrame(rows, "date timestamp_ntz, platform string, keyword string, source string, text string")
    out = D.first_day(df)
    E.write_csv(out, f"{scratch}/dump", partition_by=["platform", "keyword", "first_day"])
    assert os.path.isdir(f"{scratch}/dump/platform=p/keyword=k/first_day=2024-01-01")
    write(f"{scratch}/kw.yaml", "keywords:\n  - ' a '\n  - ''\n  - b\n", bom=False)
    assert E.load_keywords(f"{scratch}/kw.yaml") == ["a", "b"]


def test_files_with_their_own_headers(spark, scratch):
    write(f"{scratch}/m/a.csv", "date,platform,source,keyword,text\n2024-01-01,p,s,kw1,one\n")
    write(f"{scratch}/m/deep/b.csv", "date,platform,keyword,video_id,text\n2024-01-02,q,kw2,v9,two\n")
    write(f"{scratch}/m/deep/c.csv", "text,date\n\"three, quoted\",2024-01-03\n")
    df = E.read_csv_layout(spark, f"{scratch}/m")
    got = {r.src_file: r.asDict() for r in df.collect()}
    assert (got["a.csv"]["source"], got["a.csv"]["keyword"], got["a.csv"]["video_id"]) == ("s", "kw1", None)
    assert (got["b.csv"]["source"], got["b.csv"]["keyword"], got["b.csv"]["video_id"]) == (None, "kw2", "v9")
    assert (got["c.csv"]["text"], got["c.csv"]["date"]) == ("three, quoted", "2024-01-03")
    some = E.read_csv_layout(spark, f"{scratch}/m", cols=["text", "nowhere"], src_col=None)
    assert some.columns == ["text", "nowhere"] and some.count() == 3


def test_malformed_rows_and_skipped_files_are_told(spark, scratch):
    write(f"{scratch}/k/a.csv", "x,y\n1,2\n3,4,5\n")
    write(f"{scratch}/k/header only.csv", "x,y\n")
    write(f"{scratch}/k/empty.csv", "", bom=False)
    write(f"{scratch}/k/deep/a.csv", "", bom=False)  # the name of a file that has rows
    df = E.read_csv_layout(spark, f"{scratch}/k", malformed_col="bad", path_col="path").cache()
    assert [r.bad is not None for r in df.orderBy("x").collect()] == [False, True]
    told = {r.path.split("/k/")[1]: (r.bytes, r.reason) for r in E.skipped_files(spark, f"{scratch}/k", df).collect()}
    assert told == {"header only.csv": (7, "no rows"), "empty.csv": (0, "empty"), "deep/a.csv": (0, "empty")}


NAMES = ["a b.csv", "100%.csv", "p+q.csv", "x%20y.csv", "[1].csv", "{a,b}.csv", "ümlaut ?.csv", "*.csv"]


def test_any_file_name(spark, scratch):
    for k, name in enumerate(NAMES):
        write(f"{scratch}/odd dir %41/{name}", f"k,text\n{k},\"two\nlines\"\n", bom=k % 2 == 0)
    df = E.read_csv_layout(spark, f"{scratch}/odd dir %41", path_col="path")
    got = {r.k: r for r in df.collect()}
    assert df.count() == len(NAMES)
    assert {k: r.src_file for k, r in got.items()} == {str(k): n for k, n in enumerate(NAMES)}
    assert all(r.path == f"file:{scratch}/odd dir %41/{r.src_file}" and r.text == "two\nlines" for r in got.values())
    assert E.skipped_files(spark, f"{scratch}/odd dir %41", df).count() == 0
    assert {f.path.rsplit("/", 1)[1] for f in E.csv_files(spark, [f"{scratch}/odd*/**/*.csv"])} == set(NAMES)
    assert {f.path.rsplit("/", 1)[1] for f in E.csv_files(spark, [f"{scratch}/**/*q.csv"])} == {"p+q.csv"}
    assert E.read_csv_layout(spark, f"{scratch}/odd dir %41/a b.csv").count() == 1


def test_headers_come_from_the_start_of_a_file(spark, scratch, monkeypatch):
    read = []
    real = E.folders.read_bytes
    monkeypatch.setattr(E.folders, "read_bytes", lambda s, p, n: read.append(n) or real(s, p, n))
    wide = ",".join(f"column_{k}" for k in range(20_000))
    write(f"{scratch}/w/long.csv", "a,b\n" + "1,2\n" * 200_000, bom=False)
    write(f"{scratch}/w/wide.csv", wide + "\n" + ",".join(["v"] * 20_000) + "\n")
    write(f"{scratch}/w/quoted.csv", '"multi\nline",b\n1,2\n')
    files = {f.path.rsplit("/", 1)[1]: f.header for f in E.csv_files(spark, [f"{scratch}/w"])}
    assert files["long.csv"] == ("a", "b") and len(files["wide.csv"]) == 20_000 and files["wide.csv"][-1] == "column_19999"
    assert files["quoted.csv"] == ("multi\nline", "b")
    assert read.count(E.HEADER_BYTES) == 3 and max(read) <= 4 * E.HEADER_BYTES


def test_no_rows_at_all(spark, scratch):
    import pytest

    with pytest.raises(FileNotFoundError):
        E.read_csv_layout(spark, f"{scratch}/nowhere")
    write(f"{scratch}/none/a.csv", "", bom=False)
    assert E.read_csv_layout(spark, f"{scratch}/none", cols=["x"]).columns == ["x", "src_file"]
    assert E.read_csv_layout(spark, f"{scratch}/none").count() == 0


def test_bom_and_run_day(spark, scratch):
    df = spark.createDataFrame([("é", "b")], "text string, k string")
    E.write_csv(df, f"{scratch}/bom", bom=True)
    import glob

    raw = open(glob.glob(f"{scratch}/bom/*.csv")[0], "rb").read()
    assert raw.startswith(b"\xef\xbb\xbftext,k")
    assert E.read_csv_layout(spark, f"{scratch}/bom", src_col=None).collect()[0].text == "é"
    E.write_parquet(E.with_run_day(df, "2024-01-05"), f"{scratch}/days", mode="append", partition_by=["run_day"])
    assert os.path.isdir(f"{scratch}/days/run_day=2024-01-05")


def test_malformed_json_pages(spark):
    from kwspread.sources import landed_json as J

    pages = spark.createDataFrame([("v", '{"items": []}'), ("v", '{"items": [{"id"'), ("v", ""), ("v", None)], "video_id string, page string")
    assert J.malformed_pages(pages).count() == 3


def test_dictionary_on_a_cluster_path(spark, scratch):
    import pytest

    write(f"{scratch}/a b.yaml", "keywords:\n  - ' a '\n  - ''\n  -\n  - b: c\n  - 7\n")
    assert E.load_keywords(f"file:{scratch}/a b.yaml", spark=spark) == ["a", "{'b': 'c'}", "7"]
    assert E.load_keywords("keywords:\n- x\n") == ["x"]
    for bad in ("keywords:\n- ''\n", "other: 1\n", "- a list\n", "nowhere.yaml"):
        with pytest.raises(ValueError, match="no keywords"):
            E.load_keywords(bad, spark=spark)


def test_required_columns(spark):
    import pytest

    from kwspread.operators.common import require_columns

    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert require_columns(df, ["a"]) is df
    with pytest.raises(ValueError, match=r"table is missing required columns: \['c'\]"):
        require_columns(df, ["a", "c"], "table")


def test_ordered_dump_splits_a_hot_group(spark, scratch):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"),
        F.pmod(F.xxhash64("id"), F.lit(1_000_000)).alias("o"), "id")
    E.write_ordered(rows.repartition(5), f"{scratch}/dump", ["g"], ["o", "id"], rows_per_file=1_500)
    back = E.read_ordered(spark, f"{scratch}/dump", rows.schema, ["g"])
    got = {}
    for r in back.orderBy("g", "position").collect():
        got.setdefault(r.g, []).append((r.o, r.id))
    assert all(v == sorted(v) for v in got.values()) and sum(map(len, got.values())) == 20_000
    import glob

    assert len(glob.glob(f"{scratch}/dump/g=hot/*.parquet")) >= 13_333 // 1_500
    E.write_ordered(rows, f"{scratch}/csv", ["g"], ["o", "id"], rows_per_file=5_000, fmt="csv")
    lines = [x for f in sorted(glob.glob(f"{scratch}/csv/g=hot/*.csv")) for x in open(f).read().split()[1:]]
    assert [tuple(map(int, x.split(","))) for x in lines] == got["hot"]
