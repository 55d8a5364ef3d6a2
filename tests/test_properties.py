
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kwspread.functions import match as M
from kwspread.operators import diffusion as D
from kwspread.plans import views as V
from kwspread.plans.registry import load_all

SF = "/root/testdata/sf0.001"
REG = load_all()


def py_first(text, kws, ci):
    """The matching rule, stated plainly: first dictionary keyword contained in the text."""
    if not text:
        return None
    hay = text.lower() if ci else text
    for k in kws:
        if k and (k.lower() if ci else k) in hay:
            return k
    return None


ALPHA = st.text(alphabet="abcABC xyİß", max_size=12)


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(ALPHA, min_size=1, max_size=40), kws=st.lists(st.text(alphabet="abcAB", min_size=0, max_size=3), min_size=1, max_size=5))
def test_matchers_agree_with_plain_rule(spark, texts, kws):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select(
        "i",
        M.first_match(F.col("t"), kws, ci=True).alias("ci"),
        M.first_match(F.col("t"), kws, ci=False).alias("cs"),
        M.all_matches_joined(F.col("t"), kws, ci=True).alias("all"),
    ).collect()
    for r in rows:
        t = texts[r.i]
        assert r.ci == py_first(t, kws, True)
        assert r.cs == py_first(t, kws, False)
        hits = [k for k in kws if k and k.lower() in t.lower()]
        assert r.all == ";".join(hits)
        if r.ci is not None:  # match-first is in match-all
            assert r.ci in r.all.split(";")


def test_weekly_counts_sum_to_keyword_comments(spark):
    wk = REG["weekly_counts"].build(spark, SF).agg(F.sum("n")).first()[0]
    hits = V.obs(spark, SF).where(F.col("keyword").isNotNull()).count()
    assert wk == hits


def test_sample_sizes_are_min_n_group(spark):
    per = {r.picked_by_keyword: r.n_videos for r in REG["videos_per_keyword"].build(spark, SF).collect()}
    for q in ("sample_oldest", "sample_newest", "sample_random"):
        got = {r[0]: r[1] for r in REG[q].build(spark, SF).groupBy("picked_by_keyword").count().collect()}
        assert got == {k: min(20, n) for k, n in per.items()}


def test_window_starts_at_first_hit(spark):
    fh = {(r.platform, r.keyword): r.first_date for r in REG["first_hits"].build(spark, SF).collect()}
    ws = {(r.platform, r.keyword): r.window_start for r in
          REG["first_window"].build(spark, SF).select("platform", "keyword", "window_start").distinct().collect()}
    assert fh == ws


def test_dedup_idempotent_and_caps_are_subsets(spark):
    h = V.obs(spark, SF).where(F.col("keyword").isNotNull())
    once = D.dedup_earliest(h, ["video_id", "keyword", "text_md5"], tiebreak=("comment_id",))
    twice = D.dedup_earliest(once, ["video_id", "keyword", "text_md5"], tiebreak=("comment_id",))
    assert sorted(once.select("comment_id").collect()) == sorted(twice.select("comment_id").collect())
    cs_hits = {r.comment_id for r in V.obs(spark, SF).where(F.col("keyword_cs").isNotNull()).select("comment_id").collect()}
    for q in ("cap_before_match", "cap_after_match"):
        assert {r.comment_id for r in REG[q].build(spark, SF).select("comment_id").collect()} <= cs_hits
