import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenmatch import datasets as d
from lumenmatch.functions import paths
from lumenmatch.functions.text import fuzzy_match, normalize_text
from lumenmatch.operators import frames as fr, mentions as mn
from lumenmatch.sources import posts as po


def test_text_rules(spark):
    row = spark.range(1).select(
        normalize_text(F.lit("  أَحمد  X ")).alias("n"),
        fuzzy_match(F.lit("fresh Starbvcks here"), F.lit("Starbucks")).alias("near"),
        fuzzy_match(F.lit("an ox"), F.lit("ax")).alias("short"),
        fuzzy_match(F.lit("star bucks"), F.lit("STAR  BUCKS")).alias("inside"),
    ).first()
    assert row["n"] == "احمد x"
    assert (row["near"], row["short"], row["inside"]) == (True, False, True)


def test_ocr_terms_may_span_rows_and_chunks(spark):
    rows = [(1, 0, "big star", 0.5), (1, 1, " ", 0.5), (1, 2, "bu", 0.5), (1, 3, "cks", 1.0), (2, 0, "nothing", 0.2), (3, 0, " ", 0.4)]
    df = spark.createDataFrame(rows, "item_id long, seq long, text string, conf double")
    for chunk in (2, 4096):
        out = {r["item_id"]: r for r in mn.ocr_evidence(df, ["star bu cks"], ["#bu"], chunk).collect()}
        assert out[1]["brand_matched"] == ["star bu cks"] and out[1]["hashtag_matched"] == ["bu"]
        assert out[1]["ocr_head"] == "big star   bu cks" and out[1]["score"] == pytest.approx(0.6 + 0.4 * 0.625)
        assert not out[2]["fired"] and out[2]["score"] == 0.0 and not out[3]["fired"]


def brute_keep(hists, thumbs, max_kept):
    kept = []
    for i in range(len(hists)):
        if len(kept) >= max_kept:
            break
        if kept and np.corrcoef(hists[kept[-1]], hists[i])[0, 1] > 0.98:
            continue
        if any(np.abs(thumbs[i] - thumbs[j]).mean() / 255 < 0.05 for j in kept[-3:]):
            continue
        kept.append(i)
    return kept


@pytest.mark.parametrize("batch", [None, 1, 3])
def test_dedupe_frames_against_brute_force(spark, batch):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for video in (1, 2):
        scenes = [(rng.uniform(0, 9, 64), rng.uniform(0, 255, 1024)) for _ in range(5)]
        picks = [scenes[i] for i in rng.integers(0, 5, 20)]
        hists = [h + rng.normal(0, 0.01, 64) for h, _ in picks]
        thumbs = [t for _, t in picks]
        rows += [(video, i, hists[i].tolist(), thumbs[i].tolist()) for i in range(20)]
        want[video] = brute_keep(hists, thumbs, 6)
    df = spark.createDataFrame(rows, "video_id long, frame_idx long, hist array<double>, thumb array<double>")
    out = fr.dedupe_frames(df, max_kept=6, batch=batch).orderBy("video_id", "kept_order").collect()
    got = {v: [r["frame_idx"] for r in out if r["video_id"] == v] for v in (1, 2)}
    assert got == want


def test_sampling_plans(spark):
    v = spark.createDataFrame([(1, 1, 25.0), (2, 5, 25.0), (3, 101, 25.0), (4, 0, 25.0)], "video_id long, total_frames long, fps double")
    def plan(df):
        return {k: sorted(r["frame_idx"] for r in df.collect() if r["video_id"] == k) for k in (1, 2, 3, 4)}
    assert plan(fr.sample_interval(v)) == {1: [0], 2: [0, 4], 3: [0, 50, 100], 4: []}
    assert plan(fr.sample_even(v)) == {1: [0], 2: [0, 1, 2, 3, 4], 3: [0, 20, 40, 60, 80, 100], 4: []}


def test_columns_and_urls(spark):
    assert po.normalize_column(" Post - URL! ") == "post_url"
    assert po.resolve_column(["The Creator Id", "my link"], None, po.USER_KEYS) == "The Creator Id"
    assert po.resolve_column(["a", "b"], None, po.LINK_KEYS) is None
    rows = spark.createDataFrame([("http://x.y/a.JPG?q=1",), ("http://x.y/a.mp4;v=2",), ("http://x.y/.png",), ("http://x.y/a.pdf",)], "url string")
    got = [r["e"] for r in rows.select(paths.url_ext(F.col("url")).alias("e")).collect()]
    assert got == ["jpg", "mp4", "", ""]
    with pytest.raises(ValueError):
        po.load_posts(rows.select(F.lit(1).alias("row_index"), F.lit("x").alias("q")))


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
