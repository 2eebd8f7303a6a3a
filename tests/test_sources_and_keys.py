"""Inputs that once gave wrong answers: shared items, gaps, equal entries, missing rows, odd names; and the fixed values."""

import pytest
from pyspark.sql import functions as F

from lumenmatch.functions import media, paths, scoring
from lumenmatch.operators import banks, diagnostics as dg, evidence as ev, mentions as mn, sequences as sq, similarity as sim
from lumenmatch.session import release_staged, staged
from lumenmatch.sources import bank_store, listings, posts


def test_item_asked_of_two_campaigns_with_a_large_bank(spark):
    bank = spark.createDataFrame(
        [(1, i, f"a{i}", [1.0, i / 300]) for i in range(300)] + [(2, i, f"b{i}", [0.0, 1.0]) for i in range(5)],
        "campaign_id long, ref_id long, ref_name string, embedding array<double>",
    )
    targets = spark.createDataFrame([(7, 1, [1.0, 0.0]), (7, 2, [1.0, 0.0]), (8, 3, [1.0, 0.0])], "target_id long, campaign_id long, embedding array<double>")
    for kernel in ("jvm", "arrow"):
        got = {(r["target_id"], r["campaign_id"]): r["n_refs"] for r in sim.score_targets(targets, sim.pack_banks(bank), kernel=kernel).collect()}
        assert got == {(7, 1): 300, (7, 2): 5, (8, 3): 0}


def test_hits_of_more_than_four_clusters(spark):
    bank = spark.createDataFrame([(1, i, f"a{i}", [1.0, float(i)]) for i in range(12)], "campaign_id long, ref_id long, ref_name string, embedding array<double>")
    clusters = spark.createDataFrame([(1, i, i // 2) for i in range(12)], "campaign_id long, ref_id long, cluster_idx int")
    target = spark.createDataFrame([(1, 1, [1.0, 1.0])], "target_id long, campaign_id long, embedding array<double>")
    hits = sim.score_targets(target, sim.pack_banks(bank, assignments=clusters)).first()["hits"]
    assert {h["c"] for h in hits} == set(range(6))


def series(spark, rows):
    return spark.createDataFrame(rows, "seq_id long, idx long, score double")


def test_gaps_between_frames(spark):
    spaced = series(spark, [(1, 50 * i, 0.9) for i in range(6)] + [(2, 0, 0.9), (2, 900, 0.1)])
    dense = series(spark, [(1, i, 0.9) for i in range(6)] + [(2, 0, 0.9), (2, 1, 0.1)])
    for chunk in (2, 100, 4096):
        got = {r["seq_id"]: r["longest_streak"] for r in sq.continuity(spaced, F.lit(0.5), chunk=chunk).collect()}
        assert got == {1: 6, 2: 1}
        values = lambda df: sorted((r["seq_id"], r["smoothed"]) for r in sq.suppress_and_smooth(df, chunk=chunk).collect())
        assert values(spaced) == values(dense)
        assert {r["score"]: r["suppressed"] for r in sq.suppress_and_smooth(spaced.filter("seq_id = 2"), chunk=chunk).collect()} == {0.9: 0.9, 0.1: 0.1}


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 100])
def test_runs_across_chunks(spark, chunk):
    bits = [1, 1, 0, 1, 1, 1, 1, 0, 0, 1, 1, 1, 1, 1, 0, 1]
    df = series(spark, [(1, 3 * i, b * 0.5 + i / 100) for i, b in enumerate(bits)])
    r = sq.temporal_strength(df, F.lit(0.5), "score", chunk=chunk).first()
    assert (r["n"], r["longest_streak"]) == (16, 5)
    assert r["temporal_strength"] == pytest.approx(0.7 * (0.65 + 0.63 + 0.62) / 3 + 0.3 * r["frame_continuity_score"], abs=1e-4)


def test_scan_stops_at_the_first_confident_frame_whatever_its_number(spark):
    rows = [(1, 0, "Irrelevant", 10.0), (1, 400, "Relevant", 90.0), (1, 900, "Relevant", 99.0)]
    got = sq.best_until_confident(spark.createDataFrame(rows, "seq_id long, idx long, verdict string, confidence double")).first()
    assert (got["n_scanned"], got["idx"], got["confidence"]) == (2, 400, 90.0)


def listing(spark, rows):
    return spark.createDataFrame(rows, "path string, length long, modified long")


def test_equal_files_in_two_folders_count(spark):
    files = listing(spark, [("/m/a/x/a.jpg", 1, 1), ("/m/a/y/a.jpg", 1, 1), ("/m/b/x/b.jpg", 7, 9), ("/m/b/y/b.jpg", 7, 9), ("/m/b/n.txt", 1, 1), ("/m/top.jpg", 1, 1)])
    got = {r["campaign"]: (r["n_files"], r["fingerprint"]) for r in listings.bank_fingerprint(listings.campaign_files(files, "/m")).collect()}
    assert set(got) == {"a", "b"} and got["a"][0] == got["b"][0] == 2 and got["a"][1] != got["b"][1]
    pair = lambda name, v: spark.createDataFrame([(1, 1, name, [v]), (1, 1, name, [v])], "campaign_id long, ref_id long, ref_name string, embedding array<double>")
    none = pair("x", 0.0).limit(0).withColumnsRenamed({"ref_id": "neg_id", "ref_name": "neg_name"})
    assert bank_store.content_fingerprint(pair("a", 1.0), none).first()["fingerprint"] != bank_store.content_fingerprint(pair("b", 2.0), none).first()["fingerprint"]


def test_roots_are_names_not_patterns(spark):
    files = listing(spark, [("/m+x/c1/refs/a.jpg", 1, 1), ("/mmx/c2/refs/a.jpg", 1, 1)])
    assert [r["campaign"] for r in listings.resolve_roles(files, "/m+x").collect()] == ["c1"]
    tree = listing(spark, [("d(1/ann/tok/posts/a.jpg", 1, 1), ("d(1/ann/tok/drafts/a.jpg", 1, 1), ("d(1/ann/tok/posts/b/a.jpg", 1, 1), ("d(1//tok/posts/a.jpg", 1, 1)])
    assert [(r["influencer"], r["platform"]) for r in listings.scan_posts(tree, "d(1/").collect()] == [("ann", "tok")]


def test_every_url_has_a_row(spark):
    targets = spark.createDataFrame([("url", None, "u", f"http://{k}") for k in ("ok", "bad", "lost", "none")], "type string, path string, username string, url string")
    outcomes = spark.createDataFrame([("http://ok", ["a"], None), ("http://bad", None, "broken"), ("http://none", [], None)], "url string, media_paths array<string>, error string")
    assert [r["source_url"] for r in posts.expand_media(targets, outcomes).collect()] == ["http://ok"]
    got = {r["source_url"]: r["error"] for r in posts.attach_fetch_errors(targets, outcomes).collect()}
    assert got == {"http://bad": "broken", "http://lost": posts.NO_OUTCOME, "http://none": posts.NO_OUTCOME}


def test_empty_inputs(spark):
    assert posts.load_posts(spark.createDataFrame([], "a string, b string, row_index long")).columns == ["username", "link", "row_index"]
    with pytest.raises(ValueError, match="no user column"):
        posts.load_posts(spark.createDataFrame([("x", 1)], "a string, row_index long"))
    ocr = spark.createDataFrame([(1, 0, "some text", 0.5)], "item_id long, seq long, text string, conf double")
    got = mn.ocr_evidence(ocr, [], []).first()
    assert got["matched_terms"] == [] and not got["fired"]


def test_archive_ids_of_equal_names(spark):
    rows = [(i, 1, "keyframe_000000.jpg", 0.6, 0.7, 0.5, "x", 0.6, ["w"], [1.0]) for i in range(5)]
    schema = "target_id long, campaign_id long, filename string, primary_score double, competitor_similarity double, ambiguity_score double, verdict string, possible_threshold double, warnings array<string>, embedding array<double>"
    assert dg.failure_records(spark.createDataFrame(rows, schema)).select("archive_id").distinct().count() == 5


def test_staged_tables_have_an_owner(spark):
    df = staged(spark.range(3), "probe")
    assert df.count() == 3
    path = df.inputFiles()[0]
    release_staged(spark)
    assert not spark.sparkContext._jvm.java.io.File(path.removeprefix("file:")).exists()


def test_fixed_values():
    """Numbers that results depend on, written out: the SQL counterparts import them, this doesn't."""
    assert sim.COMPETITOR_WEIGHTS == (0.50, 0.30, 0.20) and sim.MARGIN == 0.12
    assert (sim.TOP_REFS, sim.TOP_CLUSTER, sim.TOP_NEGS) == (5, 3, 3)
    assert sq.KERNEL5 == (0.1, 0.2, 0.4, 0.2, 0.1) and (sq.SPIKE_MARGIN, sq.EDGE_FACTOR, sq.KEEP_EXCESS, sq.TOP_FRAMES) == (0.18, 1.5, 0.05, 3)
    assert paths.REFERENCE_EXTS == ("png", "jpg", "jpeg", "webp", "bmp", "tiff")
    assert paths.VIDEO_EXTS == ("mp4", "avi", "mov", "mkv", "webm")
    assert (listings.POSITIVE_DIRS, listings.NEGATIVE_DIRS) == (("positive_refs", "positives", "refs", "references"), ("hard_negatives", "negatives"))
    assert [b[0] for b in scoring.VERDICT_BANDS] == sorted((b[0] for b in scoring.VERDICT_BANDS), reverse=True)
    assert len(media.OFFSET_RULES) == 5 and len(ev.LAYERS) == 6 and 0 < banks.OUTLIER_BELOW < 1
