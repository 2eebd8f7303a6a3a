"""Registered queries: every operator applied to the provided tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmatch import datasets as d
from lumenmatch.functions import paths, scoring as s, text as tx, vectors as v
from lumenmatch.operators import banks as bk, clusters as cl, diagnostics as dg, evidence as ev, frames as fr
from lumenmatch.operators import mentions as mn, reports as rp, sequences as sq, similarity as sim
from lumenmatch.plans import brands as pb, campaign as pc, evaluation as pe, images as pi, keyframes as pk, videos as pv
from lumenmatch.session import shared_dir, staged
from lumenmatch.sources import bank_store, listings, posts as po

KEY = bk.KEY


def r(col: str, places: int = 6, name: str | None = None):
    return F.round(col, places).alias(name or col)


def long(col: str, name: str | None = None):
    return F.col(col).cast("long").alias(name or col)


_OPEN_BANKS: dict[tuple, bank_store.Banks] = {}


def banks(spark: SparkSession, sf: str) -> bank_store.Banks:
    """Bank handle, opened once per application and state of the input files; the store rebuilds only changed campaigns."""
    files = d.table(spark, sf, "embeddings").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.count("*"), F.sum(F.xxhash64(*files.columns).cast("decimal(20,0)"))).first()
    key = (spark.sparkContext.applicationId, sf, *state)
    if key not in _OPEN_BANKS:
        _OPEN_BANKS[key] = bank_store.materialize_banks(d.bank(spark, sf), d.neg_bank(spark, sf), f"{shared_dir(spark)}/banks")
    return _OPEN_BANKS[key]


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return pi.score_vectors(d.targets(spark, sf), banks(spark, sf))


def matched(spark: SparkSession, sf: str) -> DataFrame:
    return pi.match_images(d.targets(spark, sf), banks(spark, sf))


def result_table(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The named columns of the image results as a written table. A report over the matching itself would put both into one
    generated method, which grows beyond what the JVM compiles."""
    return staged(matched(spark, sf).select(*columns), "results")


def stats_only(spark: SparkSession, sf: str) -> DataFrame:
    return sim.target_stats(sim.score_targets(d.targets(spark, sf), sim.pack_banks(d.bank(spark, sf))))


# --- vectors and banks -------------------------------------------------------------------------------------------


def l2_normalize(spark, sf):
    e = d.table(spark, sf, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 7 + 1))
    u = e.select("vec_id", v.l2_normalize(scaled).alias("u"))
    return u.select("vec_id", F.posexplode("u").alias("pos", "value")).select("vec_id", long("pos"), r("value"))


def pair_similarity(spark, sf):
    return sim.pair_similarities(d.targets(spark, sf), d.bank(spark, sf)).select("target_id", KEY, "ref_id", "ref_name", r("similarity"))


def top_matches(spark, sf):
    m = stats_only(spark, sf).select("target_id", F.explode("top_matches").alias("m"))
    return m.select("target_id", F.col("m.rank").cast("long").alias("rank"), "m.reference_name", "m.similarity")


def target_stats(spark, sf):
    return stats_only(spark, sf).select("target_id", "n_refs", r("max_similarity"), r("avg_similarity"), r("top_k_avg"), "best_reference")


def bank_centroid(spark, sf):
    c = bk.bank_centroid(d.bank(spark, sf)).select(KEY, "n_refs", F.posexplode("centroid").alias("pos", "value"))
    return c.select(KEY, "n_refs", long("pos"), r("value"))


def bank_variance(spark, sf):
    return bk.bank_variance(d.bank(spark, sf)).select(KEY, "n_refs", r("variance"))


def intra_similarity(spark, sf):
    return bk.intra_similarity(d.bank(spark, sf)).select(KEY, "n_refs", r("intra_similarity_mean"), r("intra_similarity_std"))


def outliers(spark, sf):
    return bk.outliers(d.bank(spark, sf)).select(KEY, "ref_id", "ref_name", r("similarity"))


def silhouette(spark, sf):
    return bk.silhouette(d.bank(spark, sf), d.neg_bank(spark, sf)).select(KEY, "n_refs", "n_negs", r("silhouette_score"))


def cohesion(spark, sf):
    return bk.cohesion(d.bank(spark, sf), d.neg_bank(spark, sf)).select(
        KEY, "cluster_quality", "intra_similarity_mean", "intra_similarity_std", "silhouette_score",
        F.array_join("outliers", "|").alias("outliers"), F.array_join("recommendations", "|").alias("recommendations"),
    )


def farthest_first(spark, sf):
    return cl.farthest_first(d.bank(spark, sf)).select(KEY, long("cluster_idx"), "ref_id")


def cluster_members(spark, sf):
    return cl.cluster_assignments(d.bank(spark, sf)).select(KEY, "ref_id", long("cluster_idx"))


def _clusters(df):
    return df.select(KEY, long("cluster_idx"), "n_members", "label", r("variance"), r("avg_similarity"))


def cluster_members_rounds(spark, sf):
    """All campaigns dealt to parts of few references."""
    return cl.cluster_assignments(d.bank(spark, sf), per_part=5).select(KEY, "ref_id", long("cluster_idx"))


def whole_bank_similarity(spark, sf):
    """A bank whose parts are added up, next to banks of one part."""
    return bk.intra_similarity(d.bank(spark, sf).unionByName(d.whole_bank(spark, sf)), per_part=100).select(KEY, "n_refs", r("intra_similarity_mean"), r("intra_similarity_std"))


def reference_clusters(spark, sf):
    return _clusters(cl.cluster_references(d.bank(spark, sf)))


def cohesion_clusters(spark, sf):
    return _clusters(cl.cluster_references(d.bank(spark, sf), k=3, iters=20, labels="cohesion"))


# --- scoring -----------------------------------------------------------------------------------------------------


def dominant_cluster(spark, sf):
    return scored(spark, sf).select(
        "target_id", "dominant_cluster", long("cluster_idx"), "cluster_similarity", "cluster_confidence", r("centroid_similarity"),
        "best_cluster_label", r("best_cluster_centroid_sim"),
    )


def cluster_topk(spark, sf):
    return scored(spark, sf).select("target_id", r("cluster_top_k_avg"), r("fused_score"))


def competitor_eval(spark, sf):
    return scored(spark, sf).select(
        "target_id", "n_negs", "competitor_similarity", "ambiguity_score", "penalty", "ambiguity_status", "best_competitor",
        F.coalesce("competitor_warning", F.lit("")).alias("competitor_warning"),
    )


def thresholds(spark, sf):
    return matched(spark, sf).select("target_id", r("strong_threshold"), r("possible_threshold"))


def calibrate(spark, sf):
    e = d.table(spark, sf, "events").select("event_id", "user_id", (F.col("value") / (F.col("value") + 20)).alias("score"))
    strong = F.lit(0.75) + (F.col("user_id") % 4) * F.lit(0.05)
    possible = F.lit(0.60) + (F.col("user_id") % 5) * F.lit(0.05)
    return e.select("event_id", F.round(s.calibrate(F.col("score"), strong, possible), 6).alias("confidence"))


def boosts(spark, sf):
    return matched(spark, sf).select("target_id", "social_adjustment", "product_boost", r("calibrated"), r("confidence_raw"))


def verdict(spark, sf):
    c = F.col("value") / (F.col("value") + 20)
    return d.table(spark, sf, "events").select(
        "event_id", s.match_type(c).alias("match_type"), s.campaign_match(c).alias("campaign_match"), s.verdict(c).alias("verdict"),
        s.confidence_pct(c).alias("confidence_pct"), F.round(s.decision_margin(c, F.lit(0.85)), 6).alias("decision_margin"),
        s.frame_matched(c, F.lit(0.7)).alias("matched"),
    )


def match_images(spark, sf):
    return matched(spark, sf).select(
        "target_id", KEY, "campaign_match", "confidence", "match_type", "top_similarity", "average_similarity", "best_reference",
        "best_frame", "num_references", long("num_frames_analyzed"), "reference_variance", "threshold_used", "competitor_similarity",
        "ambiguity_score", "verdict", "confidence_pct", "dominant_cluster", "cluster_similarity", "social_adjustment", "product_boost",
        F.col("cohesion_metrics.cluster_quality").alias("cluster_quality"), F.col("media_context.reasoning").alias("reasoning"),
        F.get("frame_scores", F.lit(0))["raw_score"].alias("raw_score"),
    )


def diagnostics(spark, sf):
    return result_table(spark, sf, "target_id", "warnings").select("target_id", F.posexplode("warnings").alias("pos", "warning")).select("target_id", long("pos"), "warning")


def explain(spark, sf):
    m = result_table(spark, sf, "target_id", "explainability").select(
        "target_id", F.col("explainability.ambiguity_reason").alias("ambiguity_reason"),
        F.posexplode("explainability.reasoning_steps").alias("pos", "step"),
    )
    return m.select("target_id", "ambiguity_reason", long("pos"), "step")


def failure_cases(spark, sf):
    return dg.failure_records(result_table(spark, sf, "target_id", KEY, *dg.ARCHIVED)).select(
        "filename", F.regexp_extract("archive_id", "^fail_(.*)_[0-9]+_[0-9]+_[0-9]+$", 1).alias("clean_name"), "similarity_score",
        "competitor_similarity", "ambiguity_score", "verdict", "threshold_used", "is_near_miss", "is_ambiguous",
        F.size("warnings").cast("long").alias("n_warnings"),
    )


# --- sequences ---------------------------------------------------------------------------------------------------


def failure_archive(spark, sf):
    """The archive of two runs, written and read back: cases per verdict."""
    path = f"{shared_dir(spark)}/failures-{uuid.uuid4().hex}"
    results = result_table(spark, sf, "target_id", KEY, *dg.ARCHIVED)
    for _ in range(2):
        dg.write_failure_cases(results, path)
    kept = spark.read.parquet(path)
    return kept.groupBy("verdict").agg(
        F.count("*").alias("n"), F.count_if("is_near_miss").alias("near_misses"), F.count_if("is_ambiguous").alias("ambiguous"), F.countDistinct("filename").alias("files"),
        F.round(F.max("similarity_score"), 4).alias("most_similar"),
    )


def spike_suppression(spark, sf):
    return sq.suppress_spikes(d.scores(spark, sf)).select("seq_id", "idx", r("suppressed"))


def kernel_smoothing(spark, sf):
    five = sq.smooth(d.scores(spark, sf)).withColumnRenamed("smoothed", "smoothed5")
    return sq.smooth(five, window=7).select("seq_id", "idx", r("smoothed5"), r("smoothed", name="smoothed7"))


def _smoothed(spark, sf):
    return sq.suppress_and_smooth(d.scores(spark, sf))


def continuity(spark, sf):
    return sq.continuity(d.scores(spark, sf), F.lit(0.55)).select("seq_id", "n", "longest_streak", "streak_ratio", "frame_continuity_score")


def stable_segments(spark, sf):
    return sq.stable_segments(_smoothed(spark, sf), F.lit(0.55), "smoothed")


def temporal_strength(spark, sf):
    return sq.temporal_strength(_smoothed(spark, sf), F.lit(0.55))


def best_until_confident(spark, sf):
    c = F.round(F.col("score") * 100, 1)
    f = d.scores(spark, sf).select(
        "seq_id", "idx", c.alias("confidence"), F.when(c >= 70, "Relevant").when(c >= 45, "Uncertain").otherwise("Irrelevant").alias("verdict")
    )
    return sq.best_until_confident(f)


def _video_evidence(spark, sf):
    b = banks(spark, sf)
    return pv.video_evidence(d.frames(spark, sf), b, step=1), b


def match_videos(spark, sf):
    m = pv.video_results(*_video_evidence(spark, sf))
    return m.select(
        "video_id", KEY, "campaign_match", "confidence", "match_type", "top_similarity", "average_similarity", "best_reference",
        "best_frame", "num_references", "num_frames_analyzed", "threshold_used", "temporal_strength", "longest_streak",
        "competitor_similarity", F.round("ambiguity_score", 4).alias("ambiguity_score"), "verdict", "confidence_pct", "dominant_cluster",
        F.col("explainability.dominant_cluster").alias("explained_cluster"),
        F.col("explainability.social_adjustment").alias("explained_social"),
        F.col("explainability.product_boost").alias("explained_product"),
        F.col("media_context.reasoning").alias("reasoning"), F.array_join("warnings", "|").alias("warnings"),
    )


def shared_targets(spark, sf):
    """Targets asked of two campaigns and of a bank of many blocks."""
    t = d.targets(spark, sf)
    asked = d.with_neighbours(t).unionByName(t.withColumn("campaign_id", F.lit(-1).cast("long")))
    bank = d.bank(spark, sf).unionByName(d.whole_bank(spark, sf))
    known = asked.join(F.broadcast(bank.select(KEY).distinct()), KEY, "left_semi")
    stats = sim.target_stats(sim.score_targets(known, staged(sim.pack_banks(bank), "packs")))
    return stats.select("target_id", KEY, "n_refs", r("max_similarity"), r("avg_similarity"), r("top_k_avg"), "best_reference")


def shared_videos(spark, sf):
    """Videos asked of two campaigns, with gaps between the numbers of their frames."""
    b = banks(spark, sf)
    frames = d.with_neighbours(d.frames(spark, sf)).withColumn("frame_idx", F.col("frame_idx") * 50)
    m = pv.match_videos(frames, b, step=50).filter("num_references > 0")
    return m.select("video_id", KEY, "num_frames_analyzed", "top_similarity", "best_reference", "best_frame", "temporal_strength", "longest_streak")


def frame_scores(spark, sf):
    return pv.frame_scores(_video_evidence(spark, sf)[0]).drop("best_reference_similarity")


def video_segments(spark, sf):
    return pv.video_segments(_video_evidence(spark, sf)[0]).drop(KEY)


def sequence_context(spark, sf):
    c = pv.sequence_context(pi.with_media_context(d.frames(spark, sf)))
    return c.select("video_id", KEY, "media_context.*")


# --- frames and media --------------------------------------------------------------------------------------------


def sample_interval(spark, sf):
    return fr.sample_interval(d.videos(spark, sf)).select("video_id", "frame_idx")


def sample_even(spark, sf):
    return fr.sample_even(d.videos(spark, sf)).select("video_id", "frame_idx")


def blur_filter(spark, sf):
    kept = fr.blur_filter(fr.sample_interval(d.videos(spark, sf)), d.frame_features(spark, sf))
    return kept.select("video_id", "frame_idx", "use_idx", "replaced")


def frame_diff(spark, sf):
    p = d.frame_pictures(fr.sample_even(d.videos(spark, sf)))
    first = p.filter("frame_idx = 0").select("video_id", F.col("thumb").alias("t0"), F.col("hist").alias("h0"))
    pairs = p.join(first, "video_id")
    return pairs.select(
        "video_id", "frame_idx", F.round(fr.frame_diff(F.col("t0"), F.col("thumb")), 6).alias("difference"),
        F.round(fr.histogram_correlation(F.col("h0"), F.col("hist")), 6).alias("correlation"),
    )


def dedupe_frames(spark, sf):
    pictures = d.frame_pictures(fr.sample_interval(d.videos(spark, sf)))
    return fr.dedupe_frames(pictures).select("video_id", "frame_idx", long("kept_order"))


def keyframe_match(spark, sf):
    """Whole videos: sampled, sharpened, without repeats, matched."""
    used = staged(pk.replaced_frames(d.videos(spark, sf), d.frame_features(spark, sf)), "used")
    keyed = staged(pk.key_frames(d.frame_pictures(used)), "keyed")
    m = pk.match_key_frames(keyed, d.frame_vectors(spark, sf, keyed), banks(spark, sf))
    return m.select(
        "video_id", KEY, "num_frames_analyzed", "match_type", "top_similarity", "best_reference", "best_frame", "temporal_strength", "longest_streak",
        "competitor_similarity", "threshold_used", "confidence",
    )


def dedupe_frames_rounds(spark, sf):
    """All videos in batches of three frames, so that decisions depend on those of earlier batches."""
    pictures = d.frame_pictures(fr.sample_interval(d.videos(spark, sf)))
    return fr.dedupe_frames(pictures, batch=3).select("video_id", "frame_idx", long("kept_order"))


def media_context(spark, sf):
    return pi.with_media_context(d.targets(spark, sf)).select("target_id", "media_context.*")


# --- text and evidence -------------------------------------------------------------------------------------------


def text_normalize(spark, sf):
    n = tx.normalize_text(F.col("text"))
    return d.table(spark, sf, "documents").select(
        "doc_id", F.md5(n.cast("binary")).alias("digest"), F.length(n).cast("long").alias("n"),
        tx.fuzzy_contains(F.col("text"), F.lit(" ANBLE")).alias("has_term"),
    )


def brand_mentions(spark, sf):
    return mn.brand_mentions(d.table(spark, sf, "documents"), ["doc_id"], "text", d.BRAND_TERMS)


def term_table_mentions(spark, sf):
    """Hundreds of terms as a table: words of benchmark items and their first two words."""
    return mn.brand_mentions(d.table(spark, sf, "documents"), ["doc_id"], "text", d.mention_terms(spark, sf))


def ocr_term_table(spark, sf):
    """The OCR layer over the same table of terms."""
    o = mn.ocr_evidence(d.ocr_rows(spark, sf), d.mention_terms(spark, sf), d.HASHTAGS)
    return o.select("item_id", F.array_join("brand_matched", "|").alias("brand_matched"), F.array_join("hashtag_matched", "|").alias("hashtag_matched"), r("score"), "fired")


def ocr_evidence(spark, sf):
    o = mn.ocr_evidence(d.ocr_rows(spark, sf), d.BRAND_TERMS, d.HASHTAGS)
    return o.select("item_id", "ocr_head", r("avg_conf"), F.array_join("matched_terms", "|").alias("matched_terms"), r("score"), "fired", "weight", "evidence")


def caption_evidence(spark, sf):
    c = mn.caption_evidence(d.captions(spark, sf), [*d.BRAND_TERMS, *d.KEYWORDS])
    return c.select("item_id", F.array_join("matched_terms", "|").alias("matched_terms"), r("score"), "fired", "weight", "evidence")


def prompt_table(spark, sf):
    return mn.prompt_table(d.brands(spark, sf)).select("brand_id", "prompt_kind", long("prompt_idx"), "prompt")


def class_table(spark, sf):
    return mn.class_table(d.brands(spark, sf)).select("brand_id", long("class_idx"), "class_name")


def _layer(df):
    return df.select("item_id", "layer", r("score"), "fired", "evidence", "weight")


def image_layer(spark, sf):
    return _layer(ev.image_layer(stats_only(spark, sf).withColumnRenamed("target_id", "item_id")))


def prompt_layer(spark, sf):
    return _layer(ev.prompt_layer(d.prompt_sims(spark, sf)))


def detections(spark, sf):
    return ev.detections(d.boxes(spark, sf)).select("item_id", "event_id", "kind", "label", r("conf3", 3))


def detection_layer(spark, sf):
    return _layer(ev.detection_layer(d.boxes(spark, sf)))


def brand_video(spark, sf):
    """The items of a user, one a day, as frames of a sequence: the best frame's whole result, and a sequence without frames."""
    day = F.datediff(F.to_date(F.regexp_replace("item_id", "^[0-9]+-", "")), F.lit("2024-01-01").cast("date"))
    frames = ev.brand_verdict(ev.ensemble(d.evidence(spark, sf))).select("*", F.split("item_id", "-")[0].cast("long").alias("seq_id"), day.cast("long").alias("idx"))
    sequences = frames.select("seq_id").unionByName(spark.range(-1, 0).withColumnRenamed("id", "seq_id"))
    out = ev.brand_video(frames, sequences)
    return out.select("seq_id", "n_scanned", "idx", "item_id", "verdict", "confidence", "confidence_raw", "label")


def color_layer(spark, sf):
    return _layer(ev.color_layer(d.colors(spark, sf), d.PALETTE))


def hex_colors(spark, sf):
    code = F.format_string("#%06x", (F.col("p_partkey") * 2654435) % 16777216)
    return d.table(spark, sf, "part").select("p_partkey", code.alias("hex"), ev.hex_rgb(code).alias("c")).select(
        "p_partkey", "hex", *[F.col(f"c.{n}").cast("long").alias(n) for n in "rgb"]
    )


def ensemble(spark, sf):
    return ev.ensemble(d.evidence(spark, sf)).select("item_id", F.col("fired_count").cast("long").alias("fired_count"), r("ensemble_score"))


def brand_verdict(spark, sf):
    return ev.brand_verdict(ev.ensemble(d.evidence(spark, sf))).select("item_id", "verdict", "confidence", "confidence_raw", "label")


def detect_brands(spark, sf):
    """All six layers keyed by the item number: documents as captions, conversations as OCR text, part colours, event boxes,
    targets with their prompt similarities. Each layer's score stays beside the verdict."""
    brand = pb.Brand(d.BRAND_TERMS[0], d.BRAND_TERMS[1:], d.HASHTAGS, d.KEYWORDS, d.PALETTE)
    items = d.captions(spark, sf).select("item_id")
    out = pb.detect_brands(
        items, brand, captions=d.captions(spark, sf), ocr=d.ocr_rows(spark, sf), colors=d.colors(spark, sf), boxes=d.boxes(spark, sf),
        scored=stats_only(spark, sf).withColumnRenamed("target_id", "item_id"), prompt_sims=d.prompt_sims(spark, sf),
    )
    return out.select("item_id", "verdict", "confidence", "confidence_raw", "label", *[r(f"{n}_score") for n in ev.LAYERS])


# --- reports -----------------------------------------------------------------------------------------------------


def score_distribution(spark, sf):
    return rp.score_distribution(d.scores(spark, sf))


def social_analytics(spark, sf):
    m = result_table(spark, sf, KEY, "filename", "media_context", "social_adjustment")
    a = rp.social_analytics(m, [KEY])
    dist = F.array_join(F.transform(F.map_entries("platform_distribution"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return a.withColumn("platform_distribution", dist)


def run_summary(spark, sf):
    return rp.run_summary_with_banks(result_table(spark, sf, KEY, "match_type", "campaign_match"), banks(spark, sf).stats)


def evaluation(spark, sf):
    e = pe.evaluate_matching(d.targets(spark, sf), banks(spark, sf))
    return e.select("tp", "fn", "fp", "tn", r("precision", 4), r("recall", 4), r("fpr", 4), r("fnr", 4), r("f1", 4))


def evaluation_predictions(spark, sf):
    return pe.predictions(d.targets(spark, sf), banks(spark, sf)).select("target_id", r("score"), "is_match", "match_type")


def _campaign_results(spark, sf):
    t = d.targets(spark, sf)
    # file targets of the run: all targets as images plus every frame sequence as one video file, whatever its first frame is
    clips = d.frames(spark, sf).select(F.col("video_id").alias("target_id"), KEY).distinct().withColumn(
        "filename", F.concat(F.lit("clip_"), F.col("target_id"), F.lit(".mp4"))
    )
    # video files without frames get numbers that no sequence has
    number = F.when(paths.media_type(F.col("filename")) == "video", -1 - F.col("target_id")).otherwise(F.col("target_id"))
    files = t.withColumn("target_id", number)
    targets, outcomes = _targets_and_outcomes(spark, sf)
    failures = po.attach_fetch_errors(targets, outcomes).withColumn(KEY, F.length("source_url").cast("long") % 10)
    return pc.campaign_results(files.unionByName(clips, allowMissingColumns=True), d.frames(spark, sf), banks(spark, sf), failures=failures, step=1)


def bankless_matches(spark, sf):
    """Targets asked of a campaign without references, next to the same ones asked of their own."""
    t = d.targets(spark, sf)
    m = pi.match_images(t.unionByName(t.withColumn(KEY, F.lit(-1).cast("long"))), banks(spark, sf))
    return m.groupBy(KEY).agg(
        F.count("*").alias("n"), F.count_if(F.col("match_type") != "NO_MATCH").alias("matched"), F.count_if(F.size("warnings") > 0).alias("warned"),
        F.round(F.max("confidence"), 4).alias("most"),
    )


def bank_readiness(spark, sf):
    campaigns = d.targets(spark, sf).select(KEY).unionByName(spark.range(-2, 0).select(F.col("id").alias(KEY)))
    return bank_store.bank_readiness(campaigns, banks(spark, sf))


def bank_reuse(spark, sf):
    """A store opened twice, the second time without one reference of campaign 3: only that campaign is built again."""
    root = f"{shared_dir(spark)}/reuse-{uuid.uuid4().hex}"
    bank, neg = d.bank(spark, sf), d.neg_bank(spark, sf)
    bank_store.materialize_banks(bank, neg, root)
    last = bank.filter(F.col(KEY) == 3).agg(F.max("ref_id").alias("ref_id"))
    bank_store.materialize_banks(bank.join(last, "ref_id", "left_anti"), neg, root)
    return bank_store.bank_builds(spark, root)


def report_payload(spark, sf):
    """The written report, read back: summary of the header and the lines of each campaign."""
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    results = result_table(spark, sf, KEY, "target_id", "match_type", "campaign_match", "filename", "media_context", "social_adjustment")
    headers, lines = rp.read_report(spark, path, rp.write_report(results, banks(spark, sf).stats, path))
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    counts = lines.groupBy(KEY).agg(F.count("*").alias("lines"), F.count_if(F.get_json_object("result", "$.campaign_match") == "true").alias("matched_lines"))
    read = headers.select(
        KEY, *[field(f"summary.{n}").cast("long").alias(n) for n in ("num_targets", "matches", "rejections", "num_references")],
        field("summary.cluster_quality").alias("cluster_quality"), field("social_analytics.social_targets").cast("long").alias("social_targets"),
    )
    return read.join(counts, KEY).withColumn(KEY, F.col(KEY).cast("long"))


def campaign_report(spark, sf):
    return rp.run_summary(_campaign_results(spark, sf), [KEY])


def campaign_results(spark, sf):
    return _campaign_results(spark, sf).select(
        KEY, "file", "match_type", "verdict", "confidence", "best_reference", long("num_frames_analyzed"), "social_adjustment",
        F.coalesce("source_url", F.lit("")).alias("source_url"), F.coalesce("error", F.lit("")).alias("error"),
    )


def campaign_analytics(spark, sf):
    """Social figures over images, videos and failed fetches together."""
    a = rp.social_analytics(staged(_campaign_results(spark, sf).select(KEY, "filename", "media_context", "social_adjustment"), "run"), [KEY])
    dist = F.array_join(F.transform(F.map_entries("platform_distribution"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return a.withColumn("platform_distribution", dist)


def debug_exports(spark, sf):
    return rp.debug_exports(result_table(spark, sf, "target_id", "filename", "top_matches", "frame_scores", "warnings"), ["target_id"])["frame_scores"].select(
        "target_id", "frame_id", "max_similarity", "avg_similarity", "top_k_avg", "smoothed_similarity", "raw_score"
    )


def debug_matches(spark, sf):
    table = result_table(spark, sf, "target_id", "top_matches")
    return rp.debug_exports(table, ["target_id"])["top_matches"].select("target_id", long("rank"), "reference_name", "similarity")


def debug_headers(spark, sf):
    table = result_table(spark, sf, "target_id", "top_matches", *rp.DEBUG_HEADER)
    header = rp.debug_exports(table, ["target_id"])["similarity_debug"]
    return header.select(
        "target_id", *[long(c) if c.startswith("num_") else c for c in rp.DEBUG_HEADER[:-2]],
        F.col("cohesion_metrics.cluster_quality").alias("cluster_quality"), F.col("media_context.reasoning").alias("reasoning"),
    )


def flatten_results(spark, sf):
    flat = rp.flatten_results(result_table(spark, sf, "target_id", "verdict", "cohesion_metrics", "media_context", "warnings"))
    return flat.select("target_id", "verdict", "cohesion_metrics_cluster_quality", "media_context_is_social_media", "media_context_reasoning", F.length("warnings").cast("long").alias("warnings_chars"))


# --- sources -----------------------------------------------------------------------------------------------------


def list_media(spark, sf):
    return listings.unique_files(d.listing(spark, sf)).select("path", "length")


def list_targets(spark, sf):
    return listings.list_targets(d.listing(spark, sf)).select("path", paths.media_type(F.col("path")).alias("media_type"))


def resolve_roles(spark, sf):
    return listings.resolve_roles(d.listing(spark, sf), "/media").select("campaign", "path", "role")


def scan_posts(spark, sf):
    return listings.scan_posts(d.post_files(spark, sf), "data").withColumn("media_type", paths.media_type(F.col("path")))


def bank_fingerprint(spark, sf):
    return listings.bank_fingerprint(listings.campaign_files(d.listing(spark, sf), "/media"))


def posts_clean(spark, sf):
    return po.load_posts(d.posts(spark, sf))


def media_urls(spark, sf):
    u = F.col("url")
    return d.media_urls(spark, sf).select(
        "page_id", "url", paths.url_ext(u).alias("ext"), paths.is_direct_media(u).alias("direct"), paths.manifest_name(u).alias("manifest")
    )


def _targets_and_outcomes(spark, sf):
    urls = d.media_urls(spark, sf).select(F.concat(F.lit("user "), F.col("page_id")).alias("username"), F.col("url").alias("link"))
    targets = po.union_targets(listings.list_targets(d.listing(spark, sf)).select("path"), urls)
    return targets, d.outcomes(urls.select(F.col("link").alias("url")).distinct())


def union_targets(spark, sf):
    return _targets_and_outcomes(spark, sf)[0]


def expand_media(spark, sf):
    return po.expand_media(*_targets_and_outcomes(spark, sf))


def fetch_errors(spark, sf):
    return po.attach_fetch_errors(*_targets_and_outcomes(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        l2_normalize, pair_similarity, top_matches, target_stats, bank_centroid, bank_variance, intra_similarity, outliers, silhouette,
        cohesion, farthest_first, cluster_members, cluster_members_rounds, whole_bank_similarity, reference_clusters, cohesion_clusters, dominant_cluster, cluster_topk,
        competitor_eval, thresholds, calibrate, boosts, verdict, match_images, diagnostics, explain, failure_cases, failure_archive,
        spike_suppression, kernel_smoothing, continuity, stable_segments, temporal_strength, best_until_confident, match_videos,
        shared_targets, shared_videos, frame_scores, video_segments, sequence_context, sample_interval, sample_even, blur_filter, frame_diff, dedupe_frames, dedupe_frames_rounds, keyframe_match,
        media_context, text_normalize, brand_mentions, term_table_mentions, ocr_term_table, ocr_evidence, caption_evidence, prompt_table, class_table, image_layer,
        prompt_layer, detections, detection_layer, brand_video, bankless_matches, bank_readiness, bank_reuse, report_payload, color_layer, hex_colors, ensemble, brand_verdict, detect_brands,
        score_distribution, social_analytics, run_summary, evaluation, evaluation_predictions, campaign_report, campaign_results, campaign_analytics,
        debug_exports, debug_matches, debug_headers, flatten_results, list_media, list_targets, resolve_roles, scan_posts, bank_fingerprint, posts_clean, media_urls, union_targets,
        expand_media, fetch_errors,
    )
}
