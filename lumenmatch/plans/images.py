"""Match single images: one narrow pass over the targets once the banks are built."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenmatch.functions import scoring as s
from lumenmatch.functions.media import media_context
from lumenmatch.operators.banks import KEY
from lumenmatch.operators.diagnostics import boost_warnings, diagnostics, explain
from lumenmatch.operators.similarity import cluster_topk, competitor_eval, dominant_cluster, score_targets, target_stats
from lumenmatch.sources.bank_store import Banks

COHESION_FIELDS = (
    "cluster_quality", "intra_similarity_mean", "intra_similarity_std", "silhouette_score", "outliers", "recommendations",
)
FRAME_TYPE = (
    "array<struct<frame_id:string,max_similarity:double,avg_similarity:double,top_k_avg:double,best_reference:string,"
    "best_reference_similarity:double,smoothed_similarity:double,competitor_similarity:double,raw_score:double>>"
)
FEATURES = ("width", "height", "bottom", "top", "right", "status", "subtitle", "edge_std", "edge_mean")


def with_media_context(df: DataFrame) -> DataFrame:
    return df.withColumn("media_context", media_context(*[F.col(c) for c in FEATURES]))


def score_vectors(items: DataFrame, banks: Banks, kernel: str = "jvm", keys: tuple[str, ...] = ("target_id",)) -> DataFrame:
    """All per-vector evidence: similarities, dominant cluster, cluster top-k, competitors and the fused score."""
    scored = target_stats(score_targets(items, banks.packs, banks.size, kernel, keys))
    df = competitor_eval(cluster_topk(dominant_cluster(scored, banks.stats, banks.size)))
    return df.withColumn("variance", F.coalesce("variance", F.lit(0.0))).withColumn(
        "fused_score", s.fused_score(F.col("max_similarity"), F.col("cluster_similarity"), F.col("cluster_top_k_avg"))
    )


def decide(df: DataFrame, best: str, label: str, social: str, offset: str, video: bool) -> DataFrame:
    """From primary_score to confidence, boosts and verdict. Rows without references stay at the defaults."""
    c = F.col
    ready = c("n_refs") > 0
    df = (
        df.withColumn("strong_threshold", s.strong_threshold(c("variance"), c("n_refs"), c(offset)))
        .withColumn("possible_threshold", s.possible_threshold(c("variance"), c("n_refs"), c(offset)))
        .withColumn("calibrated", s.calibrate(c("primary_score"), c("strong_threshold"), c("possible_threshold")))
        .withColumn("social_adjustment", F.when(ready, s.social_boost(c(best), c("competitor_similarity"), c(social), c(label))).otherwise(0.0))
        .withColumn("product_boost", F.when(ready, s.product_boost(c(best), c("competitor_similarity"), c(label))).otherwise(0.0))
    )
    boosted = s.apply_boosts(c("calibrated"), c("social_adjustment"), c("product_boost"))
    df = df.withColumn("confidence_raw", F.when(ready, boosted).otherwise(0.0))
    return (
        df.withColumn("match_type", s.match_type(c("confidence_raw")))
        .withColumn("campaign_match", s.campaign_match(c("confidence_raw")))
        .withColumn("verdict", s.verdict(c("confidence_raw")))
        .withColumn("boost_warnings", boost_warnings(c("social_adjustment"), c("product_boost"), video))
    )


def match_images(targets: DataFrame, banks: Banks, kernel: str = "jvm") -> DataFrame:
    """One result row per target. Targets of a campaign without references are kept as NO_MATCH."""
    c = F.col
    df = score_vectors(with_media_context(targets), banks, kernel)
    df = df.withColumn("primary_score", s.clamp01(c("fused_score") - c("penalty")))
    df = df.withColumn("_social", c("media_context.is_social_media")).withColumn("_offset", c("media_context.suggested_threshold_offset"))
    df = decide(df, "max_similarity", "dominant_cluster", "_social", "_offset", video=False)
    ready = c("n_refs") > 0
    found = F.concat(
        F.array_compact(F.array("competitor_warning")),
        c("boost_warnings"),
        diagnostics(c("primary_score"), c("max_similarity"), c("competitor_similarity"), c("ambiguity_score"), c("variance"), c("n_refs")),
    )
    df = (
        df.withColumn("warnings", F.when(ready, found).otherwise(F.array().cast("array<string>")))
        .withColumn("best_frame", F.when(ready, c("filename")).otherwise(""))
        .withColumn("temporal_strength", F.lit(0.0))
        .withColumn("num_frames_analyzed", F.when(ready, 1).otherwise(0))
    )
    frame = F.struct(
        c("filename").alias("frame_id"), s.r4(c("max_similarity")).alias("max_similarity"),
        s.r4(c("avg_similarity")).alias("avg_similarity"), s.r4(c("cluster_top_k_avg")).alias("top_k_avg"),
        "best_reference", s.r4(c("max_similarity")).alias("best_reference_similarity"),
        s.r4(c("confidence_raw")).alias("smoothed_similarity"), s.r4(c("competitor_similarity")).alias("competitor_similarity"),
        s.r4(c("fused_score")).alias("raw_score"),
    )
    df = explain(df).withColumn("frame_scores", F.when(ready, F.array(frame)).otherwise(F.array().cast(FRAME_TYPE)))
    return finalize(df, banks, c("strong_threshold"))


def finalize(df: DataFrame, banks: Banks, threshold) -> DataFrame:
    """Rounded result columns next to the unrounded working columns that reports and archives need."""
    c = F.col
    ready = c("n_refs") > 0
    side = banks.stats.select(KEY, F.struct(*COHESION_FIELDS).alias("cohesion_metrics"))
    df = df.join(F.broadcast(side) if banks.size.broadcastable else side, KEY, "left")
    return (
        df.withColumn("confidence", s.r4(c("confidence_raw")))
        .withColumn("confidence_pct", s.confidence_pct(c("confidence_raw")))
        .withColumn("top_similarity", s.r4(c("max_similarity")))
        .withColumn("average_similarity", s.r4(c("avg_similarity")))
        .withColumn("num_references", c("n_refs"))
        .withColumn("reference_variance", s.r4(c("variance")))
        .withColumn("threshold_used", F.when(ready, s.r4(threshold)).otherwise(0.0))
    )
