"""Diagnostic warnings, the explanation block and the failure-case archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenmatch.functions.scoring import r4
from lumenmatch.functions.text import fixed3

# Message texts.
HIGH_OVERLAP = (
    "HIGH COMPETITOR OVERLAP: Peak competitor similarity is extremely high (%s). "
    "The target content shares strong visual features with registered distractors."
)
AMBIGUITY = (
    "COMPETITOR AMBIGUITY: Competitor similarity (%s) is very close to positive "
    "campaign similarity (%s). High risk of brand confusion."
)
WEAK_CLUSTER = (
    "WEAK REFERENCE CLUSTER: The reference set exhibits high internal variance (%s). "
    "This indicates a highly diverse/lifestyle campaign, which naturally relaxes decision thresholds "
    "and increases susceptibility to competitor false alarms."
)
FEW_REFERENCES = (
    "INSUFFICIENT REFERENCES: Only %d campaign reference image(s) provided. "
    "A small sample size reduces the reliability of centroid representations."
)
LOCALIZED = (
    "LOCALIZED CORRESPONDENCE ONLY: Peak single-reference similarity is high (%s), "
    "but the overall blended score is low (%s). The match is highly specific to a single "
    "reference image, rather than cohesive with the campaign's global style."
)
UNSTABLE = (
    "TEMPORAL INSTABILITY: Detected a high-scoring transient frame (%s), "
    "but the match is not sustained over time (temporal strength: %s). "
    "This is indicative of an isolated false-positive spike."
)
STATIC = (
    "STATIC AMBIENT ALIGNMENT: All video frames have almost identical mid-range similarity. "
    "This usually points to background scene color overlap rather than a true visual campaign match."
)
SOCIAL_IMAGE = "SOCIAL OPTIMIZATION: Applied +%.2f confidence boost for degraded social screenshot/UI format."
BRAND_IMAGE = "BRANDING BOOST: Applied +%.2f brand focus boost with low competitor overlap."
SOCIAL_VIDEO = "SOCIAL OPTIMIZATION: Applied +%.2f sequence-level confidence adjustment for vertical/UI format."
BRAND_VIDEO = "BRANDING BOOST: Applied +%.2f sequence-level product-centric focus boost."
CLEAR_REASON = "Match is clear and consistent."
STEP_BANK = "Reference bank loaded with %d campaign positive images. Intra-set centroid matching active."
STEP_CLUSTER = "Category-aware matching: Query mapped to reference cluster '%s' with %.4f centroid similarity."
STEP_VIDEO = (
    "Video input: sampled and generated SigLIP embeddings for %d frames. "
    "Suppressed visual duplicates and motion-blurred frames."
)
STEP_IMAGE = "Single image input: generated L2-normalized 768-dim SigLIP vision embedding."
STEP_BEST = "Highest similarity found with campaign positive '%s' (max similarity: %.4f)."
STEP_CONFLICT = (
    "WARNING: High brand conflict detected! Nearest competitor '%s' "
    "matches query with %.4f similarity. Applied a competitor margin penalty."
)
STEP_LOW_COMPETITOR = (
    "Competitor check processed. Nearest distractor '%s' similarity score is low (%.4f). High decision boundary margin."
)
STEP_NO_COMPETITOR = "Competitor database inactive or empty. Distractor penalty bypassed."
STEP_SOCIAL = "Social format adjustment: Applied +%.2f confidence boost due to vertical screenshot layout/UI overlay."
STEP_PRODUCT = (
    "Product-centric boost: Applied +%.2f brand focus boost for dominant logo/product matching "
    "with low competitor overlap."
)
STEP_SIGMOID = (
    "Sigmoid Platt scaling calibrated raw fused visual similarity into a probability space. "
    "Calibrated Confidence: %.1f%% (Midpoint aligned with target matching thresholds)."
)
STEP_TEMPORAL = (
    "Applied sequence-level Bartlett filtering (window = 5) and suppressed isolated spike frames. "
    "Calculated temporal continuity strength: %.4f."
)
STEP_CONFIRMED = (
    "VERDICT CONFIRMED: Calibrated confidence (%.1f%%) exceeds target threshold (%.1f%%). "
    "Target matches the campaign positive references."
)
STEP_REJECTED = "VERDICT REJECTED: Calibrated confidence (%.1f%%) falls short of matching threshold (%.1f%%)."


def boost_warnings(social: Column, product: Column, video: bool) -> Column:
    """Array with up to two boost messages."""
    texts = (SOCIAL_VIDEO, BRAND_VIDEO) if video else (SOCIAL_IMAGE, BRAND_IMAGE)
    return F.array_compact(
        F.array(*[F.when(amount > 0, F.format_string(text, amount)) for text, amount in zip(texts, (social, product))])
    )


def diagnostics(
    primary: Column, best_pos: Column, best_comp: Column, ambiguity: Column, variance: Column, num_refs: Column,
    temporal_strength: Column | None = None, n_frames: Column | None = None, frame_max: Column | None = None,
    frame_mean: Column | None = None, frame_std: Column | None = None,
) -> Column:
    """Array of warnings in fixed order. The frame rules need the raw-score aggregates of a sequence."""
    rules = [
        F.when(best_comp > 0.75, F.format_string(HIGH_OVERLAP, fixed3(best_comp)))
        .when((best_comp > 0.65) & (ambiguity > 0.4), F.format_string(AMBIGUITY, fixed3(best_comp), fixed3(best_pos))),
        F.when(variance > 0.08, F.format_string(WEAK_CLUSTER, fixed3(variance)))
        .when(num_refs < 3, F.format_string(FEW_REFERENCES, num_refs)),
        F.when((best_pos > 0.85) & (primary < 0.70), F.format_string(LOCALIZED, fixed3(best_pos), fixed3(primary))),
    ]
    if temporal_strength is not None:
        many = n_frames > 1
        rules += [
            F.when(
                many & (frame_max > 0.80) & (temporal_strength < 0.65),
                F.format_string(UNSTABLE, fixed3(frame_max), fixed3(temporal_strength)),
            ),
            F.when(many & (frame_std < 0.01) & (frame_mean > 0.60) & (frame_mean < 0.75), F.lit(STATIC)),
        ]
    return F.array_compact(F.array(*rules))


def _printed(rounded: Column, raw: Column) -> Column:
    """A rounded value as it is printed: a negative one that rounds to zero keeps its sign, which Spark's rounding drops."""
    return F.when((raw < 0) & (rounded == 0), -0.0).otherwise(rounded)


def explain(df: DataFrame) -> DataFrame:
    """Adds the ``explainability`` struct.

    Expects best_reference, best_frame, temporal_strength, competitor_similarity, ambiguity_score, best_competitor,
    warnings, top_matches, confidence_raw, possible_threshold, num_frames_analyzed, n_refs, dominant_cluster,
    cluster_similarity, social_adjustment and product_boost, and the unrounded max_similarity and best_cluster_centroid_sim.
    """
    c = F.col
    video, conf, thr = c("num_frames_analyzed") > 1, c("confidence_raw") * 100, c("possible_threshold") * 100
    top = _printed(F.coalesce(F.get("top_matches", F.lit(0))["similarity"], F.lit(0.0)), c("max_similarity"))
    cluster = _printed(c("cluster_similarity"), c("best_cluster_centroid_sim"))
    rival = (c("best_competitor") != "") & (c("competitor_similarity") > 0)
    steps = F.array_compact(
        F.array(
            F.format_string(STEP_BANK, "n_refs"),
            F.when(c("dominant_cluster") != "", F.format_string(STEP_CLUSTER, c("dominant_cluster"), cluster)),
            F.when(video, F.format_string(STEP_VIDEO, "num_frames_analyzed")).otherwise(STEP_IMAGE),
            F.when(c("best_reference") != "", F.format_string(STEP_BEST, c("best_reference"), top)),
            F.when(
                rival & (c("competitor_similarity") > 0.70),
                F.format_string(STEP_CONFLICT, "best_competitor", "competitor_similarity"),
            )
            .when(rival, F.format_string(STEP_LOW_COMPETITOR, "best_competitor", "competitor_similarity"))
            .otherwise(STEP_NO_COMPETITOR),
            F.when(c("social_adjustment") > 0, F.format_string(STEP_SOCIAL, "social_adjustment")),
            F.when(c("product_boost") > 0, F.format_string(STEP_PRODUCT, "product_boost")),
            F.format_string(STEP_SIGMOID, conf),
            F.when(video, F.format_string(STEP_TEMPORAL, "temporal_strength")),
            F.when(c("confidence_raw") >= c("possible_threshold"), F.format_string(STEP_CONFIRMED, conf, thr))
            .otherwise(F.format_string(STEP_REJECTED, conf, thr)),
        )
    )
    block = F.struct(
        "best_reference", "best_frame", r4(c("temporal_strength")).alias("temporal_strength"),
        r4(c("competitor_similarity")).alias("competitor_overlap"), "best_competitor",
        r4(c("ambiguity_score")).alias("ambiguity_score"),
        F.coalesce(F.get("warnings", F.lit(0)), F.lit(CLEAR_REASON)).alias("ambiguity_reason"),
        "warnings", c("top_matches").alias("top_positive_matches"), steps.alias("reasoning_steps"),
        "dominant_cluster", r4(c("cluster_similarity")).alias("cluster_similarity"),
        r4(c("social_adjustment")).alias("social_adjustment"), r4(c("product_boost")).alias("product_boost"),
    )
    return df.withColumn("explainability", block)


#: Columns of a result that the archive reads.
ARCHIVED = (
    "filename", "primary_score", "competitor_similarity", "ambiguity_score", "verdict", "possible_threshold", "warnings", "embedding",
)


def failure_cases(results: DataFrame) -> DataFrame:
    """Near misses, ambiguous cases and anything with a warning, as archive records.

    Expects target name, primary_score, competitor_similarity, ambiguity_score, verdict, possible_threshold, warnings.
    """
    c = F.col
    near = F.abs(c("primary_score") - c("possible_threshold")) <= 0.05
    ambiguous = (c("competitor_similarity") >= 0.65) & (c("ambiguity_score") >= 0.40)
    flagged = results.withColumn("is_near_miss", near).withColumn("is_ambiguous", ambiguous)
    return flagged.filter(c("is_near_miss") | c("is_ambiguous") | (F.size("warnings") > 0)).withColumn(
        "clean_name", F.regexp_replace("filename", r"[^\p{L}\p{N}]", "_")
    )


def failure_records(results: DataFrame) -> DataFrame:
    """``failure_cases`` in the archive layout: metadata plus the query vector. Names repeat within a job, so the id also has
    the item's keys."""
    stamp = F.unix_millis(F.current_timestamp())
    keys = [c for c in ("target_id", "video_id", "campaign_id") if c in results.columns]
    return failure_cases(results).select(
        F.concat_ws("_", F.lit("fail"), "clean_name", *keys, stamp).alias("archive_id"),
        stamp.alias("timestamp"), "filename", r4(F.col("primary_score")).alias("similarity_score"),
        r4(F.col("competitor_similarity")).alias("competitor_similarity"), r4(F.col("ambiguity_score")).alias("ambiguity_score"),
        "verdict", r4(F.col("possible_threshold")).alias("threshold_used"), "is_near_miss", "is_ambiguous", "warnings", "embedding",
    )


def write_failure_cases(results: DataFrame, path: str, fmt: str = "parquet") -> None:
    failure_records(results).write.mode("append").partitionBy("verdict").format(fmt).save(path)
