"""Campaign run: route targets to the image or video plan and bring the results together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenmatch.functions.paths import media_type
from lumenmatch.operators.banks import KEY
from lumenmatch.plans.images import match_images
from lumenmatch.plans.videos import match_videos
from lumenmatch.sources.bank_store import Banks

RESULT = [
    KEY, "file", "filename", "campaign_match", "match_type", "verdict", "confidence", "confidence_pct", "top_similarity",
    "average_similarity", "best_reference", "best_frame", "num_references", "num_frames_analyzed", "threshold_used",
    "temporal_strength", "competitor_similarity", "ambiguity_score", "warnings", "social_adjustment",
]
SOURCE = ("username", "source_url", "error")
CONTEXT = (
    "is_social_media", "aspect_ratio", "has_overlays", "is_mobile_screenshot", "has_subtitles", "compression_level", "reasoning",
)


def _context(video: bool):
    m = F.col("media_context")
    missing = ("is_mobile_screenshot", "has_subtitles") if video else ()
    return F.struct(*[(F.lit(False) if n in missing else m[n]).alias(n) for n in CONTEXT])


def _source(df: DataFrame) -> DataFrame:
    """Adds the columns of ``SOURCE`` that a target table lacks."""
    return df.withColumns({c: F.lit(None).cast("string") for c in SOURCE if c not in df.columns})


def campaign_results(
    targets: DataFrame, frames: DataFrame, banks: Banks, kernel: str = "jvm", failures: DataFrame | None = None, step: int | None = None
) -> DataFrame:
    """Result rows of images, videos and failed fetches. ``targets`` has path, campaign, features, (for images) the vector and,
    if fetched, username and source_url; ``frames`` belongs to the video targets by video_id = target_id; ``failures`` are rows
    of ``attach_fetch_errors`` with their campaign. A video without frames and a failed fetch are NO_MATCH rows. ``step`` as in ``video_evidence``."""
    targets = _source(targets)
    kind = media_type(F.col("filename"))
    images = match_images(targets.filter(kind != "video"), banks, kernel).withColumn("file", F.col("filename"))
    # the analytics read the adjustment from the explanation, where videos keep it
    images = images.select(*RESULT, *SOURCE, _context(video=False).alias("media_context"))
    videos = targets.filter(kind == "video").select(F.col("target_id").alias("video_id"), KEY, F.col("filename").alias("_file"), *SOURCE)
    matched = match_videos(frames, banks, kernel, step).withColumn("social_adjustment", F.col("explainability.social_adjustment"))
    joined = videos.join(matched.drop("filename"), ["video_id", KEY], "left").withColumn("file", F.col("_file")).withColumn("filename", F.col("_file"))
    empty = joined["match_type"].isNull()
    defaults = {
        "campaign_match": F.lit(False), "match_type": F.lit("NO_MATCH"), "verdict": F.lit("Irrelevant"),
        "warnings": F.array().cast("array<string>"), "best_reference": F.lit(""), "best_frame": F.lit(""),
    }
    filled = []
    for name in RESULT:
        if name in (KEY, "file", "filename"):
            filled.append(F.col(name))
        else:
            zero = defaults.get(name, F.lit(0).cast(joined.schema[name].dataType))
            filled.append(F.coalesce(F.col(name), zero).alias(name))
    context = F.when(~empty, _context(video=True)).alias("media_context")
    out = images.unionByName(joined.select(*filled, *SOURCE, context))
    if failures is None:
        return out
    have = set(failures.columns)
    rows = [F.col(n) if n in have else defaults.get(n, F.lit(0).cast(out.schema[n].dataType)).alias(n) for n in RESULT]
    return out.unionByName(_source(failures).select(*rows, *SOURCE, F.lit(None).cast(out.schema["media_context"].dataType).alias("media_context")))
