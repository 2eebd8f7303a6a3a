"""Key frames of whole videos: sampling, sharper neighbours, suppression of repeats, and the match over what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenmatch.operators.frames import MAX_KEPT, blur_filter, dedupe_frames, sample_interval
from lumenmatch.plans.videos import match_videos
from lumenmatch.session import staged
from lumenmatch.sources.bank_store import Banks


def replaced_frames(videos: DataFrame, features: DataFrame) -> DataFrame:
    """(video_id, frame_idx) of the pictures to look at: a blurry sampled frame gives way to its sharper neighbour.

    ``videos``: video_id, total_frames, fps; ``features``: video_id, frame_idx, blur_score.
    """
    kept = blur_filter(sample_interval(videos), features)
    return kept.select("video_id", F.col("use_idx").alias("frame_idx")).distinct()


def key_frames(pictures: DataFrame, max_kept: int = MAX_KEPT) -> DataFrame:
    """Of the pictures (video_id, frame_idx, hist, thumb) of ``replaced_frames`` those that show something new."""
    return dedupe_frames(pictures, max_kept).select("video_id", "frame_idx", "kept_order")


def match_key_frames(keyed: DataFrame, vectors: DataFrame, banks: Banks, kernel: str = "fused") -> DataFrame:
    """One result row per video and campaign from its key frames.

    ``vectors``: video_id, campaign_id, frame_idx, frame_name, embedding and media features of any frames; only key frames are
    read from it. Their numbers have gaps, which ``match_videos`` allows for. The frames of a still video have one vector up to
    rounding, so the best of them is the one that the SQL's own products put first: hence the fused kernel.
    """
    chosen = staged(vectors.join(keyed.select("video_id", "frame_idx"), ["video_id", "frame_idx"]), "keyvectors")
    return match_videos(chosen, banks, kernel)
