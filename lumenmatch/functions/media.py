"""Media-context rules on layout and edge features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_REASON = "Standard horizontal layout"
# Rule, offset, reason (in reporting order).
OFFSET_RULES = (
    ("vertical", -0.04, "Vertical layout detected"),
    ("mobile", -0.02, "Mobile screenshot indicators detected"),
    ("subtitles", -0.01, "Subtitle text detected"),
    ("overlay_only", -0.01, "Social UI overlay elements detected"),
    ("compressed", -0.02, "High compression artifacts present"),
)


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when(height > 0, width / height).otherwise(1.0)


def compression_level(edge_std: Column, edge_mean: Column) -> Column:
    ratio = edge_std / edge_mean
    return F.when((edge_mean > 0) & (ratio < 1.3), F.least(F.lit(1.0), (F.lit(1.3) - ratio) / 0.5)).otherwise(0.0)


def media_context(
    width: Column, height: Column, bottom: Column, top: Column, right: Column,
    status: Column, subtitle: Column, edge_std: Column, edge_mean: Column,
) -> Column:
    """Struct with layout flags, compression level, threshold offset, reasons and the social flag."""
    aspect = aspect_ratio(width, height)
    vertical = aspect < 0.80
    subtitles = subtitle > 90
    overlays = (bottom > 150) | (top > 150) | (right > 80) | subtitles
    mobile = vertical & ((status > 35) | (aspect <= 0.60))
    level = compression_level(edge_std, edge_mean)
    fired = {
        "vertical": vertical,
        "mobile": mobile,
        "subtitles": subtitles,
        "overlay_only": overlays & ~subtitles,
        "compressed": level > 0.6,
    }
    offset = F.lit(0.0)
    for rule, step, _ in OFFSET_RULES:
        offset = offset + F.when(fired[rule], F.lit(step)).otherwise(0.0)
    reasons = F.array_compact(F.array(*[F.when(fired[rule], F.lit(text)) for rule, _, text in OFFSET_RULES]))
    return F.struct(
        (vertical | overlays | mobile).alias("is_social_media"),
        F.round(aspect, 4).alias("aspect_ratio"),
        overlays.alias("has_overlays"),
        mobile.alias("is_mobile_screenshot"),
        subtitles.alias("has_subtitles"),
        F.round(level, 4).alias("compression_level"),
        F.round(F.greatest(F.lit(-0.08), F.least(F.lit(0.0), offset)), 4).alias("suggested_threshold_offset"),
        F.when(F.size(reasons) > 0, F.array_join(reasons, ", ")).otherwise(DEFAULT_REASON).alias("reasoning"),
    )
