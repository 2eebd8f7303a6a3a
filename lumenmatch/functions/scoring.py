"""Scalar score arithmetic: fusion, thresholds, calibration, boosts, verdict bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring rules.
FUSION_WEIGHTS = (0.50, 0.30, 0.20)  # max similarity, cluster centroid, cluster top-3
EVALUATION_WEIGHTS = (0.40, 0.35, 0.25)  # max similarity, top-5 mean, bank centroid
SIGMOID_SCALE = 1.7346
BOOST_LABELS = ("logo_refs", "drink_refs", "product_refs", "Brand Logo & Focus", "Product & Drink Close-ups")
BOOST_LABEL_PARTS = ("Logo", "Product", "Drink")
COMPETITOR_CUTOFF = 0.65
BOOSTED_CAP = 0.98
VERDICT_BANDS = (
    (0.85, "STRONG_MATCH", True, "Relevant"),
    (0.75, "PROBABLE_STRONG_MATCH", True, "Relevant"),
    (0.65, "POSSIBLE_MATCH", True, "Uncertain"),
)
NO_MATCH = ("NO_MATCH", False, "Irrelevant")


def r4(c: Column) -> Column:
    return F.round(c, 4)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def clamp01(c: Column) -> Column:
    return clamp(c, 0.0, 1.0)


def fused_score(best: Column, cluster: Column, cluster_top: Column) -> Column:
    a, b, c = FUSION_WEIGHTS
    return best * a + cluster * b + cluster_top * c


def eval_score(best: Column, top_k: Column, centroid: Column, penalty: Column) -> Column:
    a, b, c = EVALUATION_WEIGHTS
    return F.greatest(F.lit(0.0), best * a + top_k * b + centroid * c - penalty)


def strong_threshold(variance: Column, num_refs: Column, offset: Column) -> Column:
    return _threshold(0.85, variance, num_refs, offset, 0.75, 0.92)


def possible_threshold(variance: Column, num_refs: Column, offset: Column) -> Column:
    return _threshold(0.70, variance, num_refs, offset, 0.60, 0.80)


def _threshold(base, variance, num_refs, offset, low, high) -> Column:
    spread = F.when(variance > 0.08, 0.05).when(variance > 0.05, 0.03).otherwise(0.0)
    many = F.when(num_refs >= 10, 0.02).otherwise(0.0)
    return clamp(F.lit(base) - spread + many + offset, low, high)


def calibrate(score: Column, strong: Column, possible: Column, min_possible: float = 0.40) -> Column:
    """Score to probability: .50 at the possible threshold, about .85 at the strong one, squared decay when poor."""
    gap = F.when(strong <= possible, possible + 0.15 - possible).otherwise(strong - possible)
    p = 1.0 / (1.0 + F.exp(-(SIGMOID_SCALE / F.greatest(F.lit(0.01), gap)) * (score - possible)))
    decay = F.when(score < min_possible, (score / min_possible) * (score / min_possible)).otherwise(1.0)
    return clamp01(p * decay)


def _boostable(label: Column) -> Column:
    hit = label.isin(*BOOST_LABELS)
    for part in BOOST_LABEL_PARTS:
        hit = hit | label.contains(part)
    return hit


def social_boost(best: Column, competitor: Column, is_social: Column, label: Column) -> Column:
    return (
        F.when(competitor >= COMPETITOR_CUTOFF, 0.0)
        .when(is_social & (best >= 0.78), F.when(_boostable(label), 0.08).otherwise(0.05))
        .otherwise(0.0)
    )


def product_boost(best: Column, competitor: Column, label: Column) -> Column:
    return (
        F.when(competitor >= COMPETITOR_CUTOFF, 0.0)
        .when(_boostable(label) & (best >= 0.80), F.when(best >= 0.86, 0.07).otherwise(0.05))
        .otherwise(0.0)
    )


def apply_boosts(confidence: Column, social: Column, product: Column) -> Column:
    """The cap holds only where a boost was given."""
    return F.when(
        (social > 0) | (product > 0), F.least(F.lit(BOOSTED_CAP), confidence + social + product)
    ).otherwise(confidence)


def _banded(confidence: Column, pick: int) -> Column:
    first, *rest = VERDICT_BANDS
    out = F.when(confidence >= first[0], F.lit(first[pick]))
    for band in rest:
        out = out.when(confidence >= band[0], F.lit(band[pick]))
    return out.otherwise(F.lit(NO_MATCH[pick - 1]))


def match_type(confidence: Column) -> Column:
    return _banded(confidence, 1)


def campaign_match(confidence: Column) -> Column:
    return _banded(confidence, 2)


def verdict(confidence: Column) -> Column:
    return _banded(confidence, 3)


def confidence_pct(confidence: Column) -> Column:
    return F.round(confidence * 100, 1)


def decision_margin(confidence: Column, threshold: Column) -> Column:
    return confidence - threshold


def frame_matched(smoothed: Column, threshold: Column) -> Column:
    return smoothed >= threshold
