"""Summaries over result rows: run summary, social analytics, score distribution, evaluation metrics, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenmatch.functions.scoring import r4

# Fixed values of the reports.
PLATFORMS = ("tiktok", "instagram", "facebook", "youtube_shorts", "generic_social", "standard_web_or_print")
POSSIBLE_TYPES = ("PROBABLE_STRONG_MATCH", "PROBABLE_MATCH", "POSSIBLE_MATCH")
HISTOGRAM_EDGES = (0.0, 0.5, 0.7, 0.8, 0.9, 1.01)
DEBUG_HEADER = (
    "campaign_match", "confidence", "match_type", "top_similarity", "average_similarity", "best_reference", "best_frame",
    "threshold_used", "reference_variance", "num_references", "num_frames_analyzed", "cohesion_metrics", "media_context",
)


def run_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of targets, matches, strong and possible matches and rejections per key."""
    t = F.col("match_type")
    return results.groupBy(*keys).agg(
        F.count("*").alias("num_targets"),
        F.count_if(F.col("campaign_match")).alias("matches"),
        F.count_if(t == "STRONG_MATCH").alias("strong_matches"),
        F.count_if(t.isin(*POSSIBLE_TYPES)).alias("possible_matches"),
        F.count_if(t == "NO_MATCH").alias("rejections"),
    )


def run_summary_with_banks(results: DataFrame, stats: DataFrame, key: str = "campaign_id") -> DataFrame:
    """``run_summary`` for every campaign that has a bank, with its reference count, variance and cohesion grade."""
    counts = ("num_targets", "matches", "strong_matches", "possible_matches", "rejections")
    bank = stats.select(
        key, F.col("n_refs").alias("num_references"), r4(F.col("variance")).alias("reference_variance"), "cluster_quality",
        "intra_similarity_mean", "intra_similarity_std", "silhouette_score",
    )
    return bank.join(run_summary(results, [key]), key, "left").fillna(0, list(counts))


def platform(filename: Column, reasoning: Column, is_social: Column) -> Column:
    """Platform by ordered keywords in the file name and the context reasons."""
    name, why = F.lower(filename), F.lower(reasoning)
    return (
        F.when(F.contains(name, F.lit("tiktok")) | F.contains(why, F.lit("tiktok")), "tiktok")
        .when(F.contains(name, F.lit("instagram")) | F.contains(why, F.lit("reels")) | F.contains(why, F.lit("instagram")), "instagram")
        .when(F.contains(name, F.lit("facebook")) | F.contains(name, F.lit("fb")), "facebook")
        .when(F.contains(name, F.lit("youtube")) | F.contains(why, F.lit("shorts")), "youtube_shorts")
        .when(is_social, "generic_social")
        .otherwise("standard_web_or_print")
    )


def social_analytics(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Ratios over all rows, averages over rows with a media context; one all-zero row for empty input without keys.

    Expects filename, media_context (struct, may be null or lack fields of image contexts) and social_adjustment.
    """
    m = F.col("media_context")
    fields = set(results.schema["media_context"].dataType.fieldNames())
    has = m.isNotNull()

    def flag(name):
        return F.coalesce(m[name], F.lit(False)) if name in fields else F.lit(False)

    kind = F.when(has, platform(F.coalesce("filename", F.lit("")), F.coalesce(m["reasoning"], F.lit("")), flag("is_social_media")))
    df = results.withColumn("_platform", kind)
    total = F.count("*")

    def ratio(cond):
        return F.coalesce(r4(F.count_if(has & cond) / F.nullif(total, F.lit(0))), F.lit(0.0))

    grouped = df.groupBy(*keys) if keys else df.groupBy()
    counts = F.map_from_arrays(
        F.array(*[F.lit(p) for p in PLATFORMS]), F.array(*[F.count_if(F.col("_platform") == p) for p in PLATFORMS])
    )
    return grouped.agg(
        total.alias("total_targets"),
        F.count_if(has & flag("is_social_media")).alias("social_targets"),
        ratio(flag("is_social_media")).alias("social_ratio"),
        ratio(F.coalesce(m["aspect_ratio"], F.lit(1.0)) < 0.8).alias("vertical_ratio"),
        ratio(flag("has_overlays")).alias("overlay_ratio"),
        ratio(flag("has_subtitles")).alias("subtitle_ratio"),
        ratio(flag("is_mobile_screenshot")).alias("mobile_screenshot_ratio"),
        F.coalesce(r4(F.avg(F.when(has, m["compression_level"]))), F.lit(0.0)).alias("average_compression"),
        F.coalesce(r4(F.avg(F.when(has, F.coalesce("social_adjustment", F.lit(0.0))))), F.lit(0.0)).alias("average_social_adjustment"),
        F.map_filter(counts, lambda k, v: v > 0).alias("platform_distribution"),
    )


def radix_digits(v: Column) -> list[Column]:
    """Digits of a double, from the most to the least significant one, that order doubles as numbers and tell all of them apart.

    The first is the sign with the power of two and six bits; three of 16 bits follow. Scaling by powers of two and taking
    whole parts are exact, and the logarithm only has to be monotonic, so no digit depends on rounding. Zeros are equal.
    """
    small, endless = F.abs(v) < 2.0**-900, F.abs(v) == float("inf")
    scaled = F.abs(v) * F.when(small, 2.0**200).otherwise(1.0)
    power = F.when(scaled == 0, 0.0).when(endless, 1024.0).otherwise(F.floor(F.log2(scaled)).cast("double"))
    # from one half to two; two factors, as 2^-power of a large power is no normal double
    half = F.floor(power / 2)
    rest = F.when(endless, 0.0).otherwise(scaled * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - power) * 64)
    first = F.when(scaled == 0, 0.0).otherwise((power - F.when(small, 200.0).otherwise(0.0) + 1200) * 256 + F.floor(rest))
    digits = [first]
    for _ in range(3):
        rest = (rest - F.floor(rest)) * 65536
        digits.append(F.floor(rest).cast("double"))
    return [(F.signum(v) * d).cast("int") for d in digits]


def exact_median(series: DataFrame, key: str = "seq_id", value: str = "score") -> DataFrame:
    """Exact median per key by radix selection: four rounds, whatever the values are.

    Each round counts the values that agree with the middle ranks so far by their next digit, with partial counts, and keeps
    the one or two bins that hold those ranks. A bin is never gathered: what a window sees of a key are at most 65,536 counts
    (of the first digit, those that occur), and all values in one bin only mean that the next round counts as many again. Null values
    and NaN are left out.
    """
    digits = [f"_d{i}" for i in range(4)]
    rows = series.select(key, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows = rows.select(key, "_v", *[d.alias(n) for n, d in zip(digits, radix_digits(F.col("_v")))])
    kept = None
    for i, digit in enumerate(digits):
        prefix = [key, *digits[:i]]
        inside = rows if kept is None else rows.join(kept, prefix)
        ranks = [] if kept is None else ["_lo", "_hi"]
        counts = inside.groupBy(*prefix, digit, *ranks).agg(F.count("*").alias("_c"), F.min("_v").alias("_value"))
        upto = Window.partitionBy(*prefix).orderBy(digit).rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("_upto", F.sum("_c").over(upto))
        if kept is None:
            total = F.sum("_c").over(Window.partitionBy(*prefix))
            counts = counts.withColumn("_lo", F.floor((total + 1) / 2)).withColumn("_hi", F.floor((total + 2) / 2))
        before = F.col("_upto") - F.col("_c")
        held = lambda rank: F.when((F.col(rank) > before) & (F.col(rank) <= F.col("_upto")), F.col(rank) - before)
        found = counts.withColumns({"_lo": held("_lo"), "_hi": held("_hi")}).filter(F.col("_lo").isNotNull() | F.col("_hi").isNotNull())
        kept = found.select(*prefix, digit, "_lo", "_hi") if i < len(digits) - 1 else found
    return kept.groupBy(key).agg(((F.max(F.when(F.col("_lo").isNotNull(), F.col("_value"))) + F.max(F.when(F.col("_hi").isNotNull(), F.col("_value")))) / 2).alias("median"))


def score_distribution(series: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Moments, median, five-bin histogram and risk label of each (seq_id, score) series.

    With ``keys`` (seq_id) every listed series gets a row; an empty one is all zero and UNKNOWN.
    """
    s = F.col("score")
    bins = []
    for i, (low, high) in enumerate(zip(HISTOGRAM_EDGES, HISTOGRAM_EDGES[1:])):
        last = i == len(HISTOGRAM_EDGES) - 2
        bins.append(F.count_if((s >= low) & ((s <= high) if last else (s < high))).alias(f"bin_{i}"))
    df = series.groupBy("seq_id").agg(
        F.count("*").alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"),
        F.skewness(s).alias("skew"), *bins,
    )
    mean, std = F.col("mean"), F.col("std")
    risk = (
        F.when((std < 0.015) & mean.between(0.58, 0.76), "HIGH_AMBIENT_OVERLAP_RISK")
        .when((F.col("max") > 0.85) & (mean < 0.50), "CLEAR_TRANSIENT_MATCH")
        .when(mean > 0.80, "SUSTAINED_STRONG_MATCH")
        .otherwise("NOMINAL_NO_MATCH")
    )
    skew = F.when((F.col("n") >= 3) & (std > 0.001), F.col("skew")).otherwise(0.0)
    out = df.join(exact_median(series), "seq_id").select(
        "seq_id", "n", *[r4(F.col(c)).alias(c) for c in ("mean", "median", "std", "min", "max")], r4(skew).alias("skewness"),
        *[f"bin_{i}" for i in range(5)], risk.alias("risk_profile"),
    )
    if keys is None:
        return out
    filled = keys.select("seq_id").distinct().join(out, "seq_id", "left")
    return filled.fillna(0, [c for c in out.columns if c not in ("seq_id", "risk_profile")]).fillna("UNKNOWN", ["risk_profile"])


def evaluate(predictions: DataFrame, expected: str = "expected_match", predicted: str = "is_match") -> DataFrame:
    """Confusion counts and zero-safe precision, recall, FPR, FNR, F1 in one row."""
    e, p = F.col(expected), F.col(predicted)
    df = predictions.agg(
        F.count_if(e & p).alias("tp"), F.count_if(e & ~p).alias("fn"), F.count_if(~e & p).alias("fp"), F.count_if(~e & ~p).alias("tn")
    )

    def share(part, *whole):
        total = sum((F.col(c) for c in whole[1:]), F.col(whole[0]))
        return F.when(total > 0, F.col(part) / total).otherwise(0.0)

    df = df.withColumn("precision", share("tp", "tp", "fp")).withColumn("recall", share("tp", "tp", "fn"))
    pr, rc = F.col("precision"), F.col("recall")
    return df.select(
        "tp", "fn", "fp", "tn", "precision", "recall", share("fp", "fp", "tn").alias("fpr"), share("fn", "tp", "fn").alias("fnr"),
        F.when(pr + rc > 0, 2 * (pr * rc) / (pr + rc)).otherwise(0.0).alias("f1"),
    )


def flatten_results(results: DataFrame) -> DataFrame:
    """Struct columns to top-level columns, arrays and maps to JSON text."""
    cols = []
    for f in results.schema.fields:
        kind = f.dataType.typeName()
        if kind == "struct":
            for g in f.dataType.fields:
                inner = F.col(f"{f.name}.{g.name}")
                cols.append((F.to_json(inner) if g.dataType.typeName() in ("struct", "array", "map") else inner).alias(f"{f.name}_{g.name}"))
        else:
            cols.append(F.to_json(f.name).alias(f.name) if kind in ("array", "map") else F.col(f.name))
    return results.select(*cols)


def result_lines(results: DataFrame, key: str = "campaign_id") -> DataFrame:
    """The results part of the report payload, one JSON document per row."""
    return results.select(key, F.to_json(F.struct(*[c for c in results.columns if c != "embedding"])).alias("result"))


def report_header(results: DataFrame, stats: DataFrame, key: str = "campaign_id") -> DataFrame:
    """Summary and social analytics of the report payload, one JSON document per campaign."""
    summary = run_summary_with_banks(results, stats, key)
    social = social_analytics(results, [key])
    return (
        summary.select(key, F.struct(*[c for c in summary.columns if c != key]).alias("summary"))
        .join(social.select(key, F.struct(*[c for c in social.columns if c != key]).alias("social_analytics")), key, "left")
        .select(key, F.to_json(F.struct("summary", "social_analytics")).alias("payload"))
    )


def write_report(results: DataFrame, stats: DataFrame, path: str, key: str = "campaign_id") -> str:
    """Report payload as two JSON sets, named by the job's id. Results stay one line each, so no campaign is gathered into one
    document; they are dealt by campaign before they are written, and a large campaign is dealt to several tasks. The headers
    are written last, in one commit: a job that died before has no headers, and nothing of it is read."""
    job = uuid.uuid4().hex
    result_lines(results, key).hint("rebalance", key).write.partitionBy(key).text(f"{path}/results/job={job}")
    report_header(results, stats, key).hint("rebalance", key).write.partitionBy(key).text(f"{path}/header/job={job}")
    return job


def read_report(spark: SparkSession, path: str, job: str) -> tuple[DataFrame, DataFrame]:
    """(key, payload) headers and (key, result) lines of a finished job."""
    headers = spark.read.text(f"{path}/header/job={job}").withColumnRenamed("value", "payload")
    return headers, spark.read.text(f"{path}/results/job={job}").withColumnRenamed("value", "result")


def debug_exports(results: DataFrame, ids: list[str]) -> dict[str, DataFrame]:
    """Header, frame scores and top matches of result rows as three tables."""
    out = {"similarity_debug": results.select(*ids, *[c for c in DEBUG_HEADER if c in results.columns])}
    if "frame_scores" in results.columns:
        out["frame_scores"] = results.select(*ids, F.explode("frame_scores").alias("f")).select(*ids, "f.*")
    out["top_matches"] = results.select(*ids, F.explode("top_matches").alias("m")).select(*ids, "m.*")
    return out


def export_debug(results: DataFrame, path: str, ids: list[str]) -> None:
    for name, table in debug_exports(results, ids).items():
        table.write.mode("append").json(f"{path}/{name}")
