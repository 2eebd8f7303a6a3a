"""Statistics of reference banks: centroid, variance, pair similarity, outliers, silhouette, cohesion grade.

A bank is (campaign_id, ref_id, ref_name, embedding); a competitor bank is (campaign_id, neg_id, neg_name, embedding).
No operator here emits pairs of references: pair moments and silhouettes are computed from vector sums and bounded
matrices, so a campaign holding a third of all references costs time linear in its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lumenmatch.functions.scoring import clamp01, r4
from lumenmatch.functions.vectors import VECTOR, dot, l2_normalize, vector_sum
from lumenmatch.session import staged

KEY = "campaign_id"
PART = 4096  # references of a campaign that one task works on at a time

# Fixed values of the grading rules.
OUTLIER_BELOW = 0.68
EMPTY_RECOMMENDATION = "No positive references loaded."
EXCELLENT_TEXT = "Campaign references are highly cohesive. Decision boundaries will be narrow and robust."
GOOD_TEXT = "Campaign reference set has nominal cohesion. Solid overall visual representation."
GOOD_OUTLIER_TEXT = "Consider removing outlier image '%s' to reduce ambient background overlap."
WEAK_TEXT = "Weak reference set! The campaign images are visually disparate (lifestyle/varying styles)."
WEAK_OUTLIER_TEXT = "CRITICAL: We recommend replacing outlier images: %s."
FEW_TEXT = "Increase reference set size to 3+ images to generate a more stable campaign centroid."


def bank_sums(bank: DataFrame) -> DataFrame:
    """One row per campaign: reference count, vector sum and sums of squared norms."""
    v = bank.withColumn("_v", F.col("embedding").cast(VECTOR)).withColumn("_q", dot(F.col("_v"), F.col("_v")))
    return v.groupBy(KEY).agg(
        F.count("*").alias("n_refs"),
        vector_sum(F.col("_v")).alias("vsum"),
        F.sum("_q").alias("sum_q"),
        F.sum(F.col("_q") * F.col("_q")).alias("sum_q2"),
    )


def bank_centroid(bank: DataFrame) -> DataFrame:
    """Renormalised mean vector per campaign."""
    return bank_sums(bank).select(KEY, "n_refs", l2_normalize(F.col("vsum")).alias("centroid"))


def centroid_similarities(bank: DataFrame) -> DataFrame:
    return bank.join(bank_centroid(bank), KEY).select(
        KEY, "ref_id", "ref_name", "n_refs", dot(F.col("embedding").cast(VECTOR), F.col("centroid")).alias("similarity")
    )


def bank_variance(bank: DataFrame) -> DataFrame:
    """Population standard deviation of the similarities to the centroid."""
    return centroid_similarities(bank).groupBy(KEY).agg(
        F.count("*").alias("n_refs"), F.stddev_pop("similarity").alias("variance")
    )


def outliers(bank: DataFrame) -> DataFrame:
    """References whose similarity to the centroid is below the limit, one row each."""
    return centroid_similarities(bank).filter(F.col("similarity") < OUTLIER_BELOW)


def dealt(bank: DataFrame, sizes: DataFrame, per_part: int) -> DataFrame:
    """The references with ``n_refs``, ``part`` and ``parts``: each campaign is dealt to parts of about ``per_part`` of them, so a campaign
    that holds a third of all references is worked on by many tasks. ``sizes`` (campaign_id, n_refs) is written first, so that
    Spark may split the references of a hot campaign."""
    parts = staged(sizes.select(KEY, "n_refs", F.ceil(F.col("n_refs") / per_part).cast("int").alias("parts")), "parts")
    return bank.join(parts, KEY).withColumn("part", F.pmod(F.xxhash64("ref_id"), F.col("parts")).cast("int"))


def _squared_pair_sums(bank: DataFrame, sums: DataFrame, per_part: int) -> DataFrame:
    """Sum over all ordered pairs (i, j) of similarity squared, per campaign.

    It is the squared Frobenius norm of E^T E, E being the campaign's vectors as rows. Each part of a campaign is streamed in
    Arrow batches that add to one dim x dim matrix. If it is the whole campaign, its norm is told; else its rows are, to be
    added up over the parts. So there are dim rows a part of ``per_part`` references, none a reference.
    """
    rows = dealt(bank, sums, per_part).select(KEY, "part", "parts", F.col("embedding").cast(VECTOR).alias("e"))
    kind = bank.schema[KEY].dataType.simpleString()
    schema = f"{KEY} {kind}, p int, g array<double>, s2 double"
    target = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def told(key, gram: np.ndarray) -> pa.RecordBatch:
        campaign, _, parts = key
        if parts == 1:
            columns = [[campaign], [-1], [None], [float((gram * gram).sum())]]
        else:
            columns = [[campaign] * len(gram), list(range(len(gram))), list(gram), [None] * len(gram)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, gram = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in (KEY, "part", "parts"))))
            e = np.asarray(batch.column("e").flatten()).reshape(len(keys), -1) if keys else np.zeros((0, 0))
            starts = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                if keys[a] != key:
                    if key is not None:
                        yield told(key, gram)
                    key, gram = keys[a], np.zeros((e.shape[1], e.shape[1]))
                gram += e[a:b].T @ e[a:b]
        if key is not None:
            yield told(key, gram)

    partials = rows.repartition(KEY, "part").sortWithinPartitions(KEY, "part").mapInArrow(run, schema)
    whole = partials.filter("p < 0").select(KEY, "s2")
    merged = partials.filter("p >= 0").groupBy(KEY, "p").agg(vector_sum(F.col("g")).alias("g")).select(KEY, dot(F.col("g"), F.col("g")).alias("s2"))
    return whole.unionByName(merged).groupBy(KEY).agg(F.sum("s2").alias("sum_s2"))


def intra_similarity(bank: DataFrame, per_part: int = PART) -> DataFrame:
    """Mean and population deviation of the similarities of all unordered reference pairs; (1, 0) for one reference."""
    sums = staged(bank_sums(bank), "sums")
    pairs = F.col("n_refs") * (F.col("n_refs") - 1) / 2
    total = (dot(F.col("vsum"), F.col("vsum")) - F.col("sum_q")) / 2
    squares = (F.col("sum_s2") - F.col("sum_q2")) / 2
    moments = sums.join(_squared_pair_sums(bank, sums, per_part), KEY).select(
        KEY, "n_refs", (total / F.nullif(pairs, F.lit(0.0))).alias("mean"), (squares / F.nullif(pairs, F.lit(0.0))).alias("sq")
    )
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("sq") - F.col("mean") * F.col("mean")))
    return moments.select(
        KEY, "n_refs",
        F.coalesce("mean", F.lit(1.0)).alias("intra_similarity_mean"),
        F.coalesce(spread, F.lit(0.0)).alias("intra_similarity_std"),
    )


def _reference_profile(bank: DataFrame, neg: DataFrame) -> DataFrame:
    """Per reference: similarity to the centroid, mean distance ``a`` to the other references, ``b`` to competitors.

    The mean distance of a vector to a set needs only the set's vector sum.
    """
    sums = bank_sums(bank).select(KEY, "n_refs", "vsum", l2_normalize(F.col("vsum")).alias("centroid"))
    neg_sums = neg.groupBy(KEY).agg(F.count("*").alias("n_negs"), vector_sum(F.col("embedding").cast(VECTOR)).alias("nsum"))
    e = F.col("e")
    others = 1.0 - (dot(e, F.col("vsum")) - dot(e, e)) / (F.col("n_refs") - 1)
    return (
        bank.select(KEY, "ref_id", "ref_name", F.col("embedding").cast(VECTOR).alias("e"))
        .join(sums.join(neg_sums, KEY, "left"), KEY)
        .select(
            KEY, "ref_id", "ref_name", "n_refs", F.coalesce("n_negs", F.lit(0)).alias("n_negs"), "centroid",
            dot(e, F.col("centroid")).alias("similarity"),
            F.when(F.col("n_refs") > 1, others).otherwise(0.0).alias("a"),
            (1.0 - dot(e, F.col("nsum")) / F.col("n_negs")).alias("b"),
        )
    )


def _mean_silhouette() -> Column:
    widest = F.greatest("a", "b")
    return F.avg(F.when(F.col("n_negs") > 0, F.when(widest > 0, (F.col("b") - F.col("a")) / widest).otherwise(0.0)))


def _or_pair_scale(score: Column) -> Column:
    """Campaigns without competitors are graded by their mean pair similarity, scaled from [.5, 1] to [0, 1]."""
    return F.coalesce(score, clamp01((F.col("intra_similarity_mean") - 0.5) * 2.0))


def silhouette(bank: DataFrame, neg: DataFrame) -> DataFrame:
    """Mean silhouette of the references against the competitors."""
    graded = _reference_profile(bank, neg).groupBy(KEY).agg(F.first("n_negs").alias("n_negs"), _mean_silhouette().alias("s"))
    return intra_similarity(bank).join(graded, KEY).select(
        KEY, "n_refs", "n_negs", _or_pair_scale(F.col("s")).alias("silhouette_score")
    )


def cohesion(bank: DataFrame, neg: DataFrame) -> DataFrame:
    """Centroid, variance, grade, pair similarity, silhouette, outlier names and recommendations per campaign."""
    low = F.when(F.col("similarity") < OUTLIER_BELOW, F.struct("ref_id", "ref_name"))
    profile = _reference_profile(bank, neg).groupBy(KEY).agg(
        F.first("n_negs").alias("n_negs"), F.first("centroid").alias("centroid"),
        F.stddev_pop("similarity").alias("variance"), _mean_silhouette().alias("s"),
        F.transform(F.sort_array(F.collect_list(low)), lambda r: r["ref_name"]).alias("outliers"),
    )
    df = intra_similarity(bank).join(profile, KEY).withColumn("s", _or_pair_scale(F.col("s")))
    n_out, s = F.size("outliers"), F.col("s")
    grade = F.when((s > 0.65) & (n_out == 0), "EXCELLENT").when((s > 0.40) & (n_out <= 1), "GOOD").otherwise("WEAK")
    df = df.withColumn("cluster_quality", grade)
    g = F.col("cluster_quality")
    recommendations = F.array_compact(
        F.array(
            F.when(g == "EXCELLENT", EXCELLENT_TEXT).when(g == "GOOD", GOOD_TEXT).otherwise(WEAK_TEXT),
            F.when((g == "GOOD") & (n_out > 0), F.format_string(GOOD_OUTLIER_TEXT, F.get("outliers", F.lit(0))))
            .when((g == "WEAK") & (n_out > 0), F.format_string(WEAK_OUTLIER_TEXT, F.array_join("outliers", ", "))),
            F.when((g == "WEAK") & (F.col("n_refs") < 3), F.lit(FEW_TEXT)),
        )
    )
    return df.select(
        KEY, "n_refs", "n_negs", "centroid", "variance", "cluster_quality",
        r4(F.col("intra_similarity_mean")).alias("intra_similarity_mean"),
        r4(F.col("intra_similarity_std")).alias("intra_similarity_std"),
        r4(s).alias("silhouette_score"),
        "outliers", recommendations.alias("recommendations"),
    )


def cohesion_or_empty(campaigns: DataFrame, graded: DataFrame) -> DataFrame:
    """Left-complete ``cohesion`` for all listed campaigns; a campaign without references is WEAK."""
    return campaigns.select(KEY).distinct().join(graded, KEY, "left").select(
        KEY,
        F.coalesce("n_refs", F.lit(0)).alias("n_refs"),
        F.coalesce("n_negs", F.lit(0)).alias("n_negs"),
        F.coalesce("cluster_quality", F.lit("WEAK")).alias("cluster_quality"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("intra_similarity_mean", "intra_similarity_std", "silhouette_score")],
        F.coalesce("outliers", F.array().cast("array<string>")).alias("outliers"),
        F.coalesce("recommendations", F.array(F.lit(EMPTY_RECOMMENDATION))).alias("recommendations"),
    )
