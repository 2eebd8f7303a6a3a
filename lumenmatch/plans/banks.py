"""Bank build: everything that is computed once per campaign before targets are scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenmatch.functions.vectors import VECTOR, l2_normalize, vector_sum
from lumenmatch.operators.banks import KEY, cohesion
from lumenmatch.operators.clusters import cluster_assignments, cluster_stats
from lumenmatch.operators.similarity import pack_banks


def neg_centroid(neg: DataFrame) -> DataFrame:
    return neg.groupBy(KEY).agg(l2_normalize(vector_sum(F.col("embedding").cast(VECTOR))).alias("neg_centroid"))


def bank_members(bank: DataFrame) -> DataFrame:
    """Cluster of each reference."""
    return cluster_assignments(bank)


def bank_packs(bank: DataFrame, neg: DataFrame, members: DataFrame) -> DataFrame:
    return pack_banks(bank, neg, members)


def bank_stats(bank: DataFrame, neg: DataFrame, members: DataFrame) -> DataFrame:
    """Cohesion, clusters and competitor centroid of each campaign."""
    clusters = cluster_stats(bank, members).groupBy(KEY).agg(
        F.sort_array(F.collect_list(F.struct("cluster_idx", "label", "centroid", "variance", "avg_similarity", "n_members"))).alias("clusters")
    )
    return cohesion(bank, neg).join(clusters, KEY).join(neg_centroid(neg), KEY, "left")
