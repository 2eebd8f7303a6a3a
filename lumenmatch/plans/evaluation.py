"""Evaluation of labelled targets with the evaluation fusion and plain threshold verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenmatch.functions import scoring as s
from lumenmatch.operators.reports import evaluate
from lumenmatch.plans.images import score_vectors
from lumenmatch.sources.bank_store import Banks


def predictions(targets: DataFrame, banks: Banks, kernel: str = "jvm") -> DataFrame:
    c = F.col
    df = score_vectors(targets, banks, kernel)
    no_offset = F.lit(0.0)
    df = (
        df.withColumn("score", s.eval_score(c("max_similarity"), c("top_k_avg"), c("centroid_similarity"), c("penalty")))
        .withColumn("strong_threshold", s.strong_threshold(c("variance"), c("n_refs"), no_offset))
        .withColumn("possible_threshold", s.possible_threshold(c("variance"), c("n_refs"), no_offset))
    )
    kind = F.when(c("score") >= c("strong_threshold"), "STRONG_MATCH").when(c("score") >= c("possible_threshold"), "POSSIBLE_MATCH")
    return df.withColumn("is_match", c("score") >= c("possible_threshold")).withColumn("match_type", kind.otherwise("NO_MATCH"))


def evaluate_matching(targets: DataFrame, banks: Banks, kernel: str = "jvm") -> DataFrame:
    return evaluate(predictions(targets, banks, kernel))
