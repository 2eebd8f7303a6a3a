from pyspark.sql import functions as F

from lumenmatch.llm import compression
from lumenmatch.llm.queries import op9_compression_quality


def test_hostile_rows(spark, hostile, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 1), (5, 0), (7, 1), (8, None), (9, 0), (9, 1), (None, 1)], "doc_id long, quality int")
    model = compression.fit(hostile, labels, F.lit(True))
    got = compression.score_texts(hostile, model, keep=("doc_id", "text")).collect()
    assert len(got) == hostile.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert compression.score_texts(nothing, model).count() == 0
    blank = compression.fit(nothing, labels.limit(0), F.lit(True))
    assert {r["score"] for r in compression.score_texts(hostile, blank).collect()} == {0.5}


def test_the_line_is_calibrated():
    points = [(x / 100, label, 1.0) for x in range(-50, 51) for label in (0, 1) for _ in range(1 + 9 * ((x > 0) == label))]
    slope, shift = compression.fit_line(points)
    assert slope > 3 and abs(shift) < 0.5


def test_held_out_rows_are_judged_right(spark):
    """On rows that no label was learnt from, at a size with enough labels."""
    d = "/root/testdata/sf0.1"
    got = op9_compression_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in got) / len(got)
    good, bad = ([r["score"] for r in got if r["quality"] == q] for q in (1, 0))
    above = sum(sum(b < g for b in bad) for g in good[:200]) / (len(bad) * 200)
    assert right > 0.95 and above > 0.97


def test_labels_of_held_out_rows_are_not_learnt(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(compression.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    learn = ~compression.held_out(F.col("doc_id"))
    a, b = compression.fit(docs, labels, learn), compression.fit(docs, flipped, learn)
    assert a.__getstate__() == b.__getstate__()
