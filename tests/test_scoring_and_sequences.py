import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenmatch.functions import scoring as s
from lumenmatch.functions.text import fixed
from lumenmatch.operators import reports as rp, sequences as sq

SERIES = "seq_id long, idx long, score double"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_calibration_anchors_and_monotone(spark):
    lit = F.lit
    assert value(spark, s.calibrate(lit(0.70), lit(0.85), lit(0.70))) == pytest.approx(0.5)
    assert value(spark, s.calibrate(lit(0.85), lit(0.85), lit(0.70))) == pytest.approx(0.85, abs=1e-4)
    low = 1 / (1 + math.exp(-(1.7346 / 0.15) * (0.2 - 0.7))) * 0.25
    assert value(spark, s.calibrate(lit(0.2), lit(0.85), lit(0.70))) == pytest.approx(low)
    assert value(spark, s.calibrate(lit(0.8), lit(0.7), lit(0.8))) == pytest.approx(0.5)
    xs = [r["x"] for r in spark.range(101).select(s.calibrate(F.col("id") / 100, lit(0.85), lit(0.70)).alias("x")).collect()]
    assert xs == sorted(xs)


def test_cap_only_when_boosted(spark):
    assert value(spark, s.apply_boosts(F.lit(0.99), F.lit(0.0), F.lit(0.0))) == 0.99
    assert value(spark, s.apply_boosts(F.lit(0.97), F.lit(0.05), F.lit(0.0))) == 0.98


def test_verdict_bands(spark):
    got = [value(spark, s.match_type(F.lit(x))) for x in (0.85, 0.75, 0.65, 0.6499)]
    assert got == ["STRONG_MATCH", "PROBABLE_STRONG_MATCH", "POSSIBLE_MATCH", "NO_MATCH"]


def test_fixed_point_text_equals_printf(spark):
    xs = [0.7125, 0.7135, 0.0005, 0.4855, 0.9995, 0.12345, 1.0, 0.0, 0.6665]
    got = [r["t"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(fixed(F.col("x"), 3).alias("t")).collect()]
    assert got == ["%.3f" % x for x in xs]


def expected_sequence(raw):
    x = np.array(raw)
    n = len(x)
    sup = x.copy()
    if n >= 3:
        for i in range(n):
            left, right = x[i] - x[i - 1] if i else None, x[i] - x[i + 1] if i < n - 1 else None
            if left is None and right > 0.27:
                sup[i] = x[1] + 0.05 * right
            elif right is None and left > 0.27:
                sup[i] = x[-2] + 0.05 * left
            elif None not in (left, right) and min(left, right) > 0.18:
                mid = (x[i - 1] + x[i + 1]) / 2
                sup[i] = mid + 0.05 * (x[i] - mid)
    smo = sup.copy()
    if n >= 3:
        for i in range(n):
            js = [j for j in range(i - 2, i + 3) if 0 <= j < n]
            w = np.array([sq.KERNEL5[j - i + 2] for j in js])
            smo[i] = (sup[js] * w).sum() / w.sum()
    return sup, smo


@pytest.mark.parametrize("chunk", [4, 4096])
def test_sequence_steps_do_not_depend_on_chunks(spark, chunk):
    rng = np.random.default_rng(3)
    raw = {k: rng.uniform(size=n).tolist() for k, n in enumerate((1, 2, 3, 4, 9, 37, 64))}
    df = spark.createDataFrame([(k, i, float(x)) for k, xs in raw.items() for i, x in enumerate(xs)], SERIES)
    got = {}
    for r in sq.suppress_and_smooth(df, chunk=chunk).collect():
        got[(r["seq_id"], r["idx"])] = (r["suppressed"], r["smoothed"])
    segs = {}
    for r in sq.stable_segments(df, F.lit(0.4), chunk=chunk).collect():
        segs.setdefault(r["seq_id"], []).append((r["start_frame"], r["end_frame"], r["duration_frames"]))
    for k, xs in raw.items():
        sup, smo = expected_sequence(xs)
        for i in range(len(xs)):
            assert got[(k, i)] == pytest.approx((sup[i], smo[i]), abs=1e-12)
        runs, start = [], None
        for i, x in enumerate([*xs, -1]):
            if x >= 0.4 and start is None:
                start = i
            elif x < 0.4 and start is not None:
                runs.append((start, i - 1, i - start))
                start = None
        assert sorted(segs.get(k, [])) == runs
        assert sum(r[2] for r in runs) == sum(x >= 0.4 for x in xs)


def test_constant_series_stays_constant_and_kernels(spark):
    df = spark.createDataFrame([(1, i, 0.6) for i in range(10)], SERIES)
    assert all(r["smoothed"] == pytest.approx(0.6) for r in sq.smooth(df, 7).collect())
    row = sq.temporal_strength(sq.suppress_and_smooth(df), F.lit(0.5)).first()
    assert (row["longest_streak"], row["frame_continuity_score"], row["temporal_strength"]) == (10, 1.0, 0.72)
    with pytest.raises(ValueError):
        sq.bartlett_kernel(4)


def test_exact_median_and_distribution(spark):
    rng = np.random.default_rng(5)
    raw = {1: [0.5], 2: [0.1, 0.9], 3: rng.uniform(size=101).tolist(), 4: [0.6] * 50 + [0.61] * 50, 5: [-2.0, 0.3, 7.0, 1.01]}
    df = spark.createDataFrame([(k, float(x)) for k, xs in raw.items() for x in xs], "seq_id long, score double")
    got = {r["seq_id"]: r["median"] for r in rp.exact_median(df).collect()}
    assert got == pytest.approx({k: float(np.median(v)) for k, v in raw.items()})
    keys = spark.createDataFrame([(1,), (99,)], "seq_id long")
    rows = {r["seq_id"]: r for r in rp.score_distribution(df, keys).collect()}
    assert rows[99]["risk_profile"] == "UNKNOWN" and rows[99]["n"] == 0
    hist = {r["seq_id"]: [r[f"bin_{i}"] for i in range(5)] for r in rp.score_distribution(df).collect()}
    assert hist[5] == np.histogram(raw[5], bins=rp.HISTOGRAM_EDGES)[0].tolist()


def test_empty_analytics_and_metrics(spark):
    empty = spark.createDataFrame([], "filename string, social_adjustment double, media_context struct<is_social_media:boolean,aspect_ratio:double,has_overlays:boolean,compression_level:double,reasoning:string>")
    row = rp.social_analytics(empty).first()
    assert row["total_targets"] == 0 and row["social_ratio"] == 0.0 and row["platform_distribution"] == {}
    labels = spark.createDataFrame([(True, True), (True, False), (False, False)], "expected_match boolean, is_match boolean")
    row = rp.evaluate(labels).first()
    assert (row["tp"], row["fn"], row["fp"], row["tn"]) == (1, 1, 0, 1)
    assert row["precision"] == 1.0 and row["recall"] == 0.5 and row["f1"] == pytest.approx(2 / 3)
    assert rp.evaluate(labels.limit(0)).first()["f1"] == 0.0
