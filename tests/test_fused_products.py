"""Vectors that only rounding tells apart are ordered as the SQL orders them."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenmatch import oracle as o
from lumenmatch.functions import vectors as v
from lumenmatch.operators import similarity as sim


@pytest.fixture(scope="module")
def still():
    """A theme, frames that are the theme up to rounding, and references."""
    rng = np.random.default_rng(5)
    theme = rng.normal(size=64)
    return theme, [(w, (theme + w * theme).tolist()) for w in rng.uniform(0.1, 3.0, 60).tolist()], rng.normal(size=(20, 64)).tolist()


def test_mixed_vectors_have_the_bits_of_the_sql(spark, still):
    theme, frames, _ = still
    rows = spark.createDataFrame([(w, theme.tolist()) for w, _ in frames], "w double, e array<double>")
    got = {r[0]: r[1] for r in rows.select("w", v.mix(F.col("e"), F.col("w"), F.col("e"))).collect()}
    for w, m in frames:
        assert got[w] == duckdb.execute(f"SELECT {o.unit('m')} FROM (SELECT ?::DOUBLE[] AS m)", [m]).fetchone()[0]


@pytest.mark.parametrize("block", [256, 8])
def test_frames_of_a_still_video_rank_as_in_the_sql(spark, monkeypatch, still, block):
    monkeypatch.setattr(sim, "BLOCK", block)
    _, frames, refs = still
    bank = spark.createDataFrame([(1, i, f"r{i}", r) for i, r in enumerate(refs)], "campaign_id long, ref_id long, ref_name string, embedding array<double>")
    unit = [(np.array(m) / np.linalg.norm(m)).tolist() for _, m in frames]
    targets = spark.createDataFrame([(i, 1, m) for i, m in enumerate(unit)], "target_id long, campaign_id long, embedding array<double>")
    for r in sim.score_targets(targets, sim.pack_banks(bank), kernel="fused").collect():
        want = [duckdb.execute(f"SELECT {o.dot('?::DOUBLE[]', '?::DOUBLE[]')}", [ref, unit[r["target_id"]]]).fetchone()[0] for ref in refs]
        assert -r["hits"][0]["k"] == max(want)


def test_missing_entries_give_no_product(spark):
    rows = spark.sql("SELECT array(1D, NULL) AS a, CAST(NULL AS array<double>) AS b, array(1D, 2D) AS c")
    assert tuple(rows.select(v.fused_dot(F.col("a"), F.col("c")), v.fused_dot(F.col("b"), F.col("c")), v.fused_dot(F.col("c"), F.col("c"))).first()) == (None, None, 5.0)
