import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenmatch import datasets as d
from lumenmatch.operators import banks as bk, clusters as cl, similarity as sim

BANK = "campaign_id long, ref_id long, ref_name string, embedding array<float>"
NEG = "campaign_id long, neg_id long, neg_name string, embedding array<float>"
TARGET = "target_id long, campaign_id long, embedding array<float>"


def unit(rng, n, dim=8):
    v = rng.normal(size=(n, dim)) + 1.0
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def data(spark):
    """One large campaign (several blocks), one small, one single reference, and targets of a campaign without a bank."""
    rng = np.random.default_rng(1)
    vecs = {1: unit(rng, 300), 2: unit(rng, 5), 3: unit(rng, 1)}
    bank = [(c, i, f"ref_{c}_{i}", v.tolist()) for c, m in vecs.items() for i, v in enumerate(m)]
    negs = {1: unit(rng, 300), 2: unit(rng, 2)}
    neg = [(c, i, f"rival_{i}", v.tolist()) for c, m in negs.items() for i, v in enumerate(m)]
    t = unit(rng, 40)
    targets = [(i, i % 4 + 1, v.tolist()) for i, v in enumerate(t)]
    return vecs, negs, t, spark.createDataFrame(bank, BANK), spark.createDataFrame(neg, NEG), spark.createDataFrame(targets, TARGET)


@pytest.mark.parametrize("kernel", ["jvm", "arrow"])
def test_scores_match_numpy_across_block_merges(data, kernel):
    vecs, negs, t, bank, neg, targets = data
    packs = sim.pack_banks(bank, neg).cache()
    size = sim.measure(packs)
    assert size.max_blocks == 2
    rows = sim.target_stats(sim.score_targets(targets, packs, size, kernel)).collect()
    assert len(rows) == 40
    for row in rows:
        c = row["campaign_id"]
        if c == 4:
            assert row["n_refs"] == 0 and row["max_similarity"] == 0.0 and row["top_matches"] is None or row["top_matches"] == []
            continue
        s = vecs[c].astype(float) @ t[row["target_id"]].astype(float)
        order = sorted(range(len(s)), key=lambda i: (-s[i], i))[:5]
        assert row["n_refs"] == len(s)
        assert row["max_similarity"] == pytest.approx(s.max(), abs=1e-9)
        assert row["avg_similarity"] == pytest.approx(s.mean(), abs=1e-9)
        assert row["top_k_avg"] == pytest.approx(s[order].mean(), abs=1e-9)
        assert [m["reference_name"] for m in row["top_matches"]] == [f"ref_{c}_{i}" for i in order]
        if c in negs:
            n = np.sort(negs[c].astype(float) @ t[row["target_id"]].astype(float))[::-1]
            assert row["n_negs"] == len(n)
            assert [-h["k"] for h in row["neg_hits"]] == pytest.approx(list(n[:3]), abs=1e-9)


def test_bank_statistics_match_pairwise_numpy(data):
    vecs, negs, _, bank, neg, _ = data
    rows = {r["campaign_id"]: r for r in bk.cohesion(bank, neg).collect()}
    for c, m in vecs.items():
        e = m.astype(float)
        s = e @ e.T
        pairs = s[np.triu_indices(len(e), 1)]
        mean, std = (pairs.mean(), pairs.std()) if len(pairs) else (1.0, 0.0)
        assert rows[c]["intra_similarity_mean"] == pytest.approx(mean, abs=1e-4)
        assert rows[c]["intra_similarity_std"] == pytest.approx(std, abs=1e-4)
        if c in negs:
            b = 1 - (e @ negs[c].astype(float).T).mean(axis=1)
            a = np.array([(1 - np.delete(s[i], i)).mean() for i in range(len(e))])
            assert rows[c]["silhouette_score"] == pytest.approx(((b - a) / np.maximum(a, b)).mean(), abs=1e-4)
        centre = e.mean(axis=0) / np.linalg.norm(e.mean(axis=0))
        assert rows[c]["outliers"] == [f"ref_{c}_{i}" for i in np.flatnonzero(e @ centre < 0.68)]
    assert rows[3]["silhouette_score"] == 1.0


def test_clustering_same_distributed_and_local(data):
    bank = data[3]
    local = cl.cluster_assignments(bank, iters=3).select("campaign_id", "ref_id", "cluster_idx")
    spread = cl.cluster_assignments(bank, iters=3, per_part=2).select("campaign_id", "ref_id", "cluster_idx")
    assert local.exceptAll(spread).isEmpty() and spread.exceptAll(local).isEmpty()
    assert local.groupBy("campaign_id").agg(F.countDistinct("cluster_idx").alias("k")).orderBy("campaign_id").collect()[0]["k"] == 4


def test_all_in_first_cluster_keeps_the_seed(spark):
    rows = [(1, i, f"cup{i}", [1.0, 0.0]) for i in range(3)]
    bank = spark.createDataFrame(rows, BANK)
    out = cl.cluster_references(bank).collect()
    assert len(out) == 1 and out[0]["n_members"] == 3 and out[0]["label"] == "drink_refs"
    assert list(out[0]["centroid"]) == [1.0, 0.0]


def test_empty_bank_gives_defaults(spark):
    none = spark.createDataFrame([], BANK)
    campaigns = spark.createDataFrame([(7,)], "campaign_id long")
    row = bk.cohesion_or_empty(campaigns, bk.cohesion(none, spark.createDataFrame([], NEG))).first()
    assert row["cluster_quality"] == "WEAK" and row["recommendations"] == [bk.EMPTY_RECOMMENDATION]


def test_store_reuses_and_rebuilds(spark, sf, tmp_path):
    from lumenmatch.plans.images import match_images
    from lumenmatch.sources.bank_store import materialize_banks

    bank, neg, root = d.bank(spark, sf), d.neg_bank(spark, sf), str(tmp_path)
    first = materialize_banks(bank, neg, root)
    files = len(list((tmp_path / "stats").rglob("*.parquet")))
    again = materialize_banks(bank, neg, root)
    assert len(list((tmp_path / "stats").rglob("*.parquet"))) == files
    assert again.stats.count() == first.stats.count() == bank.select("campaign_id").distinct().count()
    stray = d.targets(spark, sf).limit(3).withColumn("campaign_id", F.lit(-1).cast("long"))
    out = match_images(stray, first).collect()
    assert len(out) == 3 and all(r["match_type"] == "NO_MATCH" and r["confidence"] == 0.0 and r["warnings"] == [] for r in out)


def test_unread_builds_are_removed(spark, tmp_path):
    from lumenmatch.sources.bank_store import bank_builds, materialize_banks, remove_unread

    rng = np.random.default_rng(4)
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    refs = [(c, i, f"cup{i}", unit(rng.normal(size=4))) for c in (1, 2) for i in range(4)]
    negs = [(1, 0, "rival", unit(rng.normal(size=4)))]
    bank, neg, root = spark.createDataFrame(refs, BANK), spark.createDataFrame(negs, NEG), str(tmp_path)
    materialize_banks(bank, neg, root)
    changed = bank.filter("campaign_id = 1 or ref_id < 3")
    materialize_banks(changed, neg, root)
    assert {r["campaign_id"]: (r["builds"], r["n_refs"]) for r in bank_builds(spark, root).collect()} == {1: (1, 4), 2: (2, 3)}
    assert remove_unread(spark, root) == []  # the first build still is campaign 1's, and the old content of 2
    forced = materialize_banks(bank, neg, root, force=True)
    (tmp_path / "packs" / "build=bdied").mkdir()
    assert len(remove_unread(spark, root)) == 1 and (tmp_path / "packs" / "build=bdied").exists()
    assert remove_unread(spark, root, hours=0.0) == ["bdied"]
    assert forced.stats.count() == 2 and forced.packs.count() >= 2
    assert materialize_banks(changed, neg, root).stats.filter("campaign_id = 2").first()["n_refs"] == 3
