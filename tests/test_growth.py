"""Steps that must not grow faster than their input."""

from lumenmatch import datasets as d
from lumenmatch.operators import frames as fr, similarity as sim, terms as tm
from lumenmatch.session import many_tasks


def test_terms_of_an_item_are_shuffled_by_word(spark):
    """A row per word of an item is grouped, whatever the number of terms that the word holds or is close to."""
    found = spark.createDataFrame([("ab", "a", True), ("ab", "b", True), ("ab", "c", False), ("xa", "a", True), ("xa", "c", True), ("cd", "c", False)], "word string, norm string, exact boolean")
    norms = spark.createDataFrame([("a", "A", 0), ("a", "a", 0), ("b", "b", 1), ("c", "c", 2)], "norm string, term string, n long")
    words = spark.createDataFrame([(1, "ab"), (1, "xa"), (2, "cd"), (2, "ab"), (3, "zz")], "item long, word string")
    hits = words.join(tm.by_word(found, norms), "word").drop("word")
    assert hits.count() == 4
    got = tm.by_item(hits, ["item"]).join(norms, "n").select("item", "term", "exact").collect()
    exact = {(1, "A"): True, (1, "a"): True, (1, "b"): True, (1, "c"): True, (2, "A"): True, (2, "a"): True, (2, "b"): True, (2, "c"): False}
    assert {(r["item"], r["term"]): r["exact"] for r in got} == exact and len(got) == len(exact)


def test_pictures_are_made_by_many_tasks(spark, sf):
    pictures = d.frame_pictures(fr.sample_interval(d.videos(spark, sf)))
    for made in (pictures, fr.dedupe_frames(pictures)):
        assert made.rdd.getNumPartitions() >= many_tasks(spark) >= 4 * spark.sparkContext.defaultParallelism


def test_only_small_packs_pass_the_driver():
    assert sim.PackSize(3 << 20, 1).broadcastable and not sim.PackSize(5 << 20, 1).broadcastable


def test_shuffled_packs_give_the_same_scores(spark, sf):
    targets, packs = d.targets(spark, sf), sim.pack_banks(d.bank(spark, sf), d.neg_bank(spark, sf))
    size = sim.measure(packs)
    rows = lambda s: sorted(str(r) for r in sim.target_stats(sim.score_targets(targets, packs, s)).select("target_id", "max_similarity", "avg_similarity", "best_reference", "n_negs").collect())
    assert rows(size) == rows(sim.PackSize(1 << 40, size.max_blocks, size.clusters))
