from lumenmatch.llm import rules
from lumenmatch.llm.queries import op4_quality_rules


def test_counts():
    text = "a b c d e f g h i a b c d e f g h z\nx  y\n\nx  y\n #| "
    n_words, chars, symbols, dup, repeat = rules.stats_of(text)[:5]
    assert (n_words, chars, symbols, dup, repeat) == (23, 24, 2, 1, 16)
    assert rules.stats_of(None) == rules.stats_of("") == (0,) * 9
    assert rules.stats_of("a b c d")[:2] == (2, 6)
    assert rules.stats_of("w " * 12)[4] == 12


def test_rules_learn_kinds_of_junk():
    good = (rules.GOOD, 0, 0, 0)
    patterns = [(good, 9000), ((rules.GOOD, rules.BAD, 0, 0), 300), ((rules.GOOD, 0, rules.BAD, 0), 300), ((0, 0, 0, rules.BAD), 200), ((0, 0, 0, 0), 100)]
    share, rates = rules.fit_accuracies(patterns)
    assert 0.6 < share < 0.99
    assert rules.posterior(good, share, rates) > 0.5
    for junk, _ in patterns[1:4]:
        assert rules.posterior(junk, share, rates) < 0.5
    assert rules.fit_accuracies([]) == (0.5, [])


def test_hostile_rows(hostile, nothing):
    got = rules.weak_quality(hostile, keep=("doc_id", "row")).collect()
    assert len(got) == hostile.count()
    assert all(r["base_failed"] and not r["kept"] for r in got)
    assert rules.weak_quality(nothing).count() == 0


def test_query_on_labels(spark):
    """Against labels that the rules never see, at the next size."""
    d = "/root/testdata/sf0.01"
    both = op4_quality_rules(spark, d).drop("quality").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    clean = [r["kept"] for r in both if r["quality"] == 1]
    junk = [r["kept"] for r in both if r["quality"] == 0]
    assert sum(clean) > 0.97 * len(clean) and sum(junk) < 0.2 * len(junk)
