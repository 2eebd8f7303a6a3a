import random

import numpy as np

from lumenmatch.llm import phrases
from lumenmatch.llm.tokens import words


def test_words_of_copies_do_not_move(spark):
    """Only the first segment of each kind goes to the automata with its words, however many copies there are."""
    rng = random.Random(3)
    own = " ".join(f"w{rng.randrange(1 << 30)}" for _ in range(400))
    docs = spark.createDataFrame([(i, own) for i in range(30)], "doc_id long, text string").repartition(4)
    recurring, firsts = phrases.recurring_segments(docs)
    kinds = firsts.collect()
    assert len(kinds) > 20 and recurring.count() == 30 * len(kinds)
    assert all(r["id"] == 0 and r["n"] == 30 and r["alone"] and len(r["words"].split()) == r["m"] + phrases.WINDOW - 1 for r in kinds)
    found = phrases.later_occurrences(firsts, phrases.passages(firsts)).collect()
    assert len(found) == len(kinds) and all((r["low"], r["high"]) == (0, r["m"] + phrases.WINDOW - 1) and r["digest"] for r in found)
    left = phrases.remove_passages(docs).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in left) == [(i, 400, 400 if i else 0) for i in range(30)]


def test_copies_are_compared_by_their_words():
    """Where hashes agree but words don't, nothing is removed."""
    own = [b"w%d" % k for k in range(40)]
    other = [*own[:29], b"x"]
    assert phrases.left_words(own, [(10, 30, phrases.digest_of(own[10:30]))]) == own[:10] + own[30:]
    assert phrases.left_words(own, [(10, 30, phrases.digest_of(other[10:30]))]) == own
    assert phrases.left_words(own, [(0, 5, None), (3, 8, None)]) == own[8:]


def test_crowded_anchor_goes_to_layers_and_tasks(spark):
    """One anchor with many kinds of segments: its passages fill several automata, and its segments several tasks."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(1 << 30)}"
    many = [word() for _ in range(20_000)]
    raw = np.frombuffer(" ".join(many).encode(), np.uint8)
    hashes = words(raw, np.array([0, len(raw)]), phrases._SPACES, phrases._BYTES)[0]
    low = int(phrases._run_hash(hashes, np.arange(len(hashes) - phrases.GRAM + 1), phrases.GRAM).argmin())
    anchor = many[low : low + phrases.GRAM]
    around = [([word() for _ in range(14)], [word() for _ in range(14)]) for _ in range(60)]
    texts = [" ".join([*x, *anchor, *y, *[word()] * k]) for k in range(2) for x, y in around]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    _, firsts = phrases.recurring_segments(docs)
    confirmed = phrases.passages(firsts)
    windows = confirmed.selectExpr("sum(coalesce(size(offsets), 1))").first()[0]
    assert windows > 2 * phrases.CROWDED and firsts.select("anchor").distinct().count() < 10
    left = phrases.remove_passages(docs, ("doc_id",), 1, 7).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in left) == [(i, 34 * (i >= 60)) for i in range(120)]
