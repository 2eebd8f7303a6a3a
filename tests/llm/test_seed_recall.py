import random

import numpy as np

from lumenmatch.llm import seeds


def every_alignment(own, its):
    """12 equal words or three quarters of a shorter item in a stretch of which at most a quarter differs, at any shift."""
    need = min(12, -(-3 * len(its) // 4))
    for shift in range(-len(its) + 1, len(own)):
        a, b = max(0, -shift), min(len(its), len(own) - shift)
        equal = [own[k + shift] == its[k] for k in range(a, b)]
        if sum(equal) >= need and any(sum(equal[x:y]) >= need and 4 * sum(equal[x:y]) >= 3 * (y - x) for x in range(len(equal)) for y in range(x + need, len(equal) + 1)):
            return True
    return False


def cases():
    """Items of 2 to 40 words with up to a quarter of the words replaced at random, whole or cut."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    for n in [*range(2, 25), 30, 40]:
        for changed in range(n // 4 + 2):
            for cut in (0,) * 8 + (1, 2):
                item = [word() for _ in range(n)]
                gone = set(rng.sample(range(n), changed))
                copy = [word() if k in gone else w for k, w in enumerate(item)][cut:]
                yield item, [word() for _ in range(rng.randrange(4))] + copy + [word() for _ in range(rng.randrange(4))]


def search(index, text):
    raw = " ".join(text).encode()
    return bool(index.overlaps(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])


def test_short_and_substituted_items_against_every_alignment():
    all_cases = list(cases())
    want = [every_alignment(text, item) for item, text in all_cases]
    got = [search(seeds.Index([(1, " ".join(item))]), text) for item, text in all_cases]
    assert got == want and 0.4 * len(want) < sum(want) < len(want)


def test_hits_in_small_parts(monkeypatch):
    """However few hits are looked at together, and for words that repeat, the same is found."""
    items = [(1, "a b " * 6), (2, "b " * 9), (3, "c a b a b d e f g h")]
    raw = ("a b " * 40 + "x " + "b " * 30 + "c a b a b d e f g z").encode()
    find = lambda: seeds.Index(items).overlaps(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    whole = find()
    assert [m[0] for m in whole[0]] == [1, 2, 3]
    monkeypatch.setattr(seeds, "HITS", 3)
    monkeypatch.setattr(seeds, "ALONG", 5)
    assert find() == whole
