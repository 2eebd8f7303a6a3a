import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenmatch.llm import suffixes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=40), min_size=1, max_size=5), st.integers(1, 4))
def test_suffix_arrays_of_several_texts(texts, times):
    texts = [np.array(t * times + [0]) for t in texts]
    symbols, ends = np.concatenate([[0], *texts]), np.cumsum([1, *map(len, texts)])
    got = suffixes.suffix_arrays(symbols, ends)
    for a, b in zip(ends[:-1], ends[1:]):
        assert list(got[a:b]) == sorted(range(a, b), key=lambda i: tuple(symbols[i:b]))


def brute(rows, length):
    """What remains of each text, with the removed bytes and runs."""
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(x[k : k + length] for x in raw for k in range(len(x) - length + 1))
    out = []
    for (i, _), x in zip(rows, raw):
        gone = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(x, gone) if not g)
        out.append((i, len(x), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["row"]["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=repr)


def test_hostile_rows(spark, hostile, nothing):
    rows = [(r["doc_id"], r["text"]) for r in hostile.select("doc_id", "text").collect()]
    assert found(suffixes.remove_repeats(hostile, 40, 12)) == brute(rows, 40)
    assert suffixes.remove_repeats(nothing).count() == 0


def test_passages_with_crowded_anchors(spark, monkeypatch):
    """More contexts of an anchor than a suffix array takes, near copies, and strings that only two of many texts share."""
    monkeypatch.setattr(suffixes, "LANE", 3)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(30))
    tails = [" ".join(word() for _ in range(6)) for _ in range(5)]
    rows = [(i, " ".join([word(), word(), passage, rng.choice(tails), word(), word()])) for i in range(40)]
    edited = list(" ".join(word() for _ in range(120)))
    for i in range(40, 60):
        edited[rng.randrange(len(edited))] = "#"
        rows.append((i, "".join(edited)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(suffixes.remove_repeats(docs, 60, 16)) == brute(rows, 60)


def test_kept_bytes_and_windows_of_a_lane(spark):
    again, leads = suffixes.repeated_windows([[b"x" * 5 + b"abcdefgh", b"abcdefgh"], [b"short"], [b"aaaaaaaaaaaa"]], 8)
    assert [list(map(int, a)) for a in again[0]] == [[0, 0, 0, 0, 0, 1], [1]]
    assert list(map(int, again[2][0])) == [1, 1, 1, 1, 1] and sum(leads[2][0]) == 1
