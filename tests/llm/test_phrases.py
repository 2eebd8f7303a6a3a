import hashlib
import random

import numpy as np
import pytest

from lumenmatch.llm import phrases


def brute(rows):
    """What is left of each (doc_id, text), in the order of documents; rows that are equal are one document."""
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    first, out = {}, {}
    for i, t in order:
        own = (t or "").encode().split()
        gone = set()
        for s in range(len(own) - 19):
            if first.setdefault(tuple(own[s : s + 20]), (i, t, s)) != (i, t, s):
                gone.update(range(s, s + 20))
        left = b" ".join(w for k, w in enumerate(own) if k not in gone)
        out[i, t] = (len(own), len(gone), left.decode(), hashlib.sha256(left).hexdigest())
    return sorted(((i, *out[i, t]) for i, t in rows), key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"], r["kept_sha256"]) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    told = []
    for k in range(30):
        own = np.concatenate([rng.integers(0, 1 << 62, 17 + k).astype(np.uint64), passage, rng.integers(0, 1 << 62, 25).astype(np.uint64)])
        text, start, m, anchor, _ = phrases.segments(own, np.array([0, len(own)]))
        assert m.sum() == len(own) - 19 and not text.any() and (start == np.cumsum(m) - m).all()
        told.append(np.repeat(anchor, m)[17 + k : 17 + k + 41].tolist())
    assert all(x == told[0] for x in told)


def test_hostile_rows(spark, hostile, nothing):
    rows = [(r["doc_id"], r["text"]) for r in hostile.collect()]
    assert found(phrases.remove_passages(hostile)) == brute(rows)
    assert phrases.remove_passages(nothing).count() == 0
    rows = [(1, " ".join("a" * 19)), (2, " ".join("a" * 20)), (3, "\t".join("a" * 21)), (4, "\n a" * 25), (None, "a " * 20), (5, "A " * 20), (6, "a\x00" + " a" * 19), (7, "a" + "\x1ca" * 22), (8, "é é " * 44)]
    assert found(phrases.remove_passages(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("each", [(phrases.PASSAGES, phrases.SEGMENTS), (3, 5)])
def test_passages_anywhere(spark, each):
    """Passages of 20 words and more between any neighbours, shards of a few passages and several tasks and layers a shard."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(3000)}"
    text = lambda n: [word() for _ in range(n)]
    shared = [text(n) for n in (20, 21, 25, 40, 90, 19)]
    rows = []
    for i in range(60):
        own = text(rng.randrange(30))
        for _ in range(rng.randrange(4)):
            own += rng.choice(shared) + text(rng.randrange(12))
        rows.append((i, rng.choice((" ", "\n", "  ")).join(own)))
    rows += [(100 + i, rows[3][1]) for i in range(40)] + [(200, " ".join(text(5) + shared[4][3:60] + ["x"] + shared[4][60:] + shared[4][10:40] * 2))]
    want = brute(rows)
    assert found(phrases.remove_passages(frame(spark, rows), ("doc_id",), *each)) == want
    assert sum(r[2] for r in want) > 1000


def test_long_text(spark):
    """A text beyond one stretch and many times the size of a batch's pieces."""
    rng = random.Random(1)
    own = [f"{rng.randrange(1 << 30):x}" for _ in range(phrases.STRETCH * 2 + 500)]
    own += own[phrases.STRETCH - 30 : phrases.STRETCH + 40]
    rows = [(1, " ".join(own)), (2, " ".join(["y", *own[phrases.STRETCH * 2 - 10 : phrases.STRETCH * 2 + 30]])), (3, "z " * 200_000)]
    assert found(phrases.remove_passages(frame(spark, rows))) == brute(rows)
