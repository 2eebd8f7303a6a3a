import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenmatch.llm import seeds
from lumenmatch.llm.queries import op10_decontamination


def counts(equal, need):
    """Whether some stretch has ``need`` equal words and at most a quarter of others, from all stretches."""
    total = np.concatenate([[0], np.cumsum(equal)])
    n = len(equal)
    return any(total[b] - total[a] >= need and 4 * (total[b] - total[a]) >= 3 * (b - a) for a in range(n) for b in range(a + need, n + 1))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=24))
def test_best_stretch(equal):
    start, end, same = seeds.overlap(np.array(equal, bool))
    best = max((sum(equal[a:b]) for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if 4 * sum(equal[a:b]) >= 3 * (b - a)), default=0)
    assert same == sum(equal[start:end]) == best and 4 * same >= 3 * (end - start)


def test_substitutions_and_parts(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    item = [word() for _ in range(40)]
    noise = lambda n: [word() for _ in range(n)]
    swapped = [word() if k % 7 == 3 else w for k, w in enumerate(item)]
    rows = [
        (1, " ".join(noise(50) + item + noise(9))),
        (2, " ".join(noise(3) + swapped + noise(3)).upper()),
        (3, ", ".join(item[10:30]) + "."),
        (4, " ".join(noise(500))),
        (5, " ".join(item[:8] + noise(30))),
        (6, " ".join(noise(9) + ["tiny", "item", "of", "seven", "words", "stands", "here"] + noise(9))),
    ]
    bench = [(7, " ".join(item)), (8, "tiny item of seven words stands here"), (9, "of"), (12, "seven words"), (13, "words stands here"), (14, "item of nine words"), (None, None), (10, ""), (11, " ".join(item))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    want = {1: [7, 11], 2: [7, 11], 3: [7, 11], 4: [], 5: [], 6: [8, 12, 13, 14]}
    for block in (seeds.BLOCK, 50):  # one block and several
        got = {r["doc_id"]: r["matches"] for r in seeds.find_overlaps(docs, benchmark, block=block).collect()}
        assert {i: sorted(m["item_id"] for m in x) for i, x in got.items()} == want
        assert [(m["doc_word"], m["item_word"], m["n_words"], m["n_matched"]) for m in got[1]] == [(50, 0, 40, 40)] * 2


def test_hostile_rows(spark, hostile, nothing):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the old river"), (2, None)], "item_id long, text string")
    got = seeds.find_overlaps(hostile, bench)
    assert got.columns == [c for c in hostile.columns if c != "matches"] + ["matches"]
    assert sorted((r["doc_id"] for r in got.collect() if r["matches"])) == [1, 1, 2]
    assert seeds.find_overlaps(nothing, bench).count() == 0
    assert all(not r["matches"] for r in seeds.find_overlaps(hostile, bench.limit(0)).collect())


def contaminated(docs, benchmark):
    """The items that each text holds: all shifts of all items over all texts, instead of seeds."""
    split = lambda t: re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = {i: split(t) for i, t in benchmark.items()}
    texts = {i: split(t) for i, t in docs.items()}
    number = {w: k for k, w in enumerate(sorted({w for x in [*items.values(), *texts.values()] for w in x}))}
    want = {}
    for i, text in texts.items():
        own = np.array([number[w] for w in text])
        want[i] = []
        for k, item in items.items():
            its = np.array([number[w] for w in item])
            for shift in range(-len(its) + 1, len(own)):
                a, b = max(0, -shift), min(len(its), len(own) - shift)
                equal = own[a + shift : b + shift] == its[a:b]
                need = min(12, -(-3 * len(its) // 4))
                if len(its) > 1 and equal.sum() >= need and counts(equal, need):
                    want[i].append(k)
                    break
    return want


def test_query_against_every_alignment(spark, sf):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: sorted(r["item_ids"]) for r in op10_decontamination(spark, sf).collect()}
    assert got == {i: sorted(x) for i, x in contaminated(texts, items).items()}
