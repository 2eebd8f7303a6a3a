import random
import re

import numpy as np

from lumenmatch.llm import minmax
from lumenmatch.llm.queries import op5_minhash


def brute(rows):
    """(doc_id, n_shingles, component_id) of rows with ids."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets, owner = [], {}
    for i, t in rows:
        w = re.findall("[^ \t-\r]+", (t or "").translate(lower))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            owner[find(k)] = min(owner.get(find(k), i), i)
    return sorted(((i, len(s), i if not s else owner.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def found(df):
    return sorted(((r["row"]["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def test_hostile_rows(hostile, nothing):
    rows = [(r["doc_id"], r["text"]) for r in hostile.select("doc_id", "text").collect()]
    got = minmax.near_duplicates(hostile)
    assert found(got) == brute(rows)
    assert got.select("row.*").columns == hostile.columns
    assert minmax.near_duplicates(nothing).count() == 0


def test_families_without_a_common_centre(spark):
    """Copies that only link through others, and families around an origin that isn't the smallest id."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = []
    chain = [word() for _ in range(150)]
    for i in range(60):
        rows.append((1000 - i, " ".join(chain)))
        chain[(i * 7) % 150] = word()
    origin = [word() for _ in range(150)]
    for i in range(60):
        copy = list(origin)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(150)] = word()
        rows.append((i, " ".join(copy)))
    rows.append((500, " ".join(origin)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(minmax.near_duplicates(docs)) == brute(rows)


def test_signatures_hold_minimum_and_maximum():
    values, ends = np.arange(1, 50, dtype=np.uint64), np.array([0, 20, 20, 49])
    both = minmax.signatures(values, ends, 8)
    assert both.shape == (2, 16)
    alone = minmax.signatures(values[:20], np.array([0, 20]), 8)
    assert (both[0] == alone[0]).all() and (both[:, 0::2] <= both[:, 1::2]).all()


def test_query_against_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op5_minhash(spark, sf).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
