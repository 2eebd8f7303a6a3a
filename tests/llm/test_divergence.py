import random
import re
from collections import Counter, defaultdict

import numpy as np

from lumenmatch.llm import divergence


def brute(rows, least=divergence.LEAST_DOCS):
    """Rows of the audit from plain counts, in Python's integers."""
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        price = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(whole)
        for s in sources:
            pairs = [(o, sum(price(p[s][t], p[o][t]) for t in kept)) for o in sources - {s}]
            terms = [(t, price(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, x, v, k) for k, (x, v) in enumerate(found, 1) if part == "pair" or k <= 10]
    return sorted(out)


def found(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_equal_subtrees_are_one_node():
    counts = np.zeros((3, 64), np.int64)
    counts[0, 5], counts[1, 37], counts[2] = 7, 7, -1
    trees = divergence.Trees(counts)
    # the paths to a 7 in the left and in the right half differ only at the root
    assert [h.shape[1] for h in trees.halves[:-1]] == [3] * 5
    steps, left, right = trees.walk(0, 1)
    assert len(left) == 3 and max(len(a) for a, _ in steps) <= 3


def test_walk_prices_every_leaf():
    rng = random.Random(3)
    for width in (1, 2, 13, 100):
        counts = np.full((2, 1 << (width - 1).bit_length()), -1, np.int64)
        counts[:, :width] = [[rng.choice((0, 0, 0, 1, 2, 50)) for _ in range(width)] for _ in range(2)]
        total = counts.clip(0).sum(axis=1).tolist()
        p = [[1 + 10**9 * (int(c) + 2) // (n + 2 * width) for c in row[:width]] for row, n in zip(counts, total)]
        f = [(a - b) ** 2 // (a + b) for a, b in zip(*p)]
        trees = divergence.Trees(counts)
        assert divergence.price_pair(trees, 0, 1, *total, width) == sum(f)
        over = sorted((v for v, c, a, b in zip(f, counts[0], *p) if c > 0 and a > b), reverse=True)
        best = divergence.dearest_terms(trees, 0, 1, *total, width)
        assert sorted((v for _, v in best), reverse=True)[:10] == over[:10] and all(f[x] == v for x, v in best)
    huge = np.array([[1 << 60, 3]], np.int64)
    assert divergence._shares(huge[0], (1 << 60) + 3, 2).tolist() == [1 + 10**9 * (int(c) + 2) // ((1 << 60) + 7) for c in huge[0]]


def test_hostile_rows(spark, hostile, nothing):
    assert found(divergence.audit(hostile.selectExpr("text", "node lang", "row source", "n_words", "doc_id"))) == brute([(r["text"], r["node"], r["row"]) for r in hostile.collect()])
    assert found(divergence.audit(nothing.selectExpr("text", "node lang", "row source"))) == []


def test_blocks_and_tiles(spark):
    rng = random.Random(13)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["Ärger", "ärger", "naïve", "zurück", "İ", "K", "ẞ"]
    rows = []
    for i in range(500):
        weights = [1 + (k * (i % 7)) % 11 for k in range(len(words))]
        rows.append((rng.choice((" ", "-1", "\x00", "_")).join(rng.choices(words, weights, k=rng.randrange(60))).title(), ("a", "b", None)[i % 3], str(i % 7) if i % 3 else None))
    rows += [("only here " * 3, "lonely", "x"), (None, "lonely", "y"), ("A" * 3_000_000 + " b", "lonely", "x")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    want = brute(rows)
    for block, tile in ((divergence.BLOCK, divergence.TILE), (16, 2), (5, 1)):
        assert found(divergence.audit(docs, block, tile)) == want
    assert any(r[2] == "term" for r in want)


def test_partial_counts(spark):
    rows = [(" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(i, i + 300)), "en", "s") for i in range(20)]
    got = divergence.term_counts(spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)).groupBy("term").sum("n", "docs").collect()
    want, docs = Counter(), Counter()
    for text, *_ in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        want.update(terms)
        docs.update(set(terms))
    assert {r["term"]: (r[1], r[2]) for r in got if r["term"]} == {t: (n, docs[t]) for t, n in want.items()}
