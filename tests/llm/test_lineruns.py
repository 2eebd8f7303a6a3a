import random
from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from test_linechunks import found, spark_hash

from lumenmatch.llm import linechunks
from lumenmatch.llm.queries import op8_line_dedup


def brute(rows):
    """What is left of each row's text, lines and stretches removed, from all pairs of neighbouring lines."""
    at = lambda i, t, k: ((i is not None, i or 0), spark_hash([t or ""]), k)
    pairs = lambda t: list(enumerate(zip((t or "").split("\n"), (t or "").split("\n")[1:])))
    places = defaultdict(list)
    for i, t in rows:
        for k, p in pairs(t):
            places[p].append(at(i, t, k))
    first = {p: min(x) for p, x in places.items()}
    out = []
    for i, t in rows:
        gone = set()
        for k, p in pairs(t):
            if first[p][:2] != at(i, t, k)[:2] or k >= first[p][2] + 2:
                gone |= {k, k + 1}
        left = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone)
        out.append((i, left if gone else t, len(gone), sum(k - 1 not in gone for k in gone)))
    return sorted(out, key=repr)


def test_two_lines_between_any_neighbours(spark):
    """Every repeated passage of two to five lines goes as a whole, and its first copy stays."""
    rng = random.Random(8)
    line = lambda: " ".join(str(rng.randrange(1000)) for _ in range(4))
    passages = [[line() for _ in range(rng.randrange(2, 6))] for _ in range(60)]
    rows = [(k, "\n".join([line() for _ in range(1 + k % 3)] + p + [line()])) for k, p in enumerate(passages + passages)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    for k, p in enumerate(passages):
        assert got[k]["text"] == rows[k][1]
        assert got[60 + k]["text"] == "\n".join(x for x in rows[60 + k][1].split("\n") if x not in p)


def test_hostile_rows(spark, hostile, nothing):
    got = linechunks.dedup_lines(hostile)
    assert found(got) == brute([(r["doc_id"], r["text"]) for r in hostile.select("doc_id", "text").collect()])
    assert got.columns == [*hostile.columns, "removed_lines", "removed_chunks"]
    assert linechunks.dedup_lines(nothing).count() == 0
    same = [(k, "\n".join("x" * k)) for k in range(1, 7)] + [(None, None), (7, "a\nb\na\nb"), (8, "p\n\n\nq"), (9, "r\n\n\n\ns")]
    docs = spark.createDataFrame(same, "doc_id long, text string").withColumn("n_chars", F.char_length("text").cast("long"))
    got = linechunks.dedup_lines(docs)
    assert found(got) == brute(same)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.collect())


def test_query_against_every_pair(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r["doc_id"], r["n_chars"], r["removed_lines"], r["removed_chunks"]) for r in op8_line_dedup(spark, sf).collect())
    assert got == sorted((i, len(t), a, b) for i, t, a, b in brute(rows))
    lines = {x for _, t in rows for x in t.split("\n")}
    left = linechunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x for r in left.collect() for x in r["text"].split("\n")} >= lines - {""}
