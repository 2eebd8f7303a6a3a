import random
import struct

import xxhash
from pyspark.sql import functions as F

from lumenmatch.llm import linechunks


def spark_hash(values):
    """Spark's xxhash64 of strings and longs."""
    seed = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<q", v)
            seed = xxhash.xxh64_intdigest(raw, seed % (1 << 64))
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def chunks(text):
    """(start, lines) of the chunks of a text, by the rule of local minima."""
    lines = (text or "").split("\n")
    hashes = [spark_hash([x]) for x in lines]
    rolled = [spark_hash([h, hashes[i - 1] if i else None]) for i, h in enumerate(hashes)]
    out, own = [], []
    for i, line in enumerate(lines):
        own.append(line)
        if i == len(lines) - 1 or (i and rolled[i] < rolled[i - 1] and rolled[i] < rolled[i + 1]):
            out.append((i + 1 - len(own), own))
            own = []
    return out


def found(df):
    return sorted(((r["doc_id"], r["text"], r["removed_lines"], r["removed_chunks"]) for r in df.collect()), key=repr)


def told(df):
    return sorted(([(c["start"], c["chunk"].split("\n")) for c in r["chunks"]] for r in linechunks.line_chunks(df).collect()), key=repr)


def test_boundaries(spark, hostile, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (hostile, docs):
        assert told(df) == sorted((chunks(r["text"]) for r in df.collect()), key=repr)
    many = [c for r in docs.collect() for c in chunks(r["text"])[:-1]]
    assert min(len(c) for _, c in many) >= 2 and 2.5 < sum(len(c) for _, c in many) / len(many) < 3.5


def test_chunks_make_up_the_text(hostile):
    rows = linechunks.line_chunks(hostile).select(F.array_join(F.transform("chunks", lambda c: c["chunk"]), "\n").alias("t")).collect()
    assert sorted(r["t"] for r in rows) == sorted(r["text"] or "" for r in hostile.collect())


def test_boundaries_resist_shifts(spark):
    """Chunks inside a passage are the same wherever it stands, but for those at its borders."""
    rng = random.Random(2)
    line = lambda: " ".join(str(rng.randrange(1000)) for _ in range(4))
    passage = [line() for _ in range(40)]
    rows = [(i, "\n".join([line() for _ in range(i)] + passage + [line()])) for i in range(12)]
    inner = []
    for r in linechunks.line_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        at = r["doc_id"]
        ends = {c["start"] + c["n_lines"] - at for c in r["chunks"]}
        inner.append({e for e in ends if 3 <= e < 40})
    assert all(x == inner[0] for x in inner) and len(inner[0]) > 8


def test_candidates_are_compared_by_bytes(spark, monkeypatch):
    """Spans whose hashes agree but whose bytes differ are kept."""
    docs = spark.createDataFrame([(1, "a\nb"), (2, "a\nb"), (3, "c\nd")], "doc_id long, text string")
    real = linechunks.candidate_spans

    def collide(df):
        return real(df).drop("hash").unionByName(df.filter("doc_id = 3").select("doc_id", F.xxhash64("text").alias("text_hash"), F.lit(0).alias("start"), F.lit(2).alias("n_lines"))).withColumn("hash", F.lit(7).cast("long"))

    monkeypatch.setattr(linechunks, "candidate_spans", collide)
    assert found(linechunks.dedup_lines(docs)) == [(1, "a\nb", 0, 0), (2, "", 2, 1), (3, "c\nd", 0, 0)]


def test_chunks_take_most_of_a_passage(spark):
    """Pairs of lines are only tried where no repeated chunk stands."""
    rng = random.Random(5)
    line = lambda: " ".join(str(rng.randrange(1000)) for _ in range(4))
    passage = [line() for _ in range(60)]
    rows = [(i, "\n".join([line()] + passage + [line()])) for i in range(10)]
    spans = linechunks.candidate_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    own = [s["n_lines"] for s in spans if s["doc_id"] == 9]
    assert sum(n > 2 for n in own) > 8 and sum(n == 2 for n in own) < 40
