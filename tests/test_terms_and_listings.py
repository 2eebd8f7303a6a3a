import itertools
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lumenmatch.operators import evidence as ev, mentions as mn, reports as rp, terms as tm
from lumenmatch.sources import folders, listings


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_deletions_find_every_close_pair(spark):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(150)})
    terms = words[::5] + ["été", "a b c", "😀bc"]
    vocabulary = spark.createDataFrame([(w,) for w in words + ["eté"]], "word string")
    got = {(r["word"], r["norm"]) for r in tm.close_words(vocabulary, spark.createDataFrame([(t,) for t in terms], "norm string")).collect()}
    assert got == {(w, t) for w, t in itertools.product(words + ["eté"], terms) if len(t) >= 3 and edits(w, t) <= 2}
    variants = tm.deletions(spark.createDataFrame([("abcd",)], "w string"), "w").collect()
    assert {r["variant"] for r in variants} == {"".join(x) for n in (2, 3, 4) for x in itertools.combinations("abcd", n)} and len(variants) == 11


@pytest.mark.parametrize("block", [tm.BLOCK, 40])
def test_containment_in_one_block_and_several(spark, block):
    rng = random.Random(7)
    texts = [(i, "".join(rng.choice("ab ") for _ in range(rng.randrange(20)))) for i in range(60)] + [(99, None)]
    norms = sorted({"".join(rng.choice("ab ") for _ in range(rng.randrange(5))) for _ in range(30)})
    got = tm.contained(spark.createDataFrame(texts, "id long, t string"), "t", spark.createDataFrame([(n,) for n in norms], "norm string"), block)
    assert sorted((r["id"], r["norm"]) for r in got.collect()) == sorted((i, n) for i, t in texts if t is not None for n in norms if n in t)


def test_mentions_against_the_rule(spark):
    docs = [(1, "Fresh Starbvcks HERE"), (2, "star  bucks"), (3, None), (4, ""), (5, "ax"), (1, "starbucks"), (6, "أحمد")]
    terms = ["Starbucks", "STAR  bucks", "ox", "احمد", "", None, "  ", "starbucks"]
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {(r["doc_id"], r["term"]): r["exact"] for r in mn.brand_mentions(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id"], "text", table).collect()}
    blank = {(i, "  "): True for i in (1, 2, 4, 5, 6)}
    assert got == blank | {(1, "Starbucks"): True, (1, "starbucks"): True, (1, "STAR  bucks"): False, (2, "STAR  bucks"): True, (6, "احمد"): True}


def test_plan_does_not_grow_with_the_terms(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    size = lambda n: len(tm.find_terms(docs, ["doc_id"], "text", spark.createDataFrame([(f"term{k}",) for k in range(n)], "term string"))._jdf.queryExecution().analyzed().toString())
    assert abs(size(2) - size(2000)) < 200


def test_median_of_any_doubles(spark):
    rng = random.Random(15)
    series = {
        1: [rng.random() for _ in range(501)], 2: [0.5] * 700, 3: [0.5 + k * 2.0**-53 for k in range(200)], 4: [-1e300, 1e-320, 5e-324, 0.0, -0.0, 1e300, -5e-324],
        5: [2.0**k for k in range(-1074, 1023, 7)] + [-(2.0**k) for k in range(-1074, 1023, 11)], 6: [3.5], 7: [1.0, float.fromhex("0x1.0000000000001p0")],
        8: [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-300, 300) for _ in range(400)], 9: [float("inf") if k % 3 == 0 else 0.25 for k in range(4)],
    }
    rows = [(k, v) for k, values in series.items() for v in values] + [(1, None), (10, None), (1, float("nan"))]
    got = {r["seq_id"]: r["median"] for r in rp.exact_median(spark.createDataFrame(rows, "seq_id long, score double").repartition(5)).collect()}
    assert got == {k: statistics.median(v) for k, v in series.items()}


def test_boxes_are_listed(spark):
    rows = [(1, 2, "cup", 0.5), (1, 1, "mug", 0.9), (1, 3, "brand logo", 0.9), (2, 1, "brand logo", 0.9), (2, 2, "cup", 0.2), (3, 1, "cup", 0.1)] + [(4, k, "cup", 0.4) for k in range(305)]
    boxes = spark.createDataFrame(rows, "item_id long, event_id long, cls string, conf double")
    got = {r["item_id"]: (r["score"], r["fired"], r["evidence"]) for r in ev.detection_layer(boxes, spark.range(1, 6).withColumnRenamed("id", "item_id")).collect()}
    assert got[1] == (1.0, True, "Brand detected with high confidence: [('mug', 0.9), ('cup', 0.5)]")
    assert got[2] == (0.3, False, "Only generic or low-confidence objects: [('brand logo', 0.9), ('cup (low-conf)', 0.2)]")
    assert got[3] == got[5] == (0.0, False, "No relevant objects detected.")
    assert got[4][2].count("('cup', 0.4)") == 300 and got[4][2].endswith("] and 5 more")


def test_folders_are_walked_in_tasks(spark, tmp_path):
    for name in ("a.jpg", "c1/refs/x.PNG", "c1/refs/deep/er/y.jpg", "c2/z.webp", "c2/.hidden", "c2/refs/_tmp"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * len(name))
    want = {f"file:{p}": os.path.getsize(p) for p in tmp_path.rglob("*") if p.is_file() and p.name[0] not in "._"}
    for depth in (0, 1, 2, 9):
        listing = folders.list_files(spark, str(tmp_path), depth)
        assert {r["path"]: r["length"] for r in listing.collect()} == want
    assert folders.list_files(spark, str(tmp_path)).rdd.getNumPartitions() > 3
    old = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select("path", "length", F.col("modificationTime").cast("long").alias("m"))
    new = folders.list_files(spark, f"file://{tmp_path}").select("path", "length", F.col("modified").cast("long").alias("m"))
    assert sorted(map(tuple, old.collect())) == sorted(map(tuple, new.collect()))
    assert listings.list_media(spark, str(tmp_path)).count() == 4
