"""Texts are normalised as by the plain patterns, and by many tasks whatever the file looks like."""

import re

from pyspark.sql import functions as F

from lumenmatch.functions import text as t
from lumenmatch.operators import mentions as mn, terms as tm
from lumenmatch.session import many_tasks

SPACE = "[\t-\r\x1c-\x20\x85\xa0  -     　]"
TEXTS = ["", " ", " 　\n", "a  b", "\ta b \x1c c\r\n", "a  b ", "ً a ٌ b", "أإآا x", "a​b᠎ ", "\u0085a \u0085", "x⿿y \x00 z", "a ", "\x1b a \x21"]


def test_normalisation_equals_the_plain_patterns(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, x string")
    for i, stripped, normal in rows.select("i", t.strip(F.col("x")), t.normalize_text(F.col("x"))).collect():
        plain = re.sub(f"^{SPACE}+|{SPACE}+\\Z", "", TEXTS[i])
        assert stripped == plain
        low = re.sub(f"^{SPACE}+|{SPACE}+\\Z", "", TEXTS[i].lower())
        assert normal == re.sub(f"{SPACE}+", " ", re.sub("[ً-ٟ]", "", re.sub("[أإآا]", "ا", low)))


def test_texts_of_one_file_part_are_worked_on_by_many_tasks(spark):
    rows = spark.range(400).selectExpr("id AS item_id", "id AS seq", "concat('text ', id) AS text").coalesce(1)
    n = many_tasks(spark)
    assert tm.dealt(rows, ["item_id", "seq"], "text").rdd.getNumPartitions() == n
    found = mn.caption_evidence(rows.withColumnRenamed("text", "caption"), ["text 7"])
    assert found.rdd.getNumPartitions() == n and found.filter("fired").count() == 11
