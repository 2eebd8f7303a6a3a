"""Words and their deletions are never the broadcast side of a join, however few bytes they are made of."""

import itertools
import re

import duckdb
import pytest

from lumenmatch import catalog
from lumenmatch.operators import similarity, terms as tm
from lumenmatch.oracle import ORACLE

WORDS = ["".join(w) + "xyz" for w in itertools.product("abc", repeat=4)]


def joins(df, key):
    """Kind and built side of the joins on ``key``, before any is run."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(rf"(\w+Join) \[{key}#\d+\], \[{key}#\d+\], Inner(?:, (\w+))?", plan)


@pytest.mark.parametrize("limit, kind", [(similarity.BROADCAST_BYTES, ("BroadcastHashJoin", "BuildRight")), (0, ("SortMergeJoin", ""))])
def test_terms_are_broadcast_if_few_and_words_never(spark, monkeypatch, tmp_path, limit, kind):
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", limit)
    spark.createDataFrame([(w,) for w in WORDS], "word string").write.parquet(f"{tmp_path}/words")
    spark.createDataFrame([(k, " ".join(WORDS[k : k + 9])) for k in range(60)], "id long, text string").write.parquet(f"{tmp_path}/docs")
    terms = [*WORDS[::7], "no such term", f"{WORDS[0]} {WORDS[1]}"]
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    near = set(duckdb.execute("SELECT w, t FROM (SELECT unnest(?) AS w), (SELECT unnest(?) AS t) WHERE levenshtein(w, t) <= 2", [WORDS, terms]).fetchall())

    close = tm.close_words(spark.read.parquet(f"{tmp_path}/words"), table.withColumnRenamed("term", "norm"))
    assert joins(close, "variant") == [kind]
    assert {tuple(r) for r in close.collect()} == near

    found = tm.find_terms(spark.read.parquet(f"{tmp_path}/docs"), ["id"], "text", table)
    assert joins(found, "word") == [kind]
    texts = {k: WORDS[k : k + 9] for k in range(60)}
    rule = {(k, t): t in " ".join(own) for k, own in texts.items() for t in terms if t in " ".join(own) or any((w, t) in near for w in own)}
    assert {(r["id"], r["term"]): r["exact"] for r in found.collect()} == rule


def test_large_tables_of_terms_by_shuffle_give_the_rows_of_the_sql(spark, monkeypatch, sf):
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", 0)
    db = duckdb.connect()
    for name in ("conversations", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    out = catalog.ocr_term_table(spark, sf)
    want = db.execute(f"SELECT {', '.join(out.columns)} FROM ({ORACLE['ocr_term_table']})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want)
