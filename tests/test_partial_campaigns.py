"""A last campaign of few vectors, videos unlike every reference, and missing frames; compared with the SQL."""

import os
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenmatch import catalog
from lumenmatch.operators import sequences as sq
from lumenmatch.oracle import ORACLE


@pytest.fixture(scope="module")
def partial(sf, tmp_path_factory):
    """Two whole campaigns with opposite themes, and a third one of six vectors: its only target is the third frame of a video."""
    folder = tmp_path_factory.mktemp("partial")
    for path in Path(sf).iterdir():
        if path.name != "embeddings.parquet":
            os.symlink(path, folder / path.name)
    rows = pq.read_table(f"{sf}/embeddings.parquet").sort_by("vec_id").slice(0, 106)
    vectors = rows["embedding"].to_pylist()
    vectors[50] = [-x for x in vectors[0]]
    at = rows.column_names.index("embedding")
    pq.write_table(rows.set_column(at, "embedding", pa.array(vectors, rows["embedding"].type)), folder / "embeddings.parquet")
    return str(folder)


def both(spark, folder, name):
    """Rows of a query and of its SQL, as texts."""
    db = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    out = catalog.QUERIES[name](spark, folder)
    got = sorted(str(tuple(r)) for r in out.collect())
    names = ", ".join(f'"{c}"' for c in out.columns)
    return got, sorted(str(r) for r in db.execute(f"SELECT {names} FROM ({ORACLE[name]})").fetchall())


def test_videos_unlike_every_reference(spark, partial):
    got, expected = both(spark, partial, "shared_videos")
    assert got == expected and any(", -0." in r for r in got)


def test_segments_by_frame_numbers(spark, partial):
    got, expected = both(spark, partial, "video_segments")
    assert got == expected and any(r.startswith("(202, 2, 2, 1, ") for r in got)


@pytest.mark.parametrize("name", ["campaign_results", "campaign_report", "campaign_analytics"])
def test_videos_without_their_first_frame(spark, partial, name):
    got, expected = both(spark, partial, name)
    assert got == expected


@pytest.mark.parametrize("chunk", [2, 3, 7, 100])
def test_missing_numbers_end_runs(spark, chunk):
    numbers = [3, 4, 5, 8, 9, 10, 11, 40, 41, 44]
    df = spark.createDataFrame([(1, i, 0.2 if i == 41 else 0.9) for i in numbers], "seq_id long, idx long, score double")
    runs = sq.stable_segments(df, F.lit(0.5), chunk=chunk, at="idx").collect()
    assert sorted((r["start_frame"], r["end_frame"], r["duration_frames"]) for r in runs) == [(3, 5, 3), (8, 11, 4), (40, 40, 1), (44, 44, 1)]
    r = sq.continuity(df, F.lit(0.5), chunk=chunk, at="idx").first()
    assert (r["n"], r["longest_streak"]) == (10, 4)
