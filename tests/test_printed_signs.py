"""Similarities just below zero are printed with their sign, as the SQL prints them."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from lumenmatch import catalog
from lumenmatch.oracle import ORACLE


def test_explained_similarities_just_below_zero(spark, sf, tmp_path):
    rows = pq.read_table(f"{sf}/embeddings.parquet").sort_by("vec_id").slice(0, 50)
    e = np.array(rows["embedding"].to_pylist(), dtype=float)
    refs = e[0] + 0.3 * e[1:13]
    refs /= np.linalg.norm(refs, axis=1)[:, None]
    # slots whose target is its own vector: near to no reference, or to one alone
    for slot, far in ((21, -1e-5), (24, -0.2)):
        e[slot] = np.linalg.lstsq(refs, np.array([-1e-5] + [far] * 11), rcond=None)[0]
    at = rows.column_names.index("embedding")
    pq.write_table(rows.set_column(at, "embedding", pa.array(e.astype("float32").tolist(), rows["embedding"].type)), tmp_path / "embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = sorted(map(tuple, catalog.explain(spark, str(tmp_path)).collect()))
    assert got == sorted(db.execute(f"SELECT target_id, ambiguity_reason, pos, step FROM ({ORACLE['explain']})").fetchall())
    signed = {(r[0], r[2]) for r in got if "-0.0000" in r[3]}
    assert signed == {(21, 1), (21, 3), (24, 3)}
