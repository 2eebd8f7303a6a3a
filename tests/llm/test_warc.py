import hashlib
import io
import zlib

import pytest
from pyspark.sql import functions as F

from lumenmatch.llm import warc
from lumenmatch.llm.queries import op3_warc


def test_hostile_pages(spark):
    same = "<p>" + "equal payload " * 20
    rows = [(3, "http://a", same, 1), (1, None, same, 1), (2, "http://b\r\nX: y", same, 1), (1, None, same, 1), (None, "u", same, 1), (4, "u", "short", 1), (5, "u", "short", 1), (6, "u", None, 1), (7, "u", "", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["url"]) for r in warc.archive(pages).collect()), key=repr)
    n = len(same)
    assert got == sorted(
        [(1, "response", None, n, None)] * 2
        + [(3, "revisit", 1, n, "http://a"), (2, "revisit", 1, n, "http://b\r\nX: y"), (None, "revisit", 1, n, "u")]
        + [(4, "response", None, 5, "u"), (5, "response", None, 5, "u"), (6, "response", None, 0, "u"), (7, "response", None, 0, "u")],
        key=repr,
    )
    assert warc.archive(pages.limit(0)).count() == 0


@pytest.mark.parametrize("split", [50, 333, 5000, 1 << 20])
def test_every_record_has_one_owner(split):
    bodies = [b"%d " % i * 400 + b"\x1f\x8b\x08\x00" * (i % 5) for i in range(40)]
    raws = [warc.record(i, f"http://x/{i}", b, hashlib.sha256(b).hexdigest(), len(b), None) for i, b in enumerate(bodies)]
    whole = b"".join((lambda d: d.compress(r) + d.flush())(zlib.compressobj(i % 10, zlib.DEFLATED, 31)) for i, r in enumerate(raws))
    found = [m for a in range(0, len(whole), split) for m in warc.members(io.BytesIO(whole), a, min(a + split, len(whole)), len(whole))]
    assert found == raws
    assert [warc.parse(m)["payload"] for m in found] == bodies


def test_bytes_between_records_are_passed_over():
    raw = warc.record(1, None, b"x", "d", 1, None)
    packed = (lambda d: d.compress(raw) + d.flush())(zlib.compressobj(9, zlib.DEFLATED, 31))
    other = (lambda d: d.compress(b"no record") + d.flush())(zlib.compressobj(9, zlib.DEFLATED, 31))
    whole = b"junk\x1f\x8b\x08junk" + packed + other + b"\x1f\x8b" + packed[:20]
    assert list(warc.members(io.BytesIO(whole), 0, len(whole), len(whole))) == [raw]


def test_query_against_python(spark, sf):
    pages = sorted((r["page_id"], r["html"] or "") for r in spark.read.parquet(f"{sf}/pages.parquet").collect())
    first, want = {}, {}
    for i, html in pages:
        raw = html.encode()
        seen = first.setdefault(raw, i) if len(raw) >= 100 else i
        want[i] = (len(raw), hashlib.sha256(raw).hexdigest(), "response" if seen == i else "revisit", None if seen == i else seen)
    assert {r["page_id"]: tuple(r)[1:] for r in op3_warc(spark, sf).collect()} == want


def test_ranges_are_read_by_several_tasks(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    files = warc.write_warc(warc.mark_revisits(pages).coalesce(1), warc.qualified(spark, str(tmp_path)))
    read = warc.read_warc(spark, files, split=4096, per_task=2)
    ranges = sum(max(1, -(-r["bytes"] // 4096)) for r in files.collect())
    assert read.rdd.getNumPartitions() == -(-ranges // 2) > 4
    assert read.select(F.spark_partition_id()).distinct().count() > 2 and read.count() == pages.count()
