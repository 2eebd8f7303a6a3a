"""WARC archives: a deduplicating writer and a splittable reader."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmatch.llm.arrow import map_batches
from pyspark.sql import types as T
from lumenmatch.session import shared_dir

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Payloads below this size are always stored whole.
SHORTEST_REVISIT = 100
#: Bytes read at once, bytes of a range, and ranges of a reading task on average.
STEP, SPLIT, RANGES = 1 << 20, 8 << 20, 8
RECORD = "record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI of the file system that the session takes it for, so that every executor takes it for the same."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(own).toString()
    return f"file:///{uri.removeprefix('file:').lstrip('/')}" if uri.startswith("file:") else uri


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a path without scheme is local."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def mark_revisits(pages: DataFrame, shortest: int = SHORTEST_REVISIT) -> DataFrame:
    """page_id, url, payload (binary), payload_digest, payload_bytes and refers_to (null: the record is a response).

    Per payload of at least ``shortest`` bytes the smallest page_id is found with partial counts; only payloads that occur
    more than once are joined back, a join whose hot keys Spark may split.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    sized = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    firsts = (
        sized.filter(F.col("payload_bytes") >= shortest)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1 and first_id is not null")
        .select(F.col("payload_digest").alias("again"), "first_id")
    )
    return sized.join(firsts, F.col("payload_digest") == F.col("again"), "left").select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to")
    )


def record(page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One record, without compression. Line breaks in a URL are written as percent codes."""
    revisit = refers_to is not None
    block = b"" if revisit else HTTP + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(size)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        head.append(("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to} {digest}')}>"))
        head.append(("X-Refers-To-Page-ID", str(refers_to)))
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict | None:
    """Columns of a record, or None if these bytes aren't one. Digest and size of a stored payload are taken from its bytes."""
    if not raw.startswith(VERSION):
        return None
    head, _, rest = raw[len(VERSION) :].partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n") if ": " in line)
    block = rest[: int(named["Content-Length"])]
    number = lambda name: int(named[name]) if name in named else None
    url = named.get("WARC-Target-URI")
    out = {
        "record_type": named["WARC-Type"],
        "page_id": number("X-Page-ID"),
        "url": url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") if url is not None else None,
        "payload_digest": named["WARC-Payload-Digest"].removeprefix("sha256:"),
        "payload_bytes": number("X-Payload-Length"),
        "refers_to": number("X-Refers-To-Page-ID"),
        "payload": None,
    }
    if out["record_type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        out |= {"payload": payload, "payload_digest": hashlib.sha256(payload).hexdigest(), "payload_bytes": len(payload)}
    return out


def write_warc(marked: DataFrame, folder: str) -> DataFrame:
    """Writes one archive per task, a gzip member for each record, and returns the manifest (path, bytes, records).

    Every attempt has a file name of its own, and the manifest names those of the attempts that ended: files of lost
    executors are never read. Tasks without rows write nothing.
    """
    spark = marked.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, records = None, "", 0
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if out is None:
                        fs, base = filesystem(folder)
                        fs.create_dir(base, recursive=True)
                        path = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{base}/{path}", compression=None)
                    raw = record(row["page_id"], row["url"], row["payload"], row["payload_digest"], row["payload_bytes"], row["refers_to"])
                    deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
                    out.write(deflate.compress(raw) + deflate.flush())
                    records += 1
            if out is not None:
                size = out.tell()
                out.close()
                out = None
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "bytes": [size], "records": [records]})
        finally:
            if out is not None:
                out.close()

    manifest = f"{folder}-manifest"
    marked.mapInArrow(run, "path string, bytes long, records long").write.parquet(manifest)
    return spark.read.parquet(manifest)


def members(stream, start: int, end: int, size: int) -> Iterator[bytes]:
    """Records whose gzip member starts in [start, end) of a file of ``size`` bytes.

    From ``start`` on the bytes are searched for the gzip magic. A candidate counts if it inflates to a record header; after
    it the next one is due where it ended, so a magic inside compressed bytes is taken at most while searching, and then
    fails to decode. Holds one record and one step of the file at a time.
    """
    buffer, base = b"", start

    def more() -> bool:
        nonlocal buffer
        at = base + len(buffer)
        if at >= size:
            return False
        stream.seek(at)
        got = stream.read(min(STEP, size - at))
        buffer += got
        return bool(got)

    while base < end:
        at = buffer.find(MAGIC)
        if at < 0:
            drop = max(0, len(buffer) - len(MAGIC) + 1)
            buffer, base = buffer[drop:], base + drop
            if not more():
                return
            continue
        buffer, base = buffer[at:], base + at
        if base >= end:
            return
        inflate, pieces, fed, good = zlib.decompressobj(31), [], 0, True
        while not inflate.eof:
            if fed == len(buffer) and not more():
                good = False
                break
            part = buffer[fed : fed + (STEP if pieces else 4096)]
            fed += len(part)
            try:
                pieces.append(inflate.decompress(part))
            except zlib.error:
                good = False
                break
            if len(seen := b"".join(pieces[:2])) >= len(VERSION) and not seen.startswith(VERSION):
                good = False
                break
        raw = b"".join(pieces) if good else b""
        if good and raw.startswith(VERSION):
            yield raw
            used = fed - len(inflate.unused_data)
        else:
            used = 1
        buffer, base = buffer[used:], base + used


def read_warc(spark: SparkSession, files: DataFrame, split: int = SPLIT, per_task: int = RANGES) -> DataFrame:
    """Records (``RECORD``) of the archives that ``files`` (path, bytes) names, each read in byte ranges of ``split`` bytes.

    A range owns the records that start in it, so ranges need not know of each other, and a large archive is read by many
    tasks: by one for every ``per_task`` ranges. Defined cases: no files or empty files give no rows; bytes that aren't records are passed over.
    """
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))
    names = [f.name for f in T.StructType.fromDDL(RECORD)]

    def work(batch):
        for row in batch.to_pylist():
            fs, path = filesystem(row["path"])
            with fs.open_input_file(path) as stream:
                held, weight = [], 0
                for raw in members(stream, row["start"], min(row["start"] + split, row["bytes"]), row["bytes"]):
                    got = parse(raw)
                    if got is None:
                        continue
                    held.append(got)
                    weight += len(raw)
                    if weight > STEP:
                        yield {n: [r[n] for r in held] for n in names}
                        held, weight = [], 0
                if held:
                    yield {n: [r[n] for r in held] for n in names}

    # rows of ranges are tiny but stand for much work, so the number of tasks is set and not left to their size
    tasks = max(1, -(-ranges.count() // per_task))
    return map_batches(ranges.repartition(tasks, F.col("path"), F.col("start")), T.StructType.fromDDL(RECORD), work)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives in ``folder`` (default: a new one in the shared folder) and reads them back.

    Defined cases: null html is an empty payload; a null url leaves its header out; rows with the smallest page_id of a
    payload are responses, all of them if it repeats; a null page_id comes after every other and never is a first unless all
    are null (then all are responses); an empty table gives no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return read_warc(spark, write_warc(mark_revisits(pages), folder))
