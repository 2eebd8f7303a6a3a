"""Line deduplication by content-defined chunks of lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenmatch.session import discard, staged

#: Lines that the rolling hash covers.
ROLL = 2


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a transform over a one-element array binds it to a name."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


def _ends(hashes: Column) -> Column:
    """Numbers of the lines (from 1) that end a chunk.

    The rolling hash of a line and the ``ROLL - 1`` before it ends a chunk where it is smaller than that of both neighbouring
    lines, so equal runs of lines get equal ends from their ``ROLL + 1``-th line on, wherever they stand, and no chunk but
    the last one has a single line. The last line always ends a chunk.
    """
    rolled = F.transform(hashes, lambda h, i: F.xxhash64(*[F.when(i >= k, F.get(hashes, i - k)) for k in range(ROLL)]))

    def least(values: Column) -> Column:
        at = lambda i: F.get(values, i)
        return F.filter(F.sequence(F.lit(1), F.size(values)), lambda i: (i == F.size(values)) | ((i > 1) & (at(i - 1) < at(i - 2)) & (at(i - 1) < at(i))))

    return _bind(rolled, least)


def _spans(text: Column) -> Column:
    """Array of (start from 0, n_lines, hash): the chunks of a text."""

    def chunks(hashes: Column, ends: Column) -> Column:
        start = lambda i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
        return F.transform(
            ends, lambda end, i: F.struct(start(i).alias("start"), (end - start(i)).alias("n_lines"), F.xxhash64(F.slice(hashes, start(i) + 1, end - start(i))).alias("hash"))
        )

    return _bind(F.transform(_lines(text), lambda x: F.xxhash64(x)), lambda hashes: _bind(_ends(hashes), lambda ends: chunks(hashes, ends)))


def _pairs(text: Column) -> Column:
    """Array of the hashes of all two neighbouring lines."""
    return _bind(
        F.transform(_lines(text), lambda x: F.xxhash64(x)),
        lambda h: F.when(F.size(h) > 1, F.transform(F.sequence(F.lit(0), F.size(h) - 2), lambda i: F.xxhash64(F.array(F.get(h, i), F.get(h, i + 1))))),
    )


def line_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (of the row's text) and chunks: array of (start from 0, n_lines, chunk), in order; joined by line
    breaks the chunks are the text. A null text has the one chunk of an empty line."""
    chunk = lambda lines: F.transform(_spans(F.col("text")), lambda s: F.struct(s["start"], s["n_lines"], F.array_join(F.slice(lines, s["start"] + 1, s["n_lines"]), "\n").alias("chunk")))
    return docs.select("doc_id", _text_hash(), _bind(_lines(F.col("text")), chunk).alias("chunks"))


def _same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])


def candidate_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, n_lines, hash of spans of lines whose hash stands elsewhere too.

    Chunks of two lines or more come first. A repeated passage seldom begins or ends where a chunk does; so of the lines that
    no repeated chunk has taken, each two neighbouring ones are tried as well, which finds the rest of the passage line by
    line and passages too short for a chunk of their own. Only hashes and places are shuffled here, and equal hashes are
    counted with partial results.
    """
    chunks = docs.select("doc_id", _text_hash(), F.inline(_spans(F.col("text")))).filter("n_lines > 1")
    at = F.struct("doc_id", "text_hash", "start")
    firsts = staged(chunks.groupBy("hash").agg(F.count("*").alias("n"), F.min(at).alias("first")).filter("n > 1").drop("n"), "chunk-hashes", tidy=True)
    repeated = staged(chunks.join(firsts, "hash").withColumn("later", ~at.eqNullSafe(F.col("first"))).drop("first"), "chunks", tidy=True)
    taken = repeated.filter("later").select("doc_id", "text_hash", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n_lines") - 2)).alias("start"))
    pairs = docs.select("doc_id", _text_hash(), F.posexplode(_pairs(F.col("text"))).alias("start", "hash"))
    rest = staged(pairs.join(taken, _same_row(pairs, taken) & (pairs["start"] == taken["start"]), "left_anti"), "pairs", tidy=True)
    twice = staged(rest.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "pair-hashes", tidy=True)
    found = rest.join(twice, "hash", "left_semi").withColumn("n_lines", F.lit(2))
    columns = ("doc_id", "text_hash", "start", "n_lines", "hash")
    return repeated.select(*columns).unionByName(found.select(*columns))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, n_lines of spans that equal, byte for byte, an earlier one.

    Earlier: by (doc_id, text hash, start), nulls first, and without a line in common: of a line that fills three neighbouring
    ones, the first copy stays whole. Rows that are equal in doc_id and text are one document here. Candidates get their
    lines by one join with the documents and are grouped by the bytes themselves, with partial results, so a span that a
    third of all rows hold meets as one row per task. Both sides of the join back are written first, so that Spark may split
    hot keys.
    """
    spans = candidate_spans(docs)
    listed = spans.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set(F.struct("start", "n_lines", "hash")).alias("_spans"))
    listed = staged(listed, "lists", tidy=True)
    rows = docs.select("doc_id", "text", _text_hash())
    # the documents are dealt by their keys at every size, not only where the lists are too large to broadcast
    joined = rows.join(listed.hint("merge"), rows["doc_id"].eqNullSafe(listed["_id"]) & (rows["text_hash"] == listed["_hash"]))
    cut = lambda lines: F.transform("_spans", lambda s: F.struct(s["start"], s["n_lines"], s["hash"], F.array_join(F.slice(lines, s["start"] + 1, s["n_lines"]), "\n").alias("span")))
    told = staged(joined.select("doc_id", "text_hash", F.inline(_bind(_lines(F.col("text")), cut))), "spans", tidy=True)
    at = F.struct("doc_id", "text_hash", "start")
    firsts = staged(told.groupBy("hash", "span").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "firsts", tidy=True)
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    later = told.join(firsts, ["hash", "span"]).filter(~(same & (F.col("start") < F.col("first.start") + F.col("n_lines"))))
    out = staged(later.select("doc_id", "text_hash", "start", "n_lines").distinct(), "later", tidy=True)
    discard(listed, told, firsts)
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` without repeated passages in ``text``, plus removed_lines and removed_chunks (long).

    A line goes if it and a neighbour equal, byte for byte, two neighbouring lines that stand earlier. So repeated passages of
    two lines or more go as a whole, whatever stands around them, and every different line stays somewhere: the earliest
    place of a line is never in a repeated span. removed_chunks counts the stretches taken out. The first of equal passages
    stays. Rows stay too, with an empty text if nothing is left; n_chars, if there is such a column, follows the text.

    Defined cases: a null text stays null; single lines stay however often they repeat, unless a repeated passage holds
    them; repeated rows (equal doc_id and text) are treated alike, so the first one's copies stay with it; a null doc_id sorts
    before all others; an empty table gives no rows. Other columns are kept; removed_lines and removed_chunks replace columns of
    those names.
    """
    lines = repeated_spans(docs).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n_lines") - 1)).alias("line"))
    gone = staged(lines.groupBy("__id", "__hash").agg(F.collect_set("line").alias("__gone")), "gone", tidy=True)
    hashed = docs.withColumn("__text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = hashed.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left")
    # array_except works by hashing, so a text of many lines takes linear time
    left = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__gone"))
    rest = _bind(F.split("text", "\n", -1), lambda x: F.array_join(F.transform(left(x), lambda i: F.get(x, i)), "\n"))
    stretches = F.size(F.array_except("__gone", F.transform("__gone", lambda i: i + 1)))
    out = joined.withColumns(
        {
            "text": F.when(F.col("__gone").isNull(), F.col("text")).otherwise(rest),
            "removed_lines": F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long"),
            "removed_chunks": F.when(F.col("__gone").isNull(), 0).otherwise(stretches).cast("long"),
        }
    )
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("removed_chunks") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns, *[c for c in ("removed_lines", "removed_chunks") if c not in docs.columns])
