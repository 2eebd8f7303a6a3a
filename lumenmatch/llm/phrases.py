"""Substring dedup: recurring passages of words are confirmed, compiled to sharded Aho-Corasick automata and located everywhere."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenmatch.llm.arrow import fields, map_batches, raw_bytes, slices
from lumenmatch.llm.tokens import BASE, mix, powers, words
from lumenmatch.session import discard, staged

#: Words of a passage that counts when it recurs, and of the runs of words among which a window chooses its anchor.
WINDOW, GRAM = 20, 6
SPAN = WINDOW - GRAM + 1
#: Passages of one automaton on average, so that it fits a core's cache, and segments that one task streams through it.
PASSAGES, SEGMENTS = 1 << 10, 1 << 14
#: An automaton has so many times the average at most; what is beyond goes to layers.
CROWDED = 32
#: Bytes of short texts, and words of a long one, that are hashed at once.
CHUNK, STRETCH = 1 << 20, 1 << 16
#: Segments that are told at once.
ROWS = 8192
#: A null doc_id sorts before all others.
NO_ID = -(1 << 63)
_BYTES = np.arange(256, dtype=np.uint8)
_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_BACKWARD = np.ones(1, np.uint64)
SEGMENT = "id long, th long, anchor long, start int, m int, content long"


def bounds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each word of one text."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~_SPACES[text]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _back(n: int) -> np.ndarray:
    """The first ``n`` powers of the inverse of BASE modulo 2 ** 64, grown as needed."""
    global _BACKWARD
    with np.errstate(over="ignore"):
        while len(_BACKWARD) < n:
            _BACKWARD = np.concatenate([_BACKWARD, _BACKWARD * (_BACKWARD[-1] * _INVERSE)])
    return _BACKWARD[:n]


def _run_hash(hashes: np.ndarray, at: np.ndarray, size: np.ndarray | int, tag: np.ndarray | int = 0) -> np.ndarray:
    """Hash of the ``size`` words from each place on and of a tag: a difference of running sums of words times powers of BASE."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(len(hashes)))])
        value = (sums[at + size] - sums[at]) * _back(len(sums))[at]
        return mix(mix(value) + np.asarray(tag).astype(np.uint64))


def segments(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, first window, number of windows, anchor and content of the windows of each anchor.

    The anchor of a window is the run of ``GRAM`` words in it with the smallest hash, the first of several. It depends on the
    window's words alone, so equal windows have equal anchors at equal places, whatever stands around them.
    """
    n = np.maximum(np.diff(counts) - WINDOW + 1, 0)
    at = np.repeat(counts[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    best = _run_hash(hashes, np.arange(len(hashes) - GRAM + 1), GRAM)
    place, width = np.arange(len(best)), 1
    while width < SPAN:  # the smallest of width runs from each place on; two overlapping stretches make a longer one
        step = min(width, SPAN - width)
        place = np.where(best[step:] < best[:-step], place[step:], place[:-step])
        best = np.minimum(best[step:], best[:-step])
        width += step
    place, best = place[at], best[at]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    m = np.diff(np.append(first, len(at)))
    text = np.searchsorted(counts, at[first], side="right") - 1
    content = _run_hash(hashes, at[first], m + WINDOW - 1, (place[first] - at[first]) << 8 | m)
    return text, at[first] - counts[text], m, best[first], content


def _anchors(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``segments`` of many texts; a long text is hashed in stretches that share their border words."""
    for a, b in slices(offsets, CHUNK):
        own = data[offsets[a] : offsets[b]]
        if len(own) <= CHUNK:
            hashes, _, _, counts = words(own, offsets[a : b + 1] - offsets[a], _SPACES, _BYTES)
            text, *rest = segments(hashes, counts)
            yield (text + a, *rest)
            continue
        starts, ends = bounds(own)
        for w in range(0, len(starts) - WINDOW + 1, STRETCH):
            part = own[starts[w] : ends[min(w + STRETCH + WINDOW - 1, len(ends)) - 1]]
            hashes, _, _, counts = words(part, np.array([0, len(part)]), _SPACES, _BYTES)
            text, start, *rest = segments(hashes, counts)
            yield (text + a, start + w, *rest)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with the key of their document: doc_id (nulls first) and a hash of the text."""
    return docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))


def anchored_segments(docs: DataFrame) -> DataFrame:
    """id, th, anchor, start (word), m (windows), content: the segments of all texts, without their words."""

    def work(batch):
        data, offsets = raw_bytes(batch.column("text"))
        for text, start, m, anchor, content in _anchors(data, offsets):
            rows = pa.array(text)
            yield {
                "id": batch.column("id").take(rows), "th": batch.column("th").take(rows), "anchor": anchor.view(np.int64), "start": start.astype(np.int32),
                "m": m.astype(np.int32), "content": content.view(np.int64),
            }

    return map_batches(_keyed(docs).select("id", "th", "text"), T.StructType.fromDDL(SEGMENT), work)


def recurring_segments(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments whose anchor stands at two places or more: all of them, without words, and the first of each kind.

    Segments with equal anchor and content are of one kind. The first has its words, the number of the kind as ``n`` and
    ``alone``, which tells that its anchor has no other kinds. Only hashes and places are counted and joined; texts move once,
    to meet the list of the firsts that stand in them.
    """
    found = staged(anchored_segments(docs), "segments", tidy=True)
    twice = staged(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "anchors", tidy=True)
    recurring = staged(found.join(twice, "anchor", "left_semi"), "recurring", tidy=True)
    discard(found, twice)
    firsts = recurring.groupBy("anchor", "m", "content").agg(F.min(F.struct("id", "th", "start")).alias("p"), F.count("*").cast("int").alias("n"))
    firsts = staged(firsts.select("anchor", "m", "content", "p", "n"), "firsts", tidy=True)
    alone = firsts.groupBy("anchor").agg(F.count("*").alias("c")).filter("c = 1").select("anchor", F.lit(True).alias("alone"))
    marked = firsts.join(staged(alone, "alone", tidy=True), "anchor", "left").select(
        "p.id", "p.th", F.struct("anchor", "p.start", "m", "content", "n", F.coalesce("alone", F.lit(False)).alias("alone")).alias("s")
    )
    lists = staged(marked.groupBy("id", "th").agg(F.collect_list("s").alias("list")), "lists", tidy=True)
    discard(firsts)

    def work(batch):
        data, offsets = raw_bytes(batch.column("text"))
        flat = batch.column("list").flatten()
        ends = np.cumsum(pa.compute.list_value_length(batch.column("list")).to_numpy())
        names = ("anchor", "start", "m", "content", "n", "alone")
        columns = {c: flat.field(k) for k, c in enumerate(names)}
        row = np.repeat(np.arange(batch.num_rows), np.diff(ends, prepend=0))
        start, stop = (columns["start"].to_numpy(), columns["start"].to_numpy() + columns["m"].to_numpy() + WINDOW - 2)
        held: list[bytes] = []
        done = 0

        def told(upto: int) -> dict:
            docs = pa.array(row[done:upto])
            return {
                "id": batch.column("id").take(docs), "th": batch.column("th").take(docs), **{c: v.slice(done, upto - done) for c, v in columns.items()},
                "words": pa.array(held, pa.binary()).cast(pa.string()),
            }

        for k in range(batch.num_rows):
            raw = data[offsets[k] : offsets[k + 1]]
            first, last = bounds(raw)
            raw = raw.tobytes()
            upto = ends[k]
            for at in range(ends[k - 1] if k else 0, upto, ROWS):
                some = slice(at, min(at + ROWS, upto))
                held += [raw[x:y] for x, y in zip(first[start[some]].tolist(), last[stop[some]].tolist())]
                if len(held) >= ROWS:
                    yield told(done + len(held))
                    done, held = done + len(held), []
        if held:
            yield told(done + len(held))

    joined = _keyed(docs).select("id", "th", "text").join(lists, ["id", "th"]).select("id", "th", "text", "list")
    texts = staged(map_batches(joined, T.StructType.fromDDL(f"{SEGMENT}, n int, alone boolean, words string"), work), "texts", tidy=True)
    discard(lists)
    return recurring, texts


def passages(firsts: DataFrame) -> DataFrame:
    """anchor, id, th, start, words, offsets: where each passage of ``WINDOW`` words that recurs stands first, as places in a
    segment. Only the first segment of each kind is looked at, so copies cost nothing; if its anchor has no other kinds, the
    segment recurs as a whole, and offsets is null."""

    def work(batch):
        data, offsets = raw_bytes(batch.column("words"))
        hashes, _, _, counts = words(data, offsets, _SPACES, _BYTES)
        m = np.diff(counts) - WINDOW + 1
        row = np.repeat(np.arange(len(m)), m)
        offset = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        rows = pa.array(row)
        yield {
            **{c: batch.column(c).take(rows) for c in ("anchor", "id", "th", "start", "n")}, "offset": offset.astype(np.int32),
            "window": _run_hash(hashes, counts[row] + offset, WINDOW).view(np.int64),
        }

    schema = T.StructType.fromDDL("anchor long, id long, th long, start int, n int, offset int, window long")
    among = firsts.filter(~F.col("alone"))
    windows = map_batches(among.select("anchor", "id", "th", "start", "n", "words"), schema, work)
    place = F.struct("id", "th", (F.col("start") + F.col("offset")).alias("at"), "start")
    first = windows.groupBy("anchor", "window").agg(F.sum("n").alias("n"), F.min(place).alias("p")).filter("n > 1")
    offsets = first.groupBy("anchor", "p.id", "p.th", "p.start").agg(F.collect_list(F.col("p.at") - F.col("p.start")).alias("offsets"))
    columns = ("anchor", "id", "th", "start", "words", "offsets")
    chosen = among.join(staged(offsets, "offsets", tidy=True), ["anchor", "id", "th", "start"]).select(*columns)
    return chosen.unionByName(firsts.filter("alone").withColumn("offsets", F.lit(None).cast("array<int>")).select(*columns))


class Automaton:
    """Aho-Corasick automaton over whole words: each word of its passages is one letter; other words are none of them."""

    def __init__(self):
        self.letters: dict[bytes, str] = {}
        self.machine = ahocorasick.Automaton()

    def add(self, own: list[bytes], offsets: list[int] | None, place: tuple[int, int, int]) -> None:
        """Passages of a segment that stands at ``place``: those at ``offsets``, or the segment as a whole."""
        letters = self.letters
        for w in own:
            if w not in letters:
                k = len(letters) + 1
                letters[w] = chr(k if k < 0xD800 else k + 0x800)
        spelt = "".join(map(letters.__getitem__, own))
        if offsets is None:
            self.machine.add_word(spelt, (place, 0, len(own)))
        else:
            for o in offsets:
                self.machine.add_word(spelt[o : o + WINDOW], (place, o, WINDOW))

    def close(self) -> None:
        self.machine.make_automaton()

    def hits(self, own: list[bytes]) -> list[tuple]:
        """End and value of each passage among the words of a segment."""
        if not len(self.machine):
            return []
        get = self.letters.get
        return list(self.machine.iter("".join([get(w, "\0") for w in own])))


def digest_of(own: list[bytes]) -> bytes:
    """What words are compared by where they stand in different tasks."""
    return hashlib.blake2b(b" ".join(own), digest_size=16).digest()


def _ranges(passages: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Words covered by passages (offset, words), as ranges."""
    out: list[tuple[int, int]] = []
    for o, n in sorted(passages):
        if out and o <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], o + n))
        else:
            out.append((o, o + n))
    return out


def left_words(own: list[bytes], gone: Iterable[tuple[int, int, bytes | None]]) -> list[bytes]:
    """The words outside the ranges (low, high, digest); a range with the digest of other words doesn't count."""
    stay = bytearray(b"\1") * len(own)
    for x, y, d in gone:
        if d is None or digest_of(own[x:y]) == d:
            stay[x:y] = bytes(y - x)
    return list(compress(own, stay))


def later_occurrences(firsts: DataFrame, confirmed: DataFrame, passages_each: int = PASSAGES, segments_each: int = SEGMENTS) -> DataFrame:
    """id, th, start, anchor, m, content of the first segment of a kind, low, high, digest: ranges of its words in passages.

    Rows without a digest are of the first segment itself, without passages that stand first there. The others are for its
    copies, with a digest of the words from low to high.

    Passages are dealt by anchor to shards, and segments follow their anchors, so each segment meets one automaton. A shard
    with many segments is read by several tasks, each with its own copy of the automaton; one with too many passages has its
    passages dealt to layers, all of which its segments meet. A task holds one automaton at a time and streams the segments.
    """
    passages_of = F.when(F.col("offsets").isNull(), 1).otherwise(F.size("offsets"))
    total = confirmed.agg(F.coalesce(F.sum(passages_of), F.lit(0)).alias("n")).first()["n"]
    shard = F.pmod("anchor", F.lit(max(1, -(-total // passages_each)))).alias("shard")
    sizes = confirmed.groupBy(shard).agg(F.sum(passages_of).alias("passages")).join(firsts.groupBy(shard).agg(F.count("*").alias("segments")), "shard")
    sizes = sizes.select("shard", F.ceil(F.col("passages") / (CROWDED * passages_each)).cast("int").alias("layers"), F.ceil(F.col("segments") / segments_each).cast("int").alias("salts"))
    sizes = staged(sizes.filter("layers > 1 OR salts > 1"), "shards", tidy=True)  # the others have one of each
    count = lambda n: F.coalesce(n, F.lit(1))
    each = lambda n: F.explode(F.sequence(F.lit(0), count(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id", "th", "start"), count(n)).cast("int")
    keys, place, kind = ("shard", "layer", "salt", "kind"), ("id", "th", "start"), ("anchor", "m", "content")
    unknown = [F.lit(None).cast(t).alias(c) for c, t in (("m", "int"), ("content", "long"), ("n", "int"))]
    patterns = confirmed.withColumn("shard", shard).join(sizes, "shard", "left").withColumn("layer", dealt("layers")).withColumn("salt", each("salts")).withColumn("kind", F.lit(0))
    texts = firsts.withColumn("shard", shard).join(sizes, "shard", "left").withColumn("salt", dealt("salts")).withColumn("layer", each("layers")).withColumn("kind", F.lit(1))
    patterns = patterns.select(*keys, *place, "anchor", *unknown, "words", "offsets")
    texts = texts.select(*keys, *place, *kind, "n", "words", F.lit(None).cast("array<int>").alias("offsets"))
    rows = patterns.unionByName(texts).repartition("shard", "layer", "salt").sortWithinPartitions(*keys)
    schema = T.StructType.fromDDL("id long, th long, start int, anchor long, m int, content long, low int, high int, digest binary")
    target = to_arrow_schema(schema)

    def run(batches):
        key, machine, closed = None, None, False
        for batch in batches:
            numbers = np.stack([batch.column(c).to_numpy() for c in keys])
            starts = np.flatnonzero(np.append(True, (np.diff(numbers) != 0).any(axis=0))) if batch.num_rows else []
            at, low, high, digests = [], [], [], []
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                *own, pattern = numbers[:, a].tolist()
                if own != key:
                    key, machine, closed = own, Automaton(), False
                column = lambda c: batch.column(c).slice(a, b - a).to_pylist()
                split = [w.split() for w in batch.column("words").slice(a, b - a).cast(pa.binary()).to_pylist()]
                places = zip(*(column(c) for c in place))
                if pattern == 0:
                    for own_words, offsets, p in zip(split, column("offsets"), places):
                        machine.add(own_words, offsets, p)
                    continue
                if not closed:
                    machine.close()
                    closed = True
                for k, own_words, (i, th, s), n in zip(range(a, b), split, places, column("n")):
                    hits = machine.hits(own_words)
                    later = [(end - size + 1, size) for end, (p, o, size) in hits if p[2] + o != s + end - size + 1 or p[0] != i or p[1] != th]
                    for x, y in _ranges(later):
                        at.append(k)
                        low.append(x)
                        high.append(y)
                        digests.append(None)
                    if n > 1:
                        for x, y in _ranges([(end - size + 1, size) for end, (_, _, size) in hits]):
                            at.append(k)
                            low.append(x)
                            high.append(y)
                            digests.append(digest_of(own_words[x:y]))
            if at:
                told = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(told) for c in (*place, *kind)), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(digests, pa.binary())], schema=target)

    return rows.mapInArrow(run, schema)


def remove_passages(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), passages_each: int = PASSAGES, segments_each: int = SEGMENTS) -> DataFrame:
    """``keep`` columns, n_words, n_removed (long), kept (the words left, joined by one space) and kept_sha256 of each row.

    A word goes if it lies in ``WINDOW`` consecutive words that stand earlier (smaller doc_id, or earlier in the same
    document); what counts is the input, not what is left. Texts are split at space and \\t to \\r; words are taken unchanged.

    Windows are bundled by anchors, so that about every seventh word becomes a row of hashes. Anchors, windows and kinds of
    segments are found by 64-bit hashes each. One segment of each kind is matched word by word by an automaton; its copies
    elsewhere get its ranges if a 128-bit digest of their own words is the same. If two different windows or segments with equal
    anchor agreed in their hashes as well, the later one would stay.

    Defined cases: null texts have no words; a null doc_id sorts before all others; rows equal in doc_id and text are one
    document (treated alike); rows equal in doc_id alone go in the order of a hash of their texts; an empty table gives no
    rows. Other columns are ignored unless kept; a kept column must not be named like an added one.
    """
    recurring, firsts = recurring_segments(docs)
    confirmed = staged(passages(firsts), "passages", tidy=True)
    found = staged(later_occurrences(firsts, confirmed, passages_each, segments_each), "found", tidy=True)
    discard(firsts, confirmed)
    shown = ("id", "th", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"), "digest")
    kinds = found.filter("digest IS NOT NULL").select("anchor", "m", "content", F.struct("id", "th", "start").alias("p"), "low", "high", "digest")
    copies = recurring.join(kinds, ["anchor", "m", "content"]).filter(F.struct("id", "th", "start") != F.col("p"))
    gone = found.filter("digest IS NULL").select(*shown).unionByName(copies.select(*shown))
    gone = staged(gone.groupBy("id", "th").agg(F.collect_list(F.struct("low", "high", "digest")).alias("gone")), "gone", tidy=True)
    discard(recurring, found)
    names = [f"__keep{k}" for k in range(len(keep))]
    rows = _keyed(docs).select(*[F.col(c).alias(n) for c, n in zip(keep, names)], "id", "th", F.col("text").alias("__text"))
    joined = rows.join(gone, ["id", "th"], "left").select(*names, "__text", "gone")

    def work(batch):
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            n_words, n_removed, kept, digest = [], [], [], []
            lists = part.column("gone")
            flat = lists.flatten()
            low, high, told = (flat.field(k).to_pylist() for k in range(3))
            ends = np.cumsum(pa.compute.list_value_length(lists).fill_null(0).to_numpy()).tolist()
            first = 0
            for text, end in zip(part.column("__text").cast(pa.binary()).to_pylist(), ends):
                own = (text or b"").split()
                n_words.append(len(own))
                if end > first:
                    own = left_words(own, zip(low[first:end], high[first:end], told[first:end]))
                    first = end
                left = b" ".join(own)
                n_removed.append(n_words[-1] - len(own))
                kept.append(left)
                digest.append(hashlib.sha256(left).hexdigest())
            yield {**{n: part.column(n) for n in names}, "n_words": n_words, "n_removed": n_removed, "kept": pa.array(kept, pa.binary()).cast(pa.string()), "kept_sha256": digest}

    out = map_batches(joined, fields(joined, names, "n_words long, n_removed long, kept string, kept_sha256 string"), work)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "n_words", "n_removed", "kept", "kept_sha256")
