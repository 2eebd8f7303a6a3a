"""Benchmark decontamination by spaced seeds: fixed masks over words, hits verified with substitutions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenmatch.llm.arrow import map_batches, raw_bytes, slices
from lumenmatch.llm.tokens import BASE, mix, words

#: Which words of a window a seed reads (1) and which it ignores (0). Of five words or more of which a quarter differs, in any
#: places, one of these always reads equal words alone; items of four words and fewer have masks of their own.
MASKS = ("1101", "10011")
SHORT_MASKS = {2: "11", 3: "101", 4: "101"}
#: An overlap counts from so many equal words on (or three quarters of a shorter item), of which its words may lack a quarter.
MATCHED, SHARE = 12, 0.75
#: Bytes of benchmark text that are sent to the tasks at once; a larger benchmark goes in several blocks.
BLOCK = 16 << 20
CHUNK = 1 << 20
#: Hits, and words along their diagonals, that are looked at together.
HITS, ALONG = 1 << 18, 1 << 22
MATCH = "struct<item_id:{},doc_word:long,item_word:long,n_words:long,n_matched:long>"
#: Everything but ASCII letters and digits and bytes of other characters parts words.
_PARTS = np.array([not (chr(b).isalnum() or b > 127) for b in range(256)])


def seeds(hashes: np.ndarray, counts: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the masked words at each place where the whole mask lies within a text, and those places."""
    span = len(mask)
    n = np.maximum(np.diff(counts) - span + 1, 0)
    at = np.repeat(counts[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    value = np.full(len(at), np.uint64(int(mask, 2) << 8 | span))
    with np.errstate(over="ignore"):
        for k in np.flatnonzero([c == "1" for c in mask]):
            value = mix(value * BASE + hashes[at + k])
    return value, at


class Index:
    """Seeds of a block of benchmark items; its size follows from the block's bytes. Travels as the items and is built once
    per worker."""

    def __init__(self, items: list[tuple], masks: tuple[str, ...] = MASKS):
        self.items, self.all_masks, self.built = items, masks, False

    def __getstate__(self):
        return self.items, self.all_masks

    def __setstate__(self, state):
        self.__init__(*state)

    def _build(self) -> None:
        raw = [(i, t.encode()) for i, t in self.items if t]
        data = np.frombuffer(b"".join(t for _, t in raw), np.uint8)
        offsets = np.cumsum([0, *(len(t) for _, t in raw)])
        self.ids = [i for i, _ in raw]
        self.words, _, _, self.counts = words(data, offsets, _PARTS)
        n = np.diff(self.counts)
        sizes = {mask: [k for k, m in SHORT_MASKS.items() if m == mask] for mask in SHORT_MASKS.values()}
        found, self.masks = [], []
        for mask in (*self.all_masks, *sizes):
            value, at = seeds(self.words, self.counts, mask)
            item = np.searchsorted(self.counts, at, side="right") - 1
            fit = np.isin(n[item], sizes[mask]) if mask in sizes else n[item] > max(SHORT_MASKS)
            if fit.any():
                self.masks.append(mask)
                found.append((value[fit], item[fit], (at - self.counts[item])[fit]))
        value, item, place = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int))
        order = np.argsort(value, kind="stable")
        self.item, self.place = item[order], place[order]
        self.values, self.first = np.unique(value[order], return_index=True)
        self.last = np.append(self.first[1:], len(value))
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.values >> np.uint64(42)).astype(np.int64)] = True
        self.built = True

    def overlaps(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple]]:
        """Matches of each text: (item_id, doc_word, item_word, n_words, n_matched), by item and place."""
        out: list[list[tuple]] = [[] for _ in range(len(offsets) - 1)]
        if not self.built:
            self._build()
        if not len(self.values):
            return out
        hashes, _, _, counts = words(data, offsets, _PARTS)
        tried = []
        for mask in self.masks:
            value, at = seeds(hashes, counts, mask)
            near = self.maybe[(value >> np.uint64(42)).astype(np.int64)]
            value, at = value[near], at[near]
            slot = np.minimum(np.searchsorted(self.values, value), len(self.values) - 1)
            hit = self.values[slot] == value
            slots, places = slot[hit], at[hit]
            for x, y in slices(np.concatenate([[0], np.cumsum(self.last[slots] - self.first[slots])]), HITS):
                slot, at = slots[x:y], places[x:y]
                many = self.last[slot] - self.first[slot]
                entry = np.repeat(self.first[slot] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                doc = np.searchsorted(counts, at, side="right") - 1
                shift = np.repeat(at - counts[doc], many) - self.place[entry]
                tried.append(self._enough(hashes, counts, np.unique(np.stack([np.repeat(doc, many), self.item[entry], shift], axis=1), axis=0)))
        if not tried:
            return out
        best: dict[tuple[int, int], tuple] = {}
        for doc, item, shift in np.unique(np.concatenate(tried), axis=0).tolist():
            own = hashes[counts[doc] : counts[doc + 1]]
            its = self.words[self.counts[item] : self.counts[item + 1]]
            a, b = max(0, -shift), min(len(its), len(own) - shift)
            start, end, same = overlap(own[a + shift : b + shift] == its[a:b])
            if same >= min(MATCHED, math.ceil(SHARE * len(its))):
                match = (self.ids[item], a + start + shift, a + start, end - start, same)
                if (doc, item) not in best or best[(doc, item)][4] < same:
                    best[(doc, item)] = match
        for (doc, _), match in sorted(best.items()):
            out[doc].append(match)
        return out

    def _enough(self, hashes: np.ndarray, counts: np.ndarray, tried: np.ndarray) -> np.ndarray:
        """Of (text, item, shift), those along which enough words are equal to count, wherever they stand."""
        doc, item, shift = tried.T
        size = self.counts[item + 1] - self.counts[item]
        start = np.maximum(0, -shift)
        n = np.minimum(size, counts[doc + 1] - counts[doc] - shift) - start
        kept = []
        for x, y in slices(np.concatenate([[0], np.cumsum(n)]), ALONG):
            m = n[x:y]
            first = np.cumsum(m) - m
            step = np.arange(m.sum()) - np.repeat(first, m)
            own, its = counts[doc[x:y]] + start[x:y] + shift[x:y], self.counts[item[x:y]] + start[x:y]
            equal = np.add.reduceat(hashes[np.repeat(own, m) + step] == self.words[np.repeat(its, m) + step], first, dtype=np.int64)
            kept.append(equal >= np.minimum(MATCHED, np.ceil(SHARE * size[x:y])))
        return tried[np.concatenate(kept)] if kept else tried


def overlap(equal: np.ndarray) -> tuple[int, int, int]:
    """Start, end and equal words of the stretch with the most equal words among those of which three quarters or more are
    equal (``SHARE``); it begins and ends with one; the first of several."""
    # a stretch has the share where the sum of +1 (equal) and -3 over it is not negative
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -3))])
    same = np.concatenate([[0], np.cumsum(equal)])
    # the longest such stretch up to each end starts at the first sum that is no larger than the end's
    start = np.searchsorted(-np.minimum.accumulate(total), -total)
    end = int(np.argmax(same - same[start]))
    places = np.flatnonzero(equal[start[end] : end]) + start[end]
    return (int(places[0]), int(places[-1]) + 1, len(places)) if len(places) else (0, 0, 0)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` with ``matches``: the benchmark items (item_id, text) that the text holds, wholly or in part.

    An overlap counts if, along one alignment, a stretch has ``MATCHED`` equal words (or three quarters of a shorter item) and
    at most a quarter of its words differ. A match: item_id, first word in the document and in the item, words of the
    stretch and how many of them are equal; the best one per item. Words are runs of ASCII letters, digits and non-ASCII
    characters, with A-Z in lower case.

    The benchmark is measured first. Up to ``block`` bytes are sent to the tasks as a whole, where the seeds of their index
    are joined with those of each whole text, and no document is shuffled. A larger benchmark goes in blocks, each searched
    in a scan of its own, so a task holds one index; only documents with matches go on and are joined back.

    Defined cases: null and empty texts match nothing; items of one word, empty ones and null ones are not sought; equal items
    each match; repeated rows match alike; empty tables give no rows or no matches. Other columns are kept; a column named
    matches is replaced.
    """
    spark = docs.sparkSession
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(size / block))
    kind = benchmark.schema["item_id"].dataType.simpleString()
    kept = docs.select(*[c for c in docs.columns if c != "matches"])
    dealt = benchmark.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("b"))

    def search(rows: DataFrame, b: int) -> DataFrame:
        items = sorted(((r["item_id"], r["text"]) for r in dealt.filter(F.col("b") == b).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
        return _with_block(rows, spark.sparkContext.broadcast(Index(items, masks)), kind)

    if blocks == 1:
        return search(kept, 0)
    texts = kept.select("text", F.xxhash64("text").alias("__a"), F.xxhash64(F.reverse("text"), F.length("text")).alias("__b")).filter(F.col("text") != "")
    parts = [search(texts, b).filter(F.size("matches") > 0).drop("text").dropDuplicates(["__a", "__b"]) for b in range(blocks)]
    found = reduce(DataFrame.unionByName, parts).groupBy("__a", "__b").agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))
    keyed = kept.withColumns({"__a": F.xxhash64("text"), "__b": F.xxhash64(F.reverse("text"), F.length("text"))})
    none = F.array().cast(f"array<{MATCH.format(kind)}>")
    return keyed.join(found, ["__a", "__b"], "left").select(*kept.columns, F.coalesce("matches", none).alias("matches"))


def _with_block(docs: DataFrame, index, kind: str) -> DataFrame:
    names = docs.columns

    def work(batch):
        data, offsets = raw_bytes(batch.column("text"))
        for a, b in slices(offsets, CHUNK):
            got = index.value.overlaps(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            part = batch.slice(a, b - a)
            keys = ("item_id", "doc_word", "item_word", "n_words", "n_matched")
            yield {**{n: part.column(n) for n in names}, "matches": [[dict(zip(keys, m)) for m in x] for x in got]}

    schema = T.StructType([docs.schema[n] for n in names] + T.StructType.fromDDL(f"matches array<{MATCH.format(kind)}>").fields)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    return map_batches(docs, schema, work)
