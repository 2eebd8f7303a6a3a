"""Source divergence audit: hash-consed segment trees over term ids, priced pair by pair in one memoized walk."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenmatch.session import staged

#: Terms are kept in a language from so many of its documents on.
LEAST_DOCS = 10
#: Terms of one segment tree on average, and groups of one tile; a task holds the trees of two tiles.
BLOCK, TILE = 1 << 14, 32
#: Counted (group, term) entries that a task holds before it passes them on.
HELD = 300_000
#: Bytes of a text that are split into terms at once.
SLICE = 1 << 20
#: Ranks of the term part.
RANKS = 10
UNIT = 1_000_000_000
_TERMS = re.compile(rb"[a-z\x80-\xff]+")
_BREAK = re.compile(rb"[^a-z\x80-\xff]")
COUNTS = "lang string, source string, term string, n long, docs long"
PRICED = "lang string, source string, part string, item string, value long"


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in slices that cut no term."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            found = _BREAK.search(text, end)
            end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents), in partial sums: one task may tell of a term more than once.

    Every (lang, source) also has a row with a null term. Terms are runs of ASCII letters and non-ASCII characters, A-Z in
    lower case. A task holds at most ``HELD`` counted entries (and those of the text it is in).
    """
    schema = T.StructType.fromDDL(COUNTS)
    target = to_arrow_schema(schema)

    def told(counts: dict) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], []]
        for (lang, source), (n, held) in counts.items():
            terms = list(n)
            for c, v in zip(cols, ([lang] * (len(terms) + 1), [source] * (len(terms) + 1), [None, *(t.decode() for t in terms)], [0, *n.values()], [0, *map(held.__getitem__, terms)])):
                c.extend(v)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target)], schema=target)

    def run(batches):
        counts: dict = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                n, held = counts.setdefault((lang or "", source or ""), (Counter(), Counter()))
                raw, own = (text or "").encode().lower(), set()
                before = len(n)
                for piece in _pieces(raw):
                    terms = _TERMS.findall(piece)
                    n.update(terms)
                    own.update(terms)
                held.update(own)
                size += len(n) - before
                if size > HELD:
                    yield told(counts)
                    counts, size = {}, 0
        if counts:
            yield told(counts)

    return docs.select("lang", "source", "text").mapInArrow(run, schema)


class Trees:
    """Segment trees over equal spans of term ids, all in one set of nodes.

    A node is known by its two halves (a leaf by its count; -1 where there is no term), so equal subtrees are one node,
    wherever they stand and whichever group has them. ``halves[k]`` are the nodes of level k as two columns of nodes of the
    level below; ``rows[k]`` are each tree's nodes of that level from left to right.
    """

    def __init__(self, counts: np.ndarray):
        self.leaves, at = np.unique(counts, return_inverse=True)
        self.rows = [at.reshape(counts.shape)]
        self.halves: list[np.ndarray] = []
        while self.rows[-1].shape[1] > 1:
            below, base = self.rows[-1], int(self.rows[-1].max()) + 1
            nodes, at = np.unique(below[:, ::2] * base + below[:, 1::2], return_inverse=True)
            self.halves.append(np.stack([nodes // base, nodes % base]))
            self.rows.append(at.reshape(len(counts), -1))

    def walk(self, a: int, b: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """Both trees at once, from the roots down, each pair of nodes once: for every level from the top where its pairs
        find their halves in the level below, and the counts of the pairs of leaves."""
        left, right = self.rows[-1][a], self.rows[-1][b]
        steps = []
        for halves in reversed(self.halves):
            base = int(halves.max()) + 1
            pairs, at = np.unique(halves[:, left] * base + halves[:, right], return_inverse=True)
            at = at.reshape(2, -1)
            steps.append((at[0], at[1]))
            left, right = pairs // base, pairs % base
        return steps, self.leaves[left], self.leaves[right]


def _shares(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), in Python's integers where 64 bits don't hold it."""
    if int(count.max(initial=0)) + 2 >= (1 << 63) // UNIT or total + 2 * terms >= 1 << 62:
        count = count.astype(object)
    return 1 + UNIT * (count + 2) // (total + 2 * terms)


def _prices(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def price_pair(trees: Trees, a: int, b: int, total_a: int, total_b: int, terms: int) -> int:
    """Sum of the prices of all terms of two trees."""
    steps, left, right = trees.walk(a, b)
    value = np.where(left >= 0, _prices(_shares(left, total_a, terms), _shares(right, total_b, terms)), 0)
    for first, second in reversed(steps):
        value = value[first] + value[second]
    return int(value[0])


def dearest_terms(trees: Trees, a: int, b: int, total_a: int, total_b: int, terms: int, ranks: int = RANKS) -> list[tuple[int, int]]:
    """(place, price) of the leaves that tree ``a`` has and where its share is the higher one, at least the ``ranks`` dearest
    and all as dear as the last of them."""
    steps, left, right = trees.walk(a, b)
    p, q = _shares(left, total_a, terms), _shares(right, total_b, terms)
    best = [np.where((left > 0) & (p > q), _prices(p, q), -1)]
    for first, second in reversed(steps):
        best.append(np.maximum(best[-1][first], best[-1][second]))
    best.reverse()
    pairs, places = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(len(best)):
        if level:
            first, second = steps[level - 1]
            pairs, places = np.concatenate([first[pairs], second[pairs]]), np.concatenate([2 * places, 2 * places + 1])
        value = best[level][pairs]
        # as many subtrees hold a leaf of this price at least
        bound = max(0, np.sort(value)[-ranks] if len(value) >= ranks else 0)
        pairs, places = pairs[value >= bound], places[value >= bound]
    return [(int(x), int(v)) for x, v in zip(places, best[-1][pairs])]


def _priced(table: pa.Table, size: int) -> Iterator[tuple]:
    """Rows of PRICED of one (lang, block, tile, tile)."""
    sid, place, n, label = (table.column(c).to_numpy() for c in ("sid", "place", "n", "label"))
    lang, terms = table.column("lang")[0].as_py(), table.column("terms")[0].as_py()
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    head = place < 0
    members = np.unique(sid)
    row = np.searchsorted(members, sid)
    totals, names = dict(zip(row[head], n[head].tolist())), dict(zip(row[head], label[head]))
    width = int(place.max()) + 1
    if not width:
        for i in range(1, len(members)):
            for j in range(i + 1, len(members)):
                yield from ((lang, names[x], "pair", names[y], 0) for x, y in ((i, j), (j, i)) if low == high or members[i] // size != members[j] // size)
        return
    counts = np.full((len(members), 1 << (width - 1).bit_length()), -1, np.int64)
    counts[:, :width] = 0
    counts[row[~head], place[~head]] = n[~head]
    trees = Trees(counts)
    for i in range(1, len(members)):
        for j in range(i + 1, len(members)):
            if low == high or members[i] // size != members[j] // size:
                value = price_pair(trees, i, j, totals[i], totals[j], terms)
                yield lang, names[i], "pair", names[j], value
                yield lang, names[j], "pair", names[i], value
    if low == high:
        words = np.empty(width, object)
        own = ~head & (sid < 0)
        words[place[own]] = label[own]
        for i in range(1, len(members)):
            found = [(-v, words[x].encode(), words[x]) for x, v in dearest_terms(trees, i, 0, totals[i], totals[0], terms)]
            for v, _, word in sorted(found)[:RANKS]:
                yield lang, names[i], "term", word, -v


def audit(docs: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value (long), rank (int): how far the sources of a language lie apart, and by which terms.

    Of every (lang, source) group the other sources of the language (part ``pair``) with the sum over all kept terms of
    floor((p-q)^2/(p+q)), p and q being the groups' shares in whole billionths, and its ten terms that stand out most against
    the language (part ``term``).

    The terms of a language are dealt by hash to blocks, by falling count within one; a block's trees of all groups share their
    nodes, and a walk over two trees prices each pair of nodes once. Sums over blocks give whole values. A task holds one
    block of at most two tiles of groups, however many groups or terms there are.

    Defined cases: null text, lang and source are empty texts; groups without terms take part with no counts; a language
    without kept terms has pairs of value 0 and no terms; repeated rows are documents of their own; equal values rank by the
    bytes of the item; an empty table gives no rows. Other columns are ignored.
    """
    counts = staged(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    told = counts.filter(F.col("term").isNotNull())
    kept = told.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= LEAST_DOCS).drop("docs")
    kept = staged(kept, "terms")
    sources = counts.filter(F.col("term").isNull()).select("lang", "source").withColumn("sid", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    sources = staged(sources, "sources")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("all"))
    langs = sources.groupBy("lang").agg(F.count("*").alias("groups")).join(sizes, "lang", "left").fillna(0, ["terms", "all"])
    langs = staged(langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / block)).cast("int")).withColumn("tiles", F.ceil(F.col("groups") / tile).cast("int")), "langs")
    place = F.row_number().over(Window.partitionBy("lang", "block").orderBy(F.desc("total"), "term")) - 1
    terms = kept.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).withColumn("place", place)
    terms = staged(terms.select("lang", "term", "total", "block", "place"), "places")
    cells = staged(told.join(terms, ["lang", "term"]).select("lang", "source", "block", "place", "n"), "cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("all"))
    groups = sources.join(totals, ["lang", "source"], "left").join(langs.select("lang", "terms", "blocks", "tiles"), "lang")
    groups = staged(groups.withColumn("all", F.coalesce("all", F.lit(0))), "groups")

    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own_tile, no_label = F.floor(F.col("sid") / tile).cast("int"), F.lit(None).cast("string").alias("label")
    ends = lambda a, b: (F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    columns = ("lang", "block", "low", "high", "sid", "place", "n", "label", "terms")
    heads = groups.withColumn("block", each("blocks")).withColumn("other", each("tiles"))
    heads = heads.select("*", *ends(own_tile, F.col("other"))).select(*columns[:5], F.lit(-1).alias("place"), F.col("all").alias("n"), F.col("source").alias("label"), "terms")
    own = cells.join(groups.select("lang", "source", "sid", "terms", "tiles"), ["lang", "source"]).withColumn("other", each("tiles"))
    own = own.select("*", *ends(own_tile, F.col("other")), no_label).select(*columns)
    # the language itself, as tree -1 of every task
    couples = langs.withColumn("low", each("tiles")).withColumn("high", F.explode(F.sequence(F.col("low"), F.col("tiles") - 1)))
    whole = couples.withColumn("block", each("blocks")).select("lang", "block", "low", "high", F.lit(-1).alias("sid"), F.lit(-1).alias("place"), F.col("all").alias("n"), no_label, "terms")
    of_lang = terms.join(couples.select("lang", "low", "high", "terms"), "lang").select("lang", "block", "low", "high", F.lit(-1).alias("sid"), "place", F.col("total").alias("n"), F.col("term").alias("label"), "terms")
    rows = heads.unionByName(own).unionByName(whole).unionByName(of_lang)
    schema = T.StructType.fromDDL(PRICED)
    target = to_arrow_schema(schema)

    def work(table: pa.Table) -> pa.Table:
        found = list(_priced(table, tile))
        return pa.table([pa.array([x[k] for x in found], f.type) for k, f in enumerate(target)], schema=target)

    priced = rows.groupBy("lang", "block", "low", "high").applyInArrow(work, schema)
    ranked = priced.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return ranked.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= RANKS))
