"""Near-duplicate documents: min-max signatures, banding, and links confirmed on whole shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenmatch.llm.arrow import map_batches, raw_bytes, slices
from lumenmatch.llm.tokens import BASE, mix, shingles, words
from lumenmatch.session import staged

#: Words a shingle; a link needs LINK of 100 in common.
WIDTH, LINK = 5, 75
#: Hash functions (each gives a minimum and a maximum) and values a band: 64 * 2 / 4 = 32 bands. A pair at 0.75 is missed
#: by all of them with probability (1 - 0.75 ** 4) ** 32 < 6e-6.
PERMUTATIONS, ROWS = 64, 4
#: Longs of parity bits a set.
PARITIES = 8
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and shifts of the hash functions; a fixed sequence."""
    seed = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return seed[:n] | np.uint64(1), seed[n:]


def signatures(values: np.ndarray, ends: np.ndarray, n: int = PERMUTATIONS) -> np.ndarray:
    """Minimum and maximum of the values of every non-empty set under each hash function: one row of 2 n per set."""
    starts = ends[:-1][np.diff(ends) > 0]
    out = np.empty((len(starts), 2 * n), np.uint64)
    if len(starts):
        a, b = multipliers(n)
        with np.errstate(over="ignore"):
            for i in range(n):
                hashed = values * a[i] + b[i]
                hashed ^= hashed >> np.uint64(32)
                hashed *= a[-1 - i]
                out[:, 2 * i] = np.minimum.reduceat(hashed, starts)
                out[:, 2 * i + 1] = np.maximum.reduceat(hashed, starts)
    return out


def sets_of(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and the sets' offsets."""
    hashes, _, _, counts = words(data, offsets)
    values, ends = shingles(hashes, counts, width)
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(len(ends)))


def _keys(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit key of each non-empty set."""
    starts = ends[:-1][np.diff(ends) > 0]
    key = np.empty((len(starts), 2), np.uint64)
    if len(starts):
        with np.errstate(over="ignore"):
            key[:, 0] = mix(np.add.reduceat(mix(values), starts))
            key[:, 1] = mix(np.add.reduceat(mix(values * np.uint64(0xD6E8FEB86659FD93) + np.uint64(7)), starts))
    return key


def _parities(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each set the parities of how many of its values fall in each of 64 * PARITIES bins, as bits of longs.

    Where two sets differ in d values, their parities differ in d bits at most: an exact lower bound of the difference.
    """
    bins = 64 * PARITIES
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    odd = np.bincount(owner * bins + (values >> np.uint64(40)).astype(np.int64) % bins, minlength=(len(ends) - 1) * bins) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, PARITIES)


def signed_rows(docs: DataFrame, keep: tuple[str, ...], width: int = WIDTH, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """row (columns ``keep``), doc_id, text, node (key of the shingle set), n_shingles, parity and bands (arrays of long) of every
    row, in one pass; node, parity and bands are null for an empty set. A kept text is not stored a second time in row."""
    packed = docs.select(F.struct(F.lit(True).alias("__row"), *(c for c in keep if c != "text")).alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in packed.schema]
        + T.StructType.fromDDL("node binary, n_shingles long, parity array<long>, bands array<long>").fields
    )

    def lists(table: np.ndarray, full: np.ndarray) -> pa.Array:
        """Rows of ``table`` where ``full``, else null."""
        ends = np.concatenate([[0], np.cumsum(full)]) * table.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=np.append(~full, False)), pa.array(table.ravel().view(np.int64)))

    def work(batch):
        data, offsets = raw_bytes(batch.column("text"))
        for a, b in slices(offsets, CHUNK):
            values, ends = sets_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
            n = np.diff(ends)
            found = signatures(values, ends, permutations)
            # a band takes minima (or maxima) of different functions, so that its values are independent
            grid = np.concatenate([found[:, 0::2], found[:, 1::2]], axis=1).reshape(len(found), 2 * permutations // rows, rows)
            band = np.zeros(grid.shape[:2], np.uint64) + np.arange(grid.shape[1], dtype=np.uint64)
            with np.errstate(over="ignore"):
                for k in range(rows):
                    band = mix(band * BASE + grid[:, :, k])
            keys = iter(map(bytes, _keys(values, ends).view(np.uint8)))
            yield {
                **{c: batch.column(c).slice(a, b - a) for c in ("row", "doc_id", "text")},
                "node": [next(keys) if x else None for x in n],
                "n_shingles": n,
                "parity": lists(_parities(values, ends)[n > 0], n > 0),
                "bands": lists(band, n > 0),
            }

    return map_batches(packed, schema, work)


def confirmed(pairs: DataFrame, texts: DataFrame, width: int = WIDTH, link: int = LINK) -> DataFrame:
    """The distinct pairs (a, b) of nodes with 100 * intersection >= link * union, by their whole shingle sets.

    ``texts``: node, text. Each pair gets both texts by joins whose hot keys Spark may split, and is judged alone; a task
    holds the sets of a few pairs at a time.
    """
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def work(batch):
        known: dict[bytes, np.ndarray] = {}
        column_b, keys = batch.column("text_b"), batch.column("b").to_pylist()
        data, offsets = raw_bytes(batch.column("text_a"))
        for at, end in slices(offsets, CHUNK):
            values, ends = sets_of(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], width)
            good = []
            for i in range(at, end):
                other = known.get(keys[i])
                if other is None:
                    if len(known) > 100:
                        known.clear()
                    other = known[keys[i]] = sets_of(*raw_bytes(column_b.slice(i, 1)), width)[0]
                own = values[ends[i - at] : ends[i - at + 1]]
                common = len(own) + len(other) - len(np.union1d(own, other))
                if 100 * common >= link * (len(own) + len(other) - common):
                    good.append(i)
            if good:
                yield {"a": batch.column("a").take(pa.array(good)), "b": batch.column("b").take(pa.array(good))}

    return map_batches(both.select("a", "b", "text_a", "text_b"), T.StructType.fromDDL("a binary, b binary"), work)


def _possible(a: str, b: str, link: int) -> Column:
    """Whether sizes and parities of two rows (struct columns) leave room for a link; never false for a linked pair."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differing = sum((F.bit_count(F.col(f"{a}.parity")[i].bitwiseXOR(F.col(f"{b}.parity")[i])) for i in range(PARITIES)), F.lit(0))
    # 100 * common >= link * union means: difference * (100 + link) <= (100 - link) * (n + m)
    return (100 * F.least(n, m) >= link * F.greatest(n, m)) & (differing * (100 + link) <= (100 - link) * (n + m))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node and root (smallest node reachable over ``links`` (a, b)) of every node.

    Labels start at the node itself; a round gives every node the smallest label of its neighbours and then follows the
    label's own label (pointer jumping), so that long chains shrink fast. Each round is a written table in the shared folder;
    labels are minima with partial results, and only linked nodes take part.
    """
    edges = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = staged(edges.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    while True:
        heard = edges.join(labels, edges["b"] == labels["node"]).select(F.col("a").alias("node"), "root")
        low = heard.union(labels.select("node", "root")).groupBy("node").agg(F.min("root").alias("root"))
        # what a node tells its old root: roots merge as well
        old = labels.select("node", F.col("root").alias("was"))
        told = low.join(old, "node").filter("root < was").select(F.col("was").alias("node"), "root")
        hooked = staged(low.union(told).groupBy("node").agg(F.min("root").alias("root")), "hooked")
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = staged(hooked.join(jump, "root", "left").select("node", F.least("root", F.coalesce("further", "root")).alias("root")), "labels")
        changed = new.join(labels.withColumnRenamed("root", "was"), "node").filter("root <> was").limit(1).count()
        labels = new
        if not changed:
            break
    return nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def near_duplicates(
    docs: DataFrame, keep: tuple[str, ...] | None = None, width: int = WIDTH, link: int = LINK, permutations: int = PERMUTATIONS, rows: int = ROWS
) -> DataFrame:
    """row (a struct of the columns ``keep``, by default all), n_shingles, component_id and kept of every row of ``docs`` (doc_id,
    text, ...).

    1. Texts with equal shingle sets become one node, by a grouping with partial results.
    2. Every node is banded. In each bucket all members are held against one centre: the member that lies in the most and
       largest buckets, which in a family of copies is their origin. Confirmed links give first components.
    3. Buckets whose members are still in several components give the pairs of members of different components, less those
       that sizes and parities prove too different; they are confirmed in turn.
    So a large family costs a pair for each member, not for each two of them, and no link that banding finds is lost.

    Defined cases: null and empty texts have no set, link with nothing and are their own component; repeated rows are linked
    as any equal texts; rows without doc_id never name a component; one without any named row has a null component_id, and
    its rows are kept; an empty table gives no rows. Other columns stay in row.
    """
    keep = tuple(docs.columns) if keep is None else keep
    signed = staged(signed_rows(docs, keep, width, permutations, rows), "signed")
    nodes = staged(
        signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.struct(F.first("n_shingles").alias("n"), F.first("parity").alias("parity")).alias("sketch"), F.first("bands").alias("bands")),
        "nodes",
    )
    members = nodes.select("node", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = staged(members.join(sizes, "band"), "buckets")

    weight = buckets.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = buckets.select("band", "node").join(weight, "node")
    centres = weighed.groupBy("band").agg(F.max(F.struct("weight", "node"))["node"].alias("centre"))
    spokes = buckets.join(centres, "band").filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    sketches = nodes.select("node", "sketch")
    tried = staged(_sketched(spokes, sketches, link), "spokes")
    needed = buckets.select("node").distinct()
    texts = staged(signed.join(needed, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")
    links = staged(confirmed(tried, texts, width, link), "links")
    roots = components(nodes, links)

    placed = buckets.select("band", "node").join(roots, "node")
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("band")
    rest = staged(placed.join(mixed, "band").join(sketches, "node").select("band", F.struct("node", "root", "sketch.n", "sketch.parity").alias("x")), "mixed")
    across = (
        rest.withColumnRenamed("x", "a")
        .join(rest.withColumnRenamed("x", "b"), "band")
        .filter((F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & _possible("a", "b", link))
        .select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
        .distinct()
    )
    known = tried.union(tried.select("b", "a"))
    more = staged(confirmed(across.join(known, ["a", "b"], "left_anti"), texts, width, link), "links")
    final = components(nodes, links.union(more))

    least = final.join(nodes.select("node", "doc_id"), "node")
    names = least.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = least.select("node", "root").join(names, "root").select("node", "component_id")
    row = F.struct(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in keep)).alias("row")
    out = signed.select(row, F.col("doc_id").alias("__id"), "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("__id")).otherwise(F.col("component_id"))
    return out.select("row", "n_shingles", component.alias("component_id"), F.col("__id").eqNullSafe(component).alias("kept"))


def _sketched(pairs: DataFrame, sketches: DataFrame, link: int) -> DataFrame:
    """The pairs (a, b) of nodes that their sketches leave possible."""
    left = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("of_a")), "a")
    both = left.join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("of_b")), "b")
    return both.filter(_possible("of_a", "of_b", link)).select("a", "b")
