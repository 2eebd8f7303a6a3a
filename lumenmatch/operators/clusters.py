"""Cosine k-means of every campaign's references at once, cluster statistics and category labels.

Seeding is farthest-first from the lowest ref_id; a round assigns each reference to the most similar centre (lowest
cluster on ties) and recentres; a campaign stops when its assignment repeats. A campaign whose first assignment puts
everything into cluster 0 keeps its seed centre.

The references are written once as packs, the matrices of one part of a campaign each. Steps join packs with the centres of
their campaign by (campaign, part), multiply them in numpy and tell one row per pack and centre (sum, count), so a campaign
that holds a third of all references is as many packs as it needs and is never one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenmatch.functions.vectors import VECTOR, dot, l2_normalize, vector_sum
from lumenmatch.operators.banks import KEY, dealt
from lumenmatch.session import staged

PACK = 2048  # references of a pack, about

# Category keywords, in tie order.
CATEGORIES = {
    "logo_refs": ["logo", "brand", "badge", "sign", "symbol", "icon", "wordmark", "emblem", "vector"],
    "drink_refs": [
        "drink", "cup", "coffee", "mug", "beverage", "tea", "straw", "glass", "liquid", "cold", "hot", "latte",
        "espresso", "cappuccino",
    ],
    "product_refs": ["product", "merch", "bottle", "can", "bag", "package", "box", "item", "tumbler", "packaging"],
    "store_refs": [
        "store", "interior", "cafe", "shop", "counter", "background", "ambient", "building", "table", "seat", "room",
        "facade", "outdoor", "street",
    ],
}
COHESION_LABELS = ("Brand Logo & Focus", "Product & Drink Close-ups", "Ambient / Interior Scenes")


def reference_packs(bank: DataFrame, per_part: int = PACK) -> DataFrame:
    """campaign_id, n_refs, part, parts, ids and e (their vectors, one after the other), by ref_id within a part."""
    sizes = staged(bank.groupBy(KEY).agg(F.count("*").alias("n_refs")), "sizes")
    rows = dealt(bank.select(KEY, "ref_id", F.col("embedding").cast(VECTOR).alias("e")), sizes, per_part)
    packed = rows.groupBy(KEY, "n_refs", "part", "parts").agg(F.sort_array(F.collect_list(F.struct("ref_id", "e"))).alias("refs"))
    return staged(packed.select(KEY, "n_refs", "part", "parts", F.col("refs.ref_id").alias("ids"), F.flatten("refs.e").alias("e")), "packs")


def _with_centers(packs: DataFrame, centers: DataFrame) -> DataFrame:
    """Packs with the centres (campaign_id, cluster_idx, centroid) of their campaign as one array ``c`` by cluster; campaigns
    without centres go. Centres are few per campaign; they are copied to each of its parts, so no key is hot."""
    listed = centers.groupBy(KEY).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("cluster_idx", "centroid"))), lambda x: x["centroid"])).alias("c"))
    parts = packs.select(KEY, "part").distinct()
    return packs.join(parts.join(listed, KEY), [KEY, "part"])


def _each_pack(packs: DataFrame, schema: str, work: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """Rows that ``work`` makes of each row; its arrays are numpy arrays there."""
    target = to_arrow_schema(T.StructType.fromDDL(schema))
    names = packs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cells = [batch.column(n)[k] for n in names]
                row = {n: np.asarray(c.values) if pa.types.is_list(c.type) and c.is_valid else c.as_py() for n, c in zip(names, cells)}
                out = list(work(row))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

    return packs.mapInArrow(run, schema)


def _seeds(packs: DataFrame, k: int) -> DataFrame:
    """Each next seed is the reference farthest from the chosen ones, the lowest of several; a row per seed."""
    schema = f"{KEY} long, ref_id long, centroid array<double>, far double"
    lowest = lambda x: [(x[KEY], int(x["ids"][0]), x["e"][: len(x["e"]) // len(x["ids"])], 0.0)]

    def farthest(x: dict) -> Iterator[tuple]:
        n = len(x["ids"])
        e, c = x["e"].reshape(n, -1), x["c"].reshape(-1, len(x["e"]) // n)
        near = (1.0 - e @ c.T).min(axis=1)
        at = int(np.argmax(near))
        yield x[KEY], int(x["ids"][at]), e[at], float(near[at])

    best = lambda df: df.groupBy(KEY).agg(F.max_by(F.struct("ref_id", "centroid"), F.struct("far", -F.col("ref_id"))).alias("s")).select(KEY, "s.*")
    seeds = staged(best(_each_pack(packs.select(KEY, "ids", "e"), schema, lowest)).withColumn("cluster_idx", F.lit(0)), "seeds")
    for step in range(1, k):
        rows = _with_centers(packs.filter(F.col("n_refs") > step).select(KEY, "part", "ids", "e"), seeds)
        seeds = staged(seeds.unionByName(best(_each_pack(rows.select(KEY, "ids", "e", "c"), schema, farthest)).withColumn("cluster_idx", F.lit(step))), "seeds")
    return seeds


def farthest_first(bank: DataFrame, k: int = 4) -> DataFrame:
    """Seed centres (campaign_id, cluster_idx, ref_id, centroid): each next seed is farthest from the chosen ones."""
    return _seeds(reference_packs(bank), k).select(KEY, "cluster_idx", "ref_id", "centroid")


ROUND = f"{KEY} long, part int, parts int, labels array<int>, changed long, n long, sums array<array<double>>, counts array<long>"


def _assign(x: dict) -> Iterator[tuple]:
    """Labels of a pack, how many of them are new, and the sum and number of its references by cluster."""
    n = len(x["ids"])
    e = x["e"].reshape(n, -1)
    c = x["c"].reshape(-1, e.shape[1])
    label = (e @ c.T).argmax(axis=1).astype(np.int32)
    before = x["labels"] if x["labels"] is not None else np.zeros(n, np.int32)
    one = np.zeros((len(c), n))
    one[label, np.arange(n)] = 1.0
    yield x[KEY], x["part"], x["parts"], label, int((label != before).sum()), n, list(one @ e), np.bincount(label, minlength=len(c))


def cluster_assignments(bank: DataFrame, k: int = 4, iters: int = 25, per_part: int = PACK) -> DataFrame:
    """(campaign_id, ref_id, cluster_idx, recentred) for every reference.

    A round is one job over the packs of the campaigns that still move. What it writes are labels and one sum per pack and
    cluster; centres of the next round come from those sums.
    """
    packs = reference_packs(bank, per_part)
    centers = _seeds(packs, k).select(KEY, "cluster_idx", "centroid")
    moving, before, ended = packs, None, []
    for turn in range(iters):
        rows = _with_centers(moving, centers)
        rows = rows.withColumn("labels", F.lit(None).cast("array<int>")) if before is None else rows.join(before.select(KEY, "part", "labels"), [KEY, "part"])
        now = staged(_each_pack(rows.select(KEY, "part", "parts", "ids", "e", "c", "labels"), ROUND, _assign), "round")
        total = now.groupBy(KEY).agg(F.sum("changed").alias("moved"), F.sum("n").alias("size"))
        at_rest = total.filter("moved = 0").select(KEY, ((F.lit(turn) > 0) | (F.col("size") == 1)).alias("recentred"))
        if turn == iters - 1:
            at_rest = total.select(KEY, ((F.lit(turn) > 0) | (F.col("moved") > 0) | (F.col("size") == 1)).alias("recentred"))
        ended.append(now.select(KEY, "part", "labels").join(at_rest, KEY))
        if turn == iters - 1 or now.filter("changed > 0").isEmpty():
            break
        alive = now.join(total.filter("moved > 0").select(KEY), KEY, "left_semi")
        fresh = (
            alive.select(KEY, F.posexplode(F.arrays_zip("sums", "counts")).alias("cluster_idx", "s")).filter("s.counts > 0")
            .groupBy(KEY, "cluster_idx").agg(l2_normalize(vector_sum(F.col("s.sums"))).alias("fresh"))
        )
        still = centers.join(alive.select(KEY).distinct(), KEY, "left_semi")
        centers = staged(still.join(fresh, [KEY, "cluster_idx"], "left").select(KEY, "cluster_idx", F.coalesce("fresh", "centroid").alias("centroid")), "centers")
        moving, before = packs.join(centers.select(KEY).distinct(), KEY, "left_semi"), alive
    labelled = packs.select(KEY, "part", "ids").join(reduce(DataFrame.unionByName, ended), [KEY, "part"])
    return labelled.select(KEY, "recentred", F.explode(F.arrays_zip("ids", "labels")).alias("r")).select(KEY, F.col("r.ids").alias("ref_id"), F.col("r.labels").alias("cluster_idx"), "recentred")


def _category(mean: Column) -> Column:
    """Category with most keyword hits (first wins ties); by cohesion when no name has a keyword."""
    counts = [F.struct(F.col(f"hits_{c}").alias("n"), F.lit(-i).alias("order"), F.lit(c).alias("label")) for i, c in enumerate(CATEGORIES)]
    top = F.greatest(*counts)
    return F.when(top["n"] > 0, top["label"]).when(mean > 0.88, "logo_refs").when(mean > 0.78, "drink_refs").otherwise("store_refs")


def _cohesion_band(mean: Column, idx: Column, single: Column) -> Column:
    band = F.when(mean > 0.88, COHESION_LABELS[0]).when(mean > 0.78, COHESION_LABELS[1]).otherwise(COHESION_LABELS[2])
    return F.when(single, band).otherwise(F.format_string("%s (Cluster %d)", band, idx + 1))


def cluster_stats(bank: DataFrame, assignments: DataFrame, labels: str = "category") -> DataFrame:
    """One row per non-empty cluster: centroid, size, mean and deviation of member similarity, label.

    ``labels="category"`` uses file-name keywords, ``labels="cohesion"`` the similarity bands. Members stay rows of
    ``assignments``.
    """
    name = F.lower("ref_name")
    members = bank.join(assignments, [KEY, "ref_id"]).select(
        KEY, "cluster_idx", "recentred", "ref_id", F.col("embedding").cast(VECTOR).alias("e"), name.alias("name")
    )
    hits = [F.count_if(F.rlike("name", F.lit("|".join(words)))).alias(f"hits_{c}") for c, words in CATEGORIES.items()]
    centers = members.groupBy(KEY, "cluster_idx").agg(
        F.when(F.first("recentred"), l2_normalize(vector_sum(F.col("e")))).otherwise(F.min_by("e", "ref_id")).alias("centroid"),
        *hits,
    )
    sims = members.join(centers.select(KEY, "cluster_idx", "centroid"), [KEY, "cluster_idx"]).groupBy(KEY, "cluster_idx").agg(
        F.count("*").alias("n_members"),
        F.avg(dot(F.col("e"), F.col("centroid"))).alias("avg_similarity"),
        F.stddev_pop(dot(F.col("e"), F.col("centroid"))).alias("variance"),
    )
    df = centers.join(sims, [KEY, "cluster_idx"])
    if labels == "category":
        label = _category(F.col("avg_similarity"))
    else:
        total = F.sum("n_members").over(Window.partitionBy(KEY))
        label = _cohesion_band(F.col("avg_similarity"), F.col("cluster_idx"), total == 1)
    return df.withColumn("label", label).select(
        KEY, "cluster_idx", "n_members", "centroid", "label", "variance", "avg_similarity"
    )


def cluster_references(bank: DataFrame, k: int = 4, iters: int = 25, labels: str = "category") -> DataFrame:
    return cluster_stats(bank, cluster_assignments(bank, k, iters), labels)
