"""Evidence layers of the brand pipeline, their weighted fusion and the verdict rules.

A layer is (item_id, layer, score, fired, evidence, weight). Fusion needs one grouping by item; every aggregate in it is
algebraic, so a hot item is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenmatch.functions.text import fixed
from lumenmatch.operators.mentions import GENERIC_CLASSES
from lumenmatch.operators.sequences import best_until_confident

# Layers with their default weight when an item has no row for them, in fusion order.
LAYERS = {"image": 0.0, "prompt": 0.8, "caption": 0.7, "detection": 0.7, "ocr": 0.7, "color": 0.0}
FIRED_BONUS = 1.5
RELIABLE = ("image", "ocr")
RELIABLE_FACTOR = 0.85


def _layer(df: DataFrame, name: str, score: Column, fired: Column, evidence: Column, weight: Column) -> DataFrame:
    return df.select(
        "item_id", F.lit(name).alias("layer"), score.alias("score"), fired.alias("fired"), evidence.alias("evidence"), weight.alias("weight")
    )


def image_layer(scored: DataFrame) -> DataFrame:
    """Reference similarity from (item_id, n_refs, max_similarity, avg_similarity); weight 0 without references."""
    has = F.col("n_refs") > 0
    blend = F.col("max_similarity") * 0.7 + F.col("avg_similarity") * 0.3
    text = F.format_string("Best ref sim: %.3f, avg: %.3f, blended: %.3f (%d refs)", "max_similarity", "avg_similarity", blend, "n_refs")
    return _layer(
        scored, "image", F.when(has, blend).otherwise(0.0), has & (blend > 0.75),
        F.when(has, text).otherwise("No reference images provided."), F.when(has, 4.0).otherwise(0.0),
    )


def prompt_layer(sims: DataFrame) -> DataFrame:
    """Prompt similarities (item_id, prompt_idx, prompt, prompt_kind, sim): best brand prompt against best negative."""
    brand = F.col("prompt_kind") == "brand"
    top = F.max_by(F.struct("prompt", "sim"), F.when(brand, F.struct(F.col("sim"), -F.col("prompt_idx"))))
    df = sims.groupBy("item_id").agg(top.alias("top"), F.max(F.when(~brand, F.col("sim"))).alias("neg"), F.count_if(brand).alias("n"))
    best, neg, has = F.col("top.sim"), F.coalesce("neg", F.lit(-1.0)), F.col("n") > 0
    text = F.format_string("Best brand sim: %.3f ('%s'), best neg: %.3f, diff: %.3f", best, F.col("top.prompt"), neg, best - neg)
    return _layer(
        df, "prompt", F.when(has, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (best - 0.21) / 0.07))).otherwise(0.0),
        has & (best >= 0.23) & (best > neg + 0.01),
        F.when(has, text).otherwise("No English brand names/aliases provided for CLIP Text."), F.when(has, 0.8).otherwise(0.0),
    )


def detections(boxes: DataFrame) -> DataFrame:
    """Boxes (item_id, cls, conf) that count, as rows: kind ``brand`` or ``generic``, label, rounded confidence."""
    generic = F.col("cls").isin(*GENERIC_CLASSES)
    kind = F.when(generic, "generic").when(F.col("conf") >= 0.35, "brand").when(F.col("conf") >= 0.15, "generic")
    label = F.when(generic | (F.col("conf") >= 0.35), F.col("cls")).otherwise(F.concat("cls", F.lit(" (low-conf)")))
    return boxes.withColumn("kind", kind).withColumn("label", label).withColumn("conf3", F.round("conf", 3)).filter("kind is not null")


# Most boxes that one text lists (a detector's usual limit for an image), and the texts.
LISTED = 300
BRAND_BOXES = "Brand detected with high confidence: "
GENERIC_BOXES = "Only generic or low-confidence objects: "
NO_BOXES = "No relevant objects detected."


def listed_boxes(found: DataFrame, order: str, limit: int = LISTED) -> DataFrame:
    """item_id, kind, boxes: the detections of an item and kind in the order of ``order`` as one text, at most ``limit`` of them
    and the number of the others. Spark keeps that many rows per task and group before it shuffles them."""
    entry = F.concat(F.lit("('"), "label", F.lit("', "), F.col("conf3").cast("string"), F.lit(")"))
    place = F.row_number().over(Window.partitionBy("item_id", "kind").orderBy(order))
    first = found.select("item_id", "kind", entry.alias("_t"), place.alias("_r")).filter(F.col("_r") <= limit)
    texts = first.groupBy("item_id", "kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "_t"))), lambda x: x["_t"]).alias("_list"))
    counts = found.groupBy("item_id", "kind").agg(F.count("*").alias("_n"))
    more = F.when(F.col("_n") > limit, F.format_string(" and %d more", F.col("_n") - limit)).otherwise("")
    return texts.join(counts, ["item_id", "kind"]).select("item_id", "kind", F.concat(F.lit("["), F.array_join("_list", ", "), F.lit("]"), more).alias("boxes"))


def detection_layer(boxes: DataFrame, items: DataFrame | None = None, order: str = "event_id") -> DataFrame:
    """Detection layer of every item that has boxes, or of all ``items`` (item_id). Its text lists the brand detections, or the
    generic ones if there are none, in the order of ``order``; an item without any has a text that says so."""
    brand = F.col("kind") == "brand"
    found = detections(boxes)
    best = found.groupBy("item_id").agg(
        F.max(F.when(brand, F.col("conf"))).alias("best"), F.max(F.when(~brand, F.col("conf3"))).alias("generic"), F.min("kind").alias("kind")
    )
    df = (boxes if items is None else items).select("item_id").distinct().join(best, "item_id", "left").join(listed_boxes(found, order), ["item_id", "kind"], "left")
    has = F.coalesce(brand, F.lit(False))
    score = F.when(has, F.least(F.lit(1.0), F.col("best") * 2.0)).when(F.col("generic").isNotNull(), F.least(F.lit(0.3), F.col("generic") * 0.5)).otherwise(0.0)
    text = F.when(has, F.concat(F.lit(BRAND_BOXES), "boxes")).when(F.col("kind").isNotNull(), F.concat(F.lit(GENERIC_BOXES), "boxes")).otherwise(NO_BOXES)
    return _layer(df, "detection", score, has, text, F.lit(0.7))


def hex_to_rgb(hex_color: str) -> tuple[int, int, int]:
    value = hex_color.lstrip("#")
    return int(value[0:2], 16), int(value[2:4], 16), int(value[4:6], 16)


def hex_rgb(c: Column) -> Column:
    """(r, g, b) struct of a hex colour column."""
    value = F.ltrim(c, F.lit("#"))
    return F.struct(*[F.conv(F.substring(value, at, 2), 16, 10).cast("int").alias(n) for n, at in (("r", 1), ("g", 3), ("b", 5))])


def palette_distance(colors: DataFrame, palette: list[str]) -> DataFrame:
    """Smallest RGB distance between the dominant colours (item_id, r, g, b) and the brand palette, per item."""
    def distance(rgb):
        r, g, b = rgb
        return F.sqrt((F.col("r") - r) * (F.col("r") - r) + (F.col("g") - g) * (F.col("g") - g) + (F.col("b") - b) * (F.col("b") - b))

    nearest = F.array_min(F.array(*[distance(hex_to_rgb(h)) for h in palette]))
    return colors.groupBy("item_id").agg(F.min(nearest).alias("min_dist"))


def color_layer(colors: DataFrame, palette: list[str]) -> DataFrame:
    """Colour layer; without a palette the layer is off and items get its zero-weight default in the fusion."""
    if not palette:
        off = colors.select("item_id").distinct()
        return _layer(off, "color", F.lit(0.0), F.lit(False), F.lit("Color check disabled/no palette."), F.lit(0.0))
    df = palette_distance(colors, palette)
    score = F.greatest(F.lit(0.0), 1.0 - F.col("min_dist") / 220.0)
    text = F.format_string("Color match score: %.3f (min dist=%.1f)", score, "min_dist")
    return _layer(df, "color", score, score > 0.70, text, F.lit(0.3))


def ensemble(evidence: DataFrame, defaults: dict[str, float] | None = None, listed: str | None = None) -> DataFrame:
    """One row per item: score, fired and weight of the six layers and the fused ``ensemble_score``.

    Items without a row for a layer get score 0 and the layer's default weight. Rows of an unknown layer only make the
    item exist; with ``listed`` only items that have a row of that layer are returned. Several rows of one layer combine
    to the highest score.
    """
    defaults = LAYERS if defaults is None else defaults
    aggregates = []
    for name, weight in defaults.items():
        mine = F.col("layer") == name
        aggregates += [
            F.coalesce(F.max(F.when(mine, F.col("score"))), F.lit(0.0)).alias(f"{name}_score"),
            F.coalesce(F.bool_or(F.when(mine, F.col("fired"))), F.lit(False)).alias(f"{name}_fired"),
            F.coalesce(F.max(F.when(mine, F.col("weight"))), F.lit(weight)).alias(f"{name}_weight"),
        ]
    df = evidence.groupBy("item_id").agg(*aggregates, F.bool_or(F.col("layer") == (listed or "")).alias("_listed"))
    df = (df.filter("_listed") if listed else df).drop("_listed")
    weighted, total, fired, reliable = F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0.0)
    for name in defaults:
        on, hit = F.col(f"{name}_weight") > 0, F.col(f"{name}_fired")
        effective = F.when(on, F.col(f"{name}_weight") * F.when(hit, FIRED_BONUS).otherwise(1.0)).otherwise(0.0)
        weighted = weighted + F.col(f"{name}_score") * effective
        total = total + effective
        fired = fired + F.when(on & hit, 1).otherwise(0)
        if name in RELIABLE:
            reliable = F.greatest(reliable, F.when(on & hit, F.col(f"{name}_score")).otherwise(0.0))
    df = df.select("*", weighted.alias("_w"), total.alias("_t"), fired.alias("fired_count"), reliable.alias("_r"))
    base = F.greatest(F.when(F.col("_t") > 0, F.col("_w") / F.col("_t")).otherwise(0.0), F.col("_r") * RELIABLE_FACTOR)
    bonus = F.when(F.col("fired_count") >= 3, F.least(F.lit(1.0), base + 0.10)).when(
        F.col("fired_count") >= 2, F.least(F.lit(1.0), base + 0.05)
    ).otherwise(base)
    return df.withColumn("ensemble_score", bonus).drop("_w", "_t", "_r")


def brand_verdict(fused: DataFrame) -> DataFrame:
    """Adds verdict, confidence (percent), confidence_raw and the result label."""
    def fired(name):
        return F.col(f"{name}_fired")

    visual = fired("image").cast("int") + fired("detection").cast("int")
    support = fired("caption").cast("int") + fired("color").cast("int")
    score = F.col("ensemble_score")
    floor = (
        F.when(fired("ocr"), 0.90)
        .when(fired("image") & (F.col("image_score") >= 0.85), 0.75)
        .when((visual >= 2) | ((visual >= 1) & (support >= 1)), 0.65)
        .when((visual == 1) | (support >= 2), 0.50)
    )
    level = F.least(F.lit(1.0), F.greatest(score, F.coalesce(floor, score)))
    df = fused.withColumn("_c", level)
    verdict = F.when(fired("ocr") | (F.col("_c") >= 0.70), "Relevant").when(F.col("_c") >= 0.45, "Uncertain").otherwise("Irrelevant")
    df = df.withColumn("verdict", verdict).withColumn("confidence", F.round(F.col("_c") * 100, 1)).withColumn("confidence_raw", F.round(score, 4))
    return df.withColumn("label", format_label()).drop("_c")


def format_label() -> Column:
    """Verdict followed by score and fired flags."""
    flags = [F.initcap(F.col(f"{n}_fired").cast("string")) for n in ("image", "prompt", "caption", "detection", "ocr")]
    return F.format_string(
        "%s (Score: %s, ClipImg: %s, ClipTxt: %s, Caption: %s, YOLO: %s, OCR: %s)", F.col("verdict"), fixed(F.col("confidence_raw"), 2), *flags
    )


def brand_video(frame_verdicts: DataFrame, sequences: DataFrame | None = None, max_frames: int = 6) -> DataFrame:
    """The whole result of the best frame of each sequence: all columns of ``frame_verdicts`` (seq_id, idx, verdict, confidence
    and others), and n_scanned. Sequences of ``sequences`` (seq_id) without frames are irrelevant with confidence 0."""
    best = best_until_confident(frame_verdicts, max_frames)
    if sequences is None:
        return best
    whole = sequences.select("seq_id").distinct().join(best, "seq_id", "left")
    return whole.fillna({"n_scanned": 0, "verdict": "Irrelevant", "confidence": 0.0})
