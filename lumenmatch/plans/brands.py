"""Brand detection from the outputs of the six evidence layers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenmatch.operators import evidence as ev
from lumenmatch.operators.mentions import caption_evidence, ocr_evidence


@dataclass(frozen=True)
class Brand:
    name: str
    aliases: list[str] = field(default_factory=list)
    hashtags: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    palette: list[str] = field(default_factory=list)

    @property
    def terms(self) -> list[str]:
        return [self.name, *self.aliases]

    @property
    def has_ascii_name(self) -> bool:
        return any(n.strip() and n.strip().isascii() for n in self.terms)


LAYER_COLUMNS = ["item_id", "layer", "score", "fired", "weight"]


def detect_brands(
    items: DataFrame, brand: Brand, scored: DataFrame | None = None, prompt_sims: DataFrame | None = None,
    captions: DataFrame | None = None, boxes: DataFrame | None = None, ocr: DataFrame | None = None, colors: DataFrame | None = None,
) -> DataFrame:
    """Verdict per item of ``items`` (item_id). Layer inputs are optional; absent ones are excluded from the fusion,
    and items without rows in a present layer count as a layer that found nothing."""
    layers = [items.select("item_id", F.lit("item").alias("layer"), F.lit(0.0).alias("score"), F.lit(False).alias("fired"), F.lit(0.0).alias("weight"))]
    defaults = {name: 0.0 for name in ev.LAYERS}
    if scored is not None:
        layers.append(ev.image_layer(scored))
    if prompt_sims is not None and brand.has_ascii_name:
        layers.append(ev.prompt_layer(prompt_sims))
        defaults["prompt"] = 0.8
    if captions is not None:
        layers.append(caption_evidence(captions, [*brand.terms, *brand.keywords]).withColumn("layer", F.lit("caption")))
        defaults["caption"] = 0.7
    if boxes is not None:
        layers.append(ev.detection_layer(boxes))
        defaults["detection"] = 0.7
    if ocr is not None:
        layers.append(ocr_evidence(ocr, brand.terms, brand.hashtags).withColumn("layer", F.lit("ocr")))
        defaults["ocr"] = 0.7
    if colors is not None and brand.palette:
        layers.append(ev.color_layer(colors, brand.palette))
        defaults["color"] = 0.3
    long = layers[0]
    for layer in layers[1:]:
        long = long.unionByName(layer.select(*LAYER_COLUMNS))
    return ev.brand_verdict(ev.ensemble(long, defaults, listed="item"))
