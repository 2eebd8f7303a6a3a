"""Brand terms in text: mentions, OCR evidence, caption evidence, prompt and class tables.

Terms are rows (a table of any size, or a brand's short list made one); captions alone test a short list as literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenmatch.functions.text import SPACE, strip, words
from lumenmatch.operators.positions import CHUNK, dense_positions, with_halo
from lumenmatch.operators.terms import by_item, contained, dealt, find_terms, normal_texts, normalized_terms, numbered, spanning, term_table, whole_hits, word_hits, words_of_terms
from lumenmatch.session import staged

# Fixed values of the text layers.
SCENE_WORDS = (
    "restaurant", "cafe", "coffee", "food", "menu", "dining", "meal", "dish", "drink", "table", "interior", "storefront",
    "starbucks", "cup", "logo", "sign", "brand", "مطعم", "كافيه", "قهوة", "طعام", "مشروب", "مقهى",
)
PROMPT_TEMPLATES = (
    "a photo showing the brand {}", "the {} logo", "a sign that says {}", "the word {} written on something",
    "{} branding", "a {} product",
)
NEGATIVE_PROMPTS = (
    "a random photo", "a generic photo", "a photo of food or drinks", "a generic product with no brand",
    "a sign or storefront without logos",
)
CLASS_TEMPLATES = ("{}", "{} logo", "{} sign")
GENERIC_CLASSES = ("brand logo", "store sign")
EVIDENCE_CHARS = 200


def _terms(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def distinct_terms(*lists: Column) -> Column:
    """Order-preserving union of term arrays without repeats."""
    out = F.array_distinct(lists[0])
    for more in lists[1:]:
        out = F.array_union(out, more)
    return out


def brand_mentions(docs: DataFrame, keys: list[str], text: str, terms: list[str] | DataFrame) -> DataFrame:
    """One row per (keys, matched term): contained after normalisation (exact), or within two edits of a word."""
    table = terms if isinstance(terms, DataFrame) else term_table(docs.sparkSession, term=terms)
    return find_terms(docs, keys, text, table)


def quoted(terms: Column) -> Column:
    """Terms as a bracketed list of quoted texts."""
    return F.concat(F.lit("["), F.array_join(F.transform(terms, lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]"))


def ocr_hits(ocr: DataFrame, terms: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """item_id, kind, pos, term: which terms (kind, pos, term) the OCR rows (item_id, seq, text) of an item hold.

    Terms of kind ``brand`` may also be close to a word. The reference text is all rows of an item joined by blanks. It is
    never built: words lie inside one row, and a term with blanks is searched for in a row followed by the start of its
    successors. Successor rows come from a bounded window inside chunks, so an item holding a third of all rows is spread
    over many tasks.
    """
    norms = numbered(normalized_terms(terms))
    solid = normal_texts(ocr, ["item_id", "seq"], "text").filter(F.col("_norm") != "")
    exploded = solid.select("item_id", F.explode(words(F.col("_norm"))).alias("word"))
    vocabulary = staged(exploded.select("word").distinct(), "vocabulary")
    hits = word_hits(exploded, words_of_terms(vocabulary, norms, F.col("kind") == "brand"), norms)
    wide = staged(spanning(norms).select("norm").distinct(), "spanning")
    longest = wide.agg(F.max(F.length("norm"))).first()[0]
    if longest is not None:
        reach = longest // 2 + 1  # every further row adds at least one character and a blank
        placed = dense_positions(solid.select("item_id", "seq", "_norm"), ["item_id"], ["seq"], F.floor(F.col("seq") / chunk))
        after = Window.partitionBy("item_id", "_chunk").orderBy("position").rowsBetween(1, reach)
        ahead = F.substring(F.array_join(F.collect_list(F.substring("_norm", 1, longest)).over(after), " "), 1, longest)
        rows = with_halo(placed, "position", 0, reach, chunk).withColumn("_ahead", ahead).filter("_own")
        spanned = rows.select("item_id", F.concat_ws(" ", "_norm", "_ahead").alias("_text"))
        hits = hits.unionByName(whole_hits(contained(spanned, "_text", wide), norms))
    return by_item(hits, ["item_id"]).join(norms, "n").filter(F.col("exact") | (F.col("kind") == "brand")).select("item_id", "kind", "pos", "term")


def ocr_evidence(ocr: DataFrame, brand_terms: list[str] | DataFrame, hashtags: list[str], chunk: int = CHUNK) -> DataFrame:
    """OCR layer per item from (item_id, seq, text, conf) rows; matched terms in the order of the lists, or by ``pos`` of a
    table (pos, term)."""
    spark = ocr.sparkSession
    tags = term_table(spark, tag=[h.lstrip("#") for h in hashtags if h])
    brands = brand_terms.select(F.lit("brand").alias("kind"), "pos", "term") if isinstance(brand_terms, DataFrame) else term_table(spark, brand=brand_terms)
    found = ocr_hits(ocr, brands.unionByName(tags), chunk)
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "term")))), lambda t: t["term"])
    hits = found.groupBy("item_id").agg(of("brand").alias("brand_matched"), of("tag").alias("hashtag_matched"))
    conf = ocr.groupBy("item_id").agg(F.avg("conf").alias("avg_conf"))
    # the first 200 characters need at most 201 rows, since every row adds at least its blank; Spark keeps that many per task
    # before it shuffles them
    head = Window.partitionBy("item_id").orderBy("seq")
    first = (
        ocr.select("item_id", "seq", F.substring("text", 1, EVIDENCE_CHARS).alias("t"))
        .withColumn("_r", F.row_number().over(head))
        .filter(F.col("_r") <= EVIDENCE_CHARS + 1)
        .groupBy("item_id")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "t"))), lambda r: r["t"]), " ").alias("_text"))
    )
    df = conf.join(hits, "item_id", "left").join(first, "item_id", "left")
    df = df.withColumns({c: F.coalesce(F.col(c), _terms([])) for c in ("brand_matched", "hashtag_matched")})
    score = (
        F.when(F.size("brand_matched") > 0, F.least(F.lit(1.0), 0.6 + F.col("avg_conf") * 0.4))
        .when(F.size("hashtag_matched") > 0, F.least(F.lit(0.7), 0.3 + F.col("avg_conf") * 0.3))
        .otherwise(0.0)
    )
    matched = distinct_terms(F.col("brand_matched"), F.col("hashtag_matched"))
    head_text = F.coalesce(F.substring("_text", 1, EVIDENCE_CHARS), F.lit(""))
    # fixed value: form of the evidence text
    evidence = F.concat(F.lit("OCR text: '"), head_text, F.lit("' | Brand: "), quoted(F.col("brand_matched")), F.lit(" | Hashtags: "), quoted(F.col("hashtag_matched")))
    return df.select(
        "item_id", F.substring("_text", 1, EVIDENCE_CHARS).alias("ocr_head"), "avg_conf", matched.alias("matched_terms"), evidence.alias("evidence"),
        "brand_matched", "hashtag_matched", score.alias("score"), (F.size(matched) > 0).alias("fired"), F.lit(0.7).alias("weight"),
    )


def caption_evidence(captions: DataFrame, terms: list[str]) -> DataFrame:
    """Caption layer per item from (item_id, caption): contained terms, or a weak score for scene words."""
    lowered = [t.lower() for t in terms]
    unique = [t for t in dict.fromkeys(lowered) if t]
    caption = strip(F.lower("caption"))
    df = dealt(captions, ["item_id"], "caption").select("item_id", caption.alias("caption")).withColumn(
        "matched_terms", F.filter(_terms(unique), lambda t: F.contains("caption", t)) if unique else _terms([])
    )
    scene = F.arrays_overlap(F.split("caption", f"{SPACE}+"), F.array(*[F.lit(w) for w in SCENE_WORDS]))
    n = F.size("matched_terms")
    score = F.when(n > 0, F.least(F.lit(1.0), n * 0.5)).when(scene, 0.25).otherwise(0.0)
    # fixed value: form of the evidence text
    evidence = F.concat(F.lit("Caption: '"), F.col("caption"), F.lit("' | Matched: "), quoted(F.col("matched_terms")))
    return df.select("item_id", "caption", "matched_terms", evidence.alias("evidence"), score.alias("score"), (n > 0).alias("fired"), F.lit(0.7).alias("weight"))




def _names(names: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(names, strip), lambda n: n.isNotNull() & (n != "")))


def _fill(template: str, name: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), name, F.lit(after))


def prompt_table(brands: DataFrame) -> DataFrame:
    """(brand_id, prompt_kind, prompt_idx, prompt) for (brand_id, names); names beyond ASCII give no prompts."""
    ascii_names = F.filter(_names(F.col("names")), lambda n: F.rlike(n, F.lit(r"^[\x00-\x7F]*$")))
    per_name = F.flatten(F.transform(ascii_names, lambda n: F.array(*[_fill(t, n) for t in PROMPT_TEMPLATES])))
    tagged = F.concat(
        F.transform(per_name, lambda p: F.struct(F.lit("brand").alias("prompt_kind"), p.alias("prompt"))),
        F.array(*[F.struct(F.lit("negative").alias("prompt_kind"), F.lit(p).alias("prompt")) for p in NEGATIVE_PROMPTS]),
    )
    return brands.filter(F.size(ascii_names) > 0).select("brand_id", F.posexplode(tagged).alias("prompt_idx", "p")).select(
        "brand_id", "p.prompt_kind", "prompt_idx", "p.prompt"
    )


def class_table(brands: DataFrame) -> DataFrame:
    """(brand_id, class_idx, class_name): name, logo and sign classes, then the two generic ones, without repeats."""
    per_name = F.flatten(F.transform(_names(F.col("names")), lambda n: F.array(*[_fill(t, n) for t in CLASS_TEMPLATES])))
    classes = F.array_distinct(F.concat(per_name, F.array(*[F.lit(c) for c in GENERIC_CLASSES])))
    return brands.select("brand_id", F.posexplode(classes).alias("class_idx", "class_name"))
