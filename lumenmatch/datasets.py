"""Inputs of the registered queries, derived by Spark from the provided tables.

Every row of ``embeddings`` plays exactly one role. Fifty consecutive vectors form a campaign, so the number of
campaigns, references, competitors and targets all grow with the table. The first vector of a campaign is its theme;
references and targets are mixtures of the theme with their own vector, so that all verdict bands occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmatch.functions.vectors import VECTOR, mix
from lumenmatch.operators.positions import dense_positions
from lumenmatch.session import many_tasks

CAMPAIGN_SIZE = 50


def pick(values, index: Column) -> Column:
    """Element ``index`` (from 0) of a fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with campaign, slot, role and the campaign theme vector."""
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.expr(f"vec_id div {CAMPAIGN_SIZE}").alias("campaign_id"),
        (F.col("vec_id") % CAMPAIGN_SIZE).alias("slot"),
        F.col("embedding").cast(VECTOR).alias("e"),
    )
    theme = e.filter("slot = 0").select("campaign_id", F.col("e").alias("theme"))
    p = F.col("campaign_id") % 10
    return (
        e.join(theme, "campaign_id")
        .withColumn("p", p)
        .withColumn("n_ref", F.when(p < 5, 12).when(p < 9, 8).otherwise(2))
        .withColumn("n_neg", F.when(p < 8, 3).otherwise(0))
        .withColumn(
            "role",
            F.when(F.col("slot") == 0, "target")
            .when(F.col("slot") <= F.col("n_ref"), "reference")
            .when(F.col("slot") <= F.col("n_ref") + F.col("n_neg"), "competitor")
            .otherwise("target"),
        )
    )


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).filter("role = 'reference'")
    stem = pick(["logo", "cup", "bottle", "store", "img"], F.col("slot") % 5)
    return v.select(
        "campaign_id",
        F.col("vec_id").alias("ref_id"),
        F.concat(stem, F.lit("_"), F.col("vec_id"), F.lit(".jpg")).alias("ref_name"),
        mix(F.col("theme"), F.lit(0.3) + F.lit(0.15) * F.col("p"), F.col("e")).alias("embedding"),
    )


def neg_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).filter("role = 'competitor'")
    return v.select(
        "campaign_id",
        F.col("vec_id").alias("neg_id"),
        F.concat(F.lit("rival_"), F.col("vec_id")).alias("neg_name"),
        F.when(F.col("p") % 2 == 0, mix(F.col("theme"), F.lit(0.9), F.col("e")))
        .otherwise(F.col("e"))
        .alias("embedding"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with vector, expected label, file name and media features."""
    v = vectors(spark, sf_dir).filter("role = 'target'")
    wi = pick([0, 1, 5, 0, 4, 1, 0, 2, 3, 0, 5], F.col("slot") % 11)
    v = v.withColumn("wi", wi).withColumn("weight", pick([0.2, 0.6, 0.9, 1.2, 2.0, 0.0], F.col("wi")))
    slot, vid = F.col("slot"), F.col("vec_id")
    edge_mean = F.when(vid % 97 == 0, 0.0).otherwise((slot % 7 + 10).cast("double"))
    name = F.concat(
        pick(["tiktok", "instagram", "facebook", "fb", "youtube", "clip"], slot % 6), F.lit("_"), vid, F.lit("."),
        pick(["jpg", "png", "mp4", "JPEG", "txt"], (slot + F.col("campaign_id")) % 5),
    )
    first = F.col("n_ref") + F.col("n_neg") + 1
    order = F.when(slot == 0, F.lit(CAMPAIGN_SIZE) - first).otherwise(slot - first)
    return v.select(
        vid.alias("target_id"),
        "campaign_id",
        name.alias("filename"),
        (F.col("wi") <= 2).alias("expected_match"),
        F.when(F.col("wi") == 5, F.col("e")).otherwise(mix(F.col("theme"), F.col("weight"), F.col("e"))).alias("embedding"),
        pick([1080, 1920, 1280, 720, 1000], slot % 5).alias("width"),
        pick([1920, 1080, 720, 1280, 1400], slot % 5).alias("height"),
        ((slot * 37 + vid) % 300).alias("bottom"),
        ((slot * 53 + vid) % 200).alias("top"),
        ((slot * 29 + vid) % 120).alias("right"),
        ((slot * 17 + vid) % 60).alias("status"),
        ((slot * 41 + vid) % 150).alias("subtitle"),
        edge_mean.alias("edge_mean"),
        (edge_mean * (F.lit(0.7) + F.lit(0.1) * (vid % 10))).alias("edge_std"),
        (F.col("campaign_id") * 100 + F.floor(order / 16)).alias("video_id"),
        (order % 16).cast("long").alias("frame_idx"),
        F.concat(F.lit("frame_"), vid, F.lit(".jpg")).alias("frame_name"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score series per user of ``events``: idx = position by (ts, event_id)."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("seq_id"), "ts", "event_id", (F.col("value") / (F.col("value") + 20)).alias("score")
    )
    placed = dense_positions(e, ["seq_id"], ["ts", "event_id"], F.date_trunc("hour", F.col("ts")))
    return placed.select("seq_id", F.col("position").alias("idx"), F.col("position").alias("pos"), "score")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of a campaign in order, cut into videos of sixteen frames."""
    return targets(spark, sf_dir).drop("target_id", "filename", "expected_match")


def with_neighbours(items: DataFrame) -> DataFrame:
    """Every item asked of its own campaign and of the neighbouring one."""
    own = F.col("campaign_id")
    return items.withColumn("campaign_id", F.explode(F.array(own, F.when(own % 2 == 0, own + 1).otherwise(own - 1))))


def whole_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as the references of one campaign, -1: a bank of several blocks."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit(-1).cast("long").alias("campaign_id"), F.col("vec_id").alias("ref_id"), F.concat(F.lit("all_"), F.col("vec_id")).alias("ref_name"), F.col("embedding").cast(VECTOR).alias("embedding"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = targets(spark, sf_dir).filter(F.lower("filename").endswith(".mp4"))
    vid = F.col("target_id")
    return t.select(
        vid.alias("video_id"), (vid * 13 % 900 + 1).alias("total_frames"), (F.lit(24) + vid % CAMPAIGN_SIZE % 7).alias("fps")
    )


def frame_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blur score of every frame of every video."""
    idx = F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_frames") - 1)).alias("frame_idx")
    return videos(spark, sf_dir).select("video_id", "total_frames", idx).withColumn(
        "blur_score", ((F.col("video_id") * 7 + F.floor(F.col("frame_idx") / 16) * 31) % 90).cast("double")
    )


def frame_pictures(sampled: DataFrame) -> DataFrame:
    """Histogram and thumbnail of sampled frames by formula; scenes repeat, so near duplicates occur."""
    scene = F.floor((F.col("video_id") * 5 + F.col("frame_idx")) / 150) % 4
    hist = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((i * (scene + 3) + F.col("video_id")) % 17).cast("double"))
    thumb = F.transform(
        F.sequence(F.lit(0), F.lit(1023)), lambda i: ((i * (scene + 1) * 7 + F.col("frame_idx") % 5 + F.col("video_id")) % 256).cast("double")
    )
    # a picture is far more work than its row is bytes
    dealt = sampled.repartition(many_tasks(sampled.sparkSession), "video_id")
    return dealt.select("video_id", "frame_idx", hist.alias("hist"), thumb.alias("thumb"))


def frame_vectors(spark: SparkSession, sf_dir: str, frames: DataFrame) -> DataFrame:
    """Vectors and media features of frames (video_id, frame_idx) of ``videos``: scenes of 100 frames near to or far from the theme."""
    own = targets(spark, sf_dir).drop("embedding", "video_id", "frame_idx", "frame_name", "filename", "expected_match").withColumnRenamed("target_id", "video_id")
    mixed = vectors(spark, sf_dir).select(F.col("vec_id").alias("video_id"), "theme", "e")
    f = F.col("frame_idx")
    weight = pick([0.2, 0.9, 0.6, 2.0, 1.2], F.floor(f / 100) % 5)
    return (
        frames.select("video_id", "frame_idx").join(own, "video_id").join(mixed, "video_id")
        .withColumn("frame_name", F.concat(F.lit("frame_"), F.col("video_id"), F.lit("_"), f, F.lit(".jpg")))
        .withColumn("embedding", mix(F.col("theme"), weight, F.col("e")))
        .drop("theme", "e")
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A posts sheet: pages with customer names as users, gaps and blanks included."""
    pages = table(spark, sf_dir, "pages")
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), "c_name")
    pid = F.col("page_id")
    return pages.join(users, "page_id", "left").select(
        pid.alias("row_index"),
        F.when(pid % 11 == 0, "  ").when(pid % 7 != 0, F.concat(F.lit(" "), F.col("c_name"))).alias("User Name"),
        F.when(pid % 13 == 0, " ").when(pid % 5 != 0, F.concat(F.col("url"), F.lit(" "))).alias("Post-URL"),
        F.length("html").alias("Size"),
    )


def media_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pid = F.col("page_id")
    stem = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.concat(stem, pick([".jpg", ".MP4", "", ".pdf", ".webm;v=1", "/.png"], pid % 6), pick(["", "?x=1.jpg", "#a.png"], pid % 3)).alias("url")
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A media tree derived from the vectors: one folder per campaign, different folder layouts."""
    v = vectors(spark, sf_dir)
    p, vid = F.col("p"), F.col("vec_id")
    folder = (
        F.when(F.col("role") == "reference", pick(["positive_refs/", "positives/", "refs/", "references/deep/", ""], p % 5))
        .when(F.col("role") == "competitor", pick(["hard_negatives/", "negatives/"], p % 2))
        .otherwise(F.when(vid % 4 == 0, "references/").when(vid % 4 == 1, "negatives/").otherwise("raw/"))
    )
    ext = pick(["jpg", "PNG", "mp4", "txt", "webp", "gif"], vid % 6)
    shade = F.when(vid % 10 == 3, F.upper(F.concat(F.lit("f_"), vid - 1))).otherwise(F.concat(F.lit("f_"), vid))
    path = F.concat(F.lit("/media/c"), F.col("campaign_id"), F.lit("/"), folder, shade, F.lit("."), ext)
    return v.select(path.alias("path"), (vid * 977 % 100000 + 1).alias("length"), (vid * 1000).alias("modified"))


def post_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of an influencer tree from customers; some lie outside a posts folder."""
    key = F.col("c_custkey")
    folder = F.when(key % 9 == 0, "drafts/").when(key % 10 == 0, "posts/old/").otherwise("posts/")
    return table(spark, sf_dir, "customer").select(
        F.concat(
            F.lit("data/"), F.regexp_replace("c_name", "#", "_"), F.lit("/"), F.lower("c_mktsegment"), F.lit("/"), folder, key,
            pick([".jpg", ".mp4", ".tar.gz", "", ".JPEG"], key % 5),
        ).alias("path")
    )


def outcomes(urls: DataFrame) -> DataFrame:
    """Fetch outcome per URL: direct media give one or two files, everything else an error; some URLs have no outcome."""
    from lumenmatch.functions.paths import is_direct_media, manifest_name

    ok, name = is_direct_media(F.col("url")), manifest_name(F.col("url"))
    two = F.length("url") % 2 == 0
    return urls.filter(F.length("url") % 7 != 0).select(
        "url",
        F.when(ok & two, F.array(name, F.concat(F.lit("alt_"), name))).when(ok, F.array(name)).alias("media_paths"),
        F.when(~ok, "yt-dlp not available").alias("error"),
    )


BRAND_TERMS = ["anble", "hetion", "ément", "clown", "clowm"]
HASHTAGS = ["#nthe", "#on the", "thing"]
KEYWORDS = ["that", "Reaux", "onst"]
PALETTE = ["#FF0000", "#00704A", "#1e3932", "#ffffff"]


def mention_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, term: the words of five letters or more of all benchmark items, and the first two words of each."""
    parts = F.split(F.regexp_replace("text", r"[^\p{L}]+", " "), " ")
    terms = F.concat(F.filter(parts, lambda w: F.length(w) >= 5), F.array(F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))))
    placed = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(terms).alias("i", "term")).filter(F.trim("term") != "")
    return placed.groupBy("term").agg(F.min(F.col("item_id") * 1000 + F.col("i")).cast("int").alias("pos"))


def ocr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("item_id"), F.col("turn").alias("seq"), "text", ((F.col("turn") * 3 + F.col("conv_id")) % 10 / 10).alias("conf")
    )


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("caption"))


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand per part, with aliases that repeat, hold blanks or go beyond ASCII."""
    p = F.col("p_partkey")
    alias = F.when(p % 3 == 0, F.concat(F.lit(" "), F.col("p_brand"), F.lit(" "))).when(p % 3 == 1, F.concat(F.lit("é"), F.col("p_name"))).otherwise("")
    return table(spark, sf_dir, "part").select(p.alias("brand_id"), F.array(F.col("p_brand"), F.col("p_name"), alias).alias("names"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cls = F.when(F.col("event_type") == "view", "brand logo").when(F.col("event_type") == "click", "store sign").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item_id"), "event_id", cls.alias("cls"), (F.col("value") / (F.col("value") + 200)).alias("conf")
    )


def colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three dominant colours per part."""
    p = F.col("p_partkey")
    k = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")
    c = table(spark, sf_dir, "part").select(p.alias("item_id"), "p_size", (F.col("p_retailprice") * 10).cast("long").alias("price"), k)
    return c.select(
        "item_id", ((F.col("price") * F.col("k")) % 256).cast("int").alias("r"), ((F.col("p_size") * 5 * F.col("k")) % 256).cast("int").alias("g"),
        ((F.col("item_id") * 37 + F.col("k") * 11) % 256).cast("int").alias("b"),
    )


def prompt_sims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt similarities of every target: its own vector components stand for the prompts."""
    t = targets(spark, sf_dir).select(F.col("target_id").alias("item_id"), F.posexplode("embedding").alias("prompt_idx", "x"))
    return t.select(
        "item_id", "prompt_idx", F.concat(F.lit("prompt "), F.col("prompt_idx")).alias("prompt"),
        F.when(F.col("prompt_idx") % 8 == 7, "negative").otherwise("brand").alias("prompt_kind"), (F.lit(0.2) + F.col("x") * 0.2).alias("sim"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows per user and layer from events."""
    layer = (
        F.when(F.col("event_type") == "view", "image").when(F.col("event_type") == "click", "prompt")
        .when(F.col("event_type") == "purchase", "caption").when(F.col("event_type") == "signup", "detection")
        .when(F.col("event_id") % 3 == 0, "color").otherwise("ocr")
    )
    item = F.concat_ws("-", "user_id", F.date_trunc("day", F.col("ts")).cast("date").cast("string"))
    e = table(spark, sf_dir, "events").select(item.alias("item_id"), layer.alias("layer"), (F.col("value") / (F.col("value") + 20)).alias("score"))
    weight = (
        F.when(F.col("layer") == "image", 4.0).when(F.col("layer") == "prompt", 0.8).when(F.col("layer") == "color", 0.3).otherwise(0.7)
    )
    return e.groupBy("item_id", "layer").agg(F.max("score").alias("score")).select(
        "item_id", "layer", "score", (F.col("score") > 0.75).alias("fired"), weight.alias("weight")
    )
