"""Post tables: column resolution, cleaning, target union, fetch outcomes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenmatch.functions.text import strip

# Column keywords, in order of priority.
USER_KEYS = (
    "username", "user", "user_name", "handle", "influencer", "creator", "account", "account_name", "author", "profile", "name",
)
LINK_KEYS = (
    "link", "url", "post", "post_url", "post_link", "media", "media_url", "media_link", "permalink", "share_url",
    "video_url", "image_url",
)
UNKNOWN_USER = "Unknown"
NO_OUTCOME = "no fetch outcome"


def normalize_column(name: str | None) -> str:
    """Heading as a keyword: lower case, parts joined by underscores, other signs left out."""
    parts = re.split(r"[\s-]+", (name or "").strip().casefold())
    return "_".join("".join(c for c in part if c == "_" or (c.isascii() and c.isalnum())) for part in parts)


def resolve_column(columns: list[str], requested: str | None, keywords: tuple[str, ...]) -> str | None:
    """Requested name, else exact keyword, else first column containing a keyword."""
    by_name = {normalize_column(c): c for c in columns}
    exact = [k for k in (normalize_column(requested), *keywords) if k and k in by_name]
    if exact:
        return by_name[exact[0]]
    return next((original for norm, original in by_name.items() if any(k in norm for k in keywords)), None)


def load_posts(df: DataFrame, username_col: str | None = None, link_col: str | None = None, row_index: str = "row_index") -> DataFrame:
    """(username, link, row_index) of rows with a link; missing users become ``Unknown``.

    ``row_index`` names the source's own row number column.
    """
    names = [c for c in df.columns if c != row_index]
    user, link = resolve_column(names, username_col, USER_KEYS), resolve_column(names, link_col, LINK_KEYS)
    if user is None or link is None:
        if df.isEmpty():
            return df.sparkSession.createDataFrame([], "username string, link string, row_index long")
        raise ValueError(f"no {'user' if user is None else 'link'} column among {names}")
    return (
        df.select(
            F.coalesce(F.nullif(strip(F.col(f"`{user}`").cast("string")), F.lit("")), F.lit(UNKNOWN_USER)).alias("username"),
            strip(F.col(f"`{link}`").cast("string")).alias("link"),
            F.col(row_index).cast("long").alias("row_index"),
        )
        .filter(F.col("link").isNotNull() & (F.col("link") != ""))
    )


def union_targets(files: DataFrame, posts: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Files and posts as one target table; the fallback scan is used only when both are empty."""
    targets = files.select(F.lit("file").alias("type"), "path").unionByName(
        posts.select(F.lit("url").alias("type"), "username", F.col("link").alias("url")), allowMissingColumns=True
    )
    if fallback is not None and targets.isEmpty():
        return fallback.select(F.lit("file").alias("type"), "path", F.lit(None).cast("string").alias("username"), F.lit(None).cast("string").alias("url"))
    return targets


def expand_media(targets: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per fetched media file of every URL target; files pass through. URLs without a file have an error row in
    ``attach_fetch_errors`` instead."""
    urls = targets.filter("type = 'url'").join(outcomes.filter("error is null").select("url", "media_paths"), "url")
    fetched = urls.select("type", F.explode("media_paths").alias("path"), "username", F.col("url").alias("source_url"))
    files = targets.filter("type = 'file'").select("type", "path", "username", F.col("url").alias("source_url"))
    return files.unionByName(fetched)


def attach_fetch_errors(targets: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Default NO_MATCH rows for URL targets whose fetch failed, gave no file or has no outcome at all."""
    known = outcomes.select("url", "error", (F.coalesce(F.size("media_paths"), F.lit(0)) > 0).alias("_found"))
    failed = targets.filter("type = 'url'").join(known, "url", "left").filter("error is not null or not coalesce(_found, false)")
    failed = failed.withColumn("error", F.coalesce("error", F.lit(NO_OUTCOME)))
    return failed.select(
        F.lit(False).alias("campaign_match"), F.lit("NO_MATCH").alias("match_type"), F.lit("Irrelevant").alias("verdict"),
        F.lit(0.0).alias("confidence"), F.lit("").alias("file"), F.lit("").alias("filename"), "username",
        F.col("url").alias("source_url"), "error",
    )
