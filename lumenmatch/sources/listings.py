"""Media listings: reference files, campaign roles, targets, influencer posts, fingerprints.

A listing is (path, length, modified). ``list_media`` reads it from a file system without touching file content; every
other function works on any listing DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmatch.functions.paths import REFERENCE_EXTS, SUPPORTED_EXTS, basename, digest_parts, extension
from lumenmatch.sources.folders import list_files

# Role directories in order of preference.
POSITIVE_DIRS = ("positive_refs", "positives", "refs", "references")
NEGATIVE_DIRS = ("hard_negatives", "negatives")


def read_listing(spark: SparkSession, root: str) -> DataFrame:
    """Listing of a folder, walked in tasks; no file's status passes through the driver."""
    return list_files(spark, root)


def unique_files(listing: DataFrame, exts=REFERENCE_EXTS) -> DataFrame:
    """Files with a listed extension; of paths equal up to case only the first in path order is kept."""
    kept = listing.filter(extension(F.col("path")).isin(*exts))
    first = F.min_by(F.struct(*[c for c in listing.columns]), "path")
    return kept.groupBy(F.lower("path").alias("_k")).agg(first.alias("f")).select("f.*")


def list_media(spark: SparkSession, root: str, exts=REFERENCE_EXTS) -> DataFrame:
    return unique_files(read_listing(spark, root), exts)


def list_targets(listing: DataFrame) -> DataFrame:
    """Targets: the twelve image and video extensions."""
    ext = F.lower(F.substring_index("path", ".", -1))
    return listing.filter(F.contains("path", F.lit(".")) & ext.isin(*SUPPORTED_EXTS))


def below(root: str) -> Column:
    """Path below a folder; null outside of it. The folder's name is taken as it is, not as a pattern."""
    prefix = f"{root.rstrip('/')}/"
    return F.when(F.startswith("path", F.lit(prefix)), F.substring("path", len(prefix) + 1, 2147483647))


def campaign_files(listing: DataFrame, root: str) -> DataFrame:
    """Reference image files anywhere in a campaign's folder, with the campaign."""
    parts = F.split(below(root), "/")
    return unique_files(listing).withColumn("campaign", F.when(F.size(parts) > 1, F.get(parts, F.lit(0)))).filter("campaign is not null")


def _preference(folder: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(None).cast("int")
    for rank, name in reversed(list(enumerate(names))):
        out = F.when(folder == name, rank).otherwise(out)
    return out


def resolve_roles(listing: DataFrame, root: str) -> DataFrame:
    """(campaign, path, role): files of the winning positive and negative folder of each campaign.

    Without a positive folder the whole campaign folder is positive, its negative folder included.
    """
    parts = F.split(below(root), "/")
    df = listing.filter(below(root).isNotNull()).withColumn("campaign", F.get(parts, F.lit(0))).withColumn(
        "_folder", F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise("")
    ).filter(F.size(parts) > 1)
    best = df.groupBy("campaign").agg(
        F.min(_preference(F.col("_folder"), POSITIVE_DIRS)).alias("_pos"), F.min(_preference(F.col("_folder"), NEGATIVE_DIRS)).alias("_neg")
    )
    df = df.join(best, "campaign")
    positive = F.col("_pos").isNull() | (_preference(F.col("_folder"), POSITIVE_DIRS) == F.col("_pos"))
    negative = _preference(F.col("_folder"), NEGATIVE_DIRS) == F.col("_neg")
    roles = F.array_compact(F.array(F.when(positive, "positive"), F.when(negative, "negative")))
    return df.select(*listing.columns, "campaign", F.explode(roles).alias("role"))


def scan_posts(listing: DataFrame, base: str) -> DataFrame:
    """Files at base/<influencer>/<platform>/posts/<file>."""
    parts = F.split(below(base), "/")
    named = F.forall(parts, lambda x: x != "")
    return listing.filter((F.size(parts) == 4) & (F.get(parts, F.lit(2)) == "posts") & named).select(
        F.get(parts, F.lit(0)).alias("influencer"), F.get(parts, F.lit(1)).alias("platform"), "path"
    )


def bank_fingerprint(listing: DataFrame, key: str = "campaign") -> DataFrame:
    """Order-free digest of name, size and modification time of all files of a campaign; equal entries count each."""
    entry = F.concat_ws(":", basename(F.col("path")), F.col("length"), F.col("modified").cast("string"))
    a, b = digest_parts(entry)
    return listing.groupBy(key).agg(
        F.count("*").alias("n_files"), F.md5(F.concat_ws(":", F.count("*"), F.sum(a), F.sum(b)).cast("binary")).alias("fingerprint")
    )
