"""Materialised banks, reused while their content is unchanged.

Every campaign has a content fingerprint; a campaign is rebuilt only when its fingerprint is not stored yet or a rebuild is
forced. A build is a folder of its own in each of the tables ``members``, ``packs`` and ``stats``, so builders that run at the
same time don't meet. Its ``stats`` folder is written last and in one commit: it is the manifest that makes the build readable,
so tables left by a job that died midway are never read. Of several builds of one content the latest is read;
``remove_unread`` deletes the others.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmatch.operators.banks import KEY
from lumenmatch.operators.similarity import PackSize, measure
from lumenmatch.plans.banks import bank_members, bank_packs, bank_stats
from lumenmatch.session import staged


@dataclass(frozen=True)
class Banks:
    """``stats``: one row per campaign. ``packs``: blocks of vectors. ``members``: cluster of each reference."""

    stats: DataFrame
    packs: DataFrame
    members: DataFrame
    size: PackSize


def content_fingerprint(bank: DataFrame, neg: DataFrame) -> DataFrame:
    """Order-free content hash per campaign over both banks (algebraic, so partially aggregated before the shuffle)."""
    rows = bank.select(KEY, F.xxhash64(F.lit("+"), "ref_id", "ref_name", "embedding").alias("h")).unionByName(
        neg.select(KEY, F.xxhash64(F.lit("-"), "neg_id", "neg_name", "embedding").alias("h"))
    )
    first, mixed = F.col("h").cast("decimal(20,0)"), F.xxhash64("h").cast("decimal(20,0)")
    return rows.groupBy(KEY).agg(F.count("*").alias("n"), F.sum(first).alias("a"), F.sum(mixed).alias("b")).select(
        KEY, F.md5(F.concat_ws(":", "n", "a", "b")).alias("fingerprint")
    )


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _latest(stats: DataFrame, *keys: str) -> DataFrame:
    """The build that is read; of builds of one moment the larger name."""
    return stats.groupBy(*keys).agg(F.max(F.struct("built_at", "build"))["build"].alias("build"))


def materialize_banks(bank: DataFrame, neg: DataFrame, root: str, force: bool = False) -> Banks:
    spark = bank.sparkSession
    current = content_fingerprint(bank, neg)
    known = _stored(spark, f"{root}/stats")
    stale = current if known is None or force else current.join(known, [KEY, "fingerprint"], "left_anti")
    if not stale.isEmpty():
        build = f"b{uuid.uuid4().hex}"
        stale, bank, neg = stale.persist(), bank.join(stale, KEY, "left_semi").persist(), neg.join(stale, KEY, "left_semi").persist()

        def write(name: str, table: DataFrame) -> None:
            table.withColumn("built_at", F.current_timestamp()).write.parquet(f"{root}/{name}/build={build}")

        # the clusters are found once: packs and statistics read the written assignments
        write("members", bank_members(bank))
        members = spark.read.parquet(f"{root}/members/build={build}").drop("built_at")
        write("packs", bank_packs(bank, neg, members))
        write("stats", bank_stats(bank, neg, members).join(stale, KEY))
        for used in (stale, bank, neg):
            used.unpersist()
        known = spark.read.parquet(f"{root}/stats")
    # written once, so that later queries read the chosen builds and do not fingerprint the raw banks again
    latest = staged(_latest(known.join(current, [KEY, "fingerprint"], "left_semi"), KEY), "builds")
    # folders of other builds are not opened, so their removal disturbs no reader
    pick, builds = [KEY, "build"], [r["build"] for r in latest.select("build").distinct().collect()]
    stats, packs, members = (
        spark.read.parquet(f"{root}/{n}").filter(F.col("build").isin(builds)).join(latest, pick, "left_semi").drop("build", "built_at") for n in ("stats", "packs", "members")
    )
    return Banks(stats, packs, members, measure(packs))


def bank_builds(spark: SparkSession, root: str) -> DataFrame:
    """Per campaign of a store: how often it was built, and the references of its last build."""
    return spark.read.parquet(f"{root}/stats").groupBy(KEY).agg(F.countDistinct("build").alias("builds"), F.max_by("n_refs", "built_at").alias("n_refs"))


def remove_unread(spark: SparkSession, root: str, hours: float = 24.0) -> list[str]:
    """Deletes builds that no campaign's content reads any more, and unfinished ones older than ``hours`` (a younger one may
    still be written). Returns their names. Manifests go first, so a half-deleted build isn't read either."""
    stats = _stored(spark, f"{root}/stats")
    read = set() if stats is None else {r["build"] for r in _latest(stats, KEY, "fingerprint").select("build").distinct().collect()}
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone: dict[str, None] = {}
    finished = set()
    for name in ("stats", "packs", "members"):
        if not files.exists(path(f"{root}/{name}")):
            continue
        for folder in files.listStatus(path(f"{root}/{name}")):
            build = folder.getPath().getName().removeprefix("build=")
            if name == "stats":
                finished.add(build)
            old = time.time() - folder.getModificationTime() / 1000 >= hours * 3600
            if build not in read and (build in finished or old):
                files.delete(folder.getPath(), True)
                gone[build] = None
    return list(gone)


def bank_readiness(campaigns: DataFrame, banks: Banks) -> DataFrame:
    """Per listed campaign: references, competitors and whether targets can be scored at all."""
    known = banks.stats.select(KEY, "n_refs", "n_negs")
    return campaigns.select(KEY).distinct().join(known, KEY, "left").fillna(0, ["n_refs", "n_negs"]).withColumn("ready", F.col("n_refs") > 0)
