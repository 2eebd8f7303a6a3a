"""Score series: spike suppression, smoothing, continuity, stable segments, temporal strength.

A series is (seq_id, idx, score); seq_id may be a struct, idx any increasing numbers with gaps. Steps go by the position of
a row in its series (``pos`` = 0..n-1), which ``numbered`` adds unless the series has it. Runs may go by a column ``at`` of
other whole numbers instead, in which a gap ends a run. All steps work on chunks of these numbers, so one very long series is
spread over many tasks; only runs that touch a chunk border and three candidates per chunk are brought together per series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenmatch.functions.scoring import clamp01, r4
from lumenmatch.operators.positions import CHUNK, dense_positions, with_halo

# Fixed values of the sequence rules.
KERNEL5 = (0.1, 0.2, 0.4, 0.2, 0.1)
SPIKE_MARGIN = 0.18
EDGE_FACTOR = 1.5
KEEP_EXCESS = 0.05
TOP_FRAMES = 3


def numbered(series: DataFrame) -> DataFrame:
    """Adds ``pos``, the position by idx in the series, unless it is there."""
    return series if "pos" in series.columns else dense_positions(series, ["seq_id"], ["idx"], F.floor(F.col("idx") / CHUNK), "pos")


def bartlett_kernel(width: int) -> tuple[float, ...]:
    """Normalised triangular weights for an odd width of at least 3; width 5 has its own fixed weights."""
    if width < 3 or width % 2 == 0:
        raise ValueError("the kernel width must be odd and at least 3")
    if width == 5:
        return KERNEL5
    half = (width - 1) / 2
    raw = [1.0 - abs(i - half) / half for i in range(width)]
    return tuple(w / sum(raw) for w in raw)


def _suppressed(score: Column, pos: Column, w, margin: float) -> Column:
    left, right = F.lag(score).over(w), F.lead(score).over(w)
    middle = (left + right) / 2.0
    has_third = (pos >= 2) | ((pos == 1) & right.isNotNull()) | F.lead(score, 2).over(w).isNotNull()
    edge = margin * EDGE_FACTOR
    return (
        F.when(~has_third, score)
        .when((score - left > margin) & (score - right > margin), middle + KEEP_EXCESS * (score - middle))
        .when(left.isNull() & (score - right > edge), right + KEEP_EXCESS * (score - right))
        .when(right.isNull() & (score - left > edge), left + KEEP_EXCESS * (score - left))
        .otherwise(score)
    )


def _smoothed(score: Column, pos: Column, w, kernel: tuple[float, ...]) -> Column:
    half = len(kernel) // 2
    total, weights = F.lit(0.0), F.lit(0.0)
    for k, weight in enumerate(kernel):
        shift = k - half
        value = score if shift == 0 else (F.lead(score, shift).over(w) if shift > 0 else F.lag(score, -shift).over(w))
        total = total + F.coalesce(value * weight, F.lit(0.0))
        weights = weights + F.when(value.isNotNull(), weight).otherwise(0.0)
    has_third = (pos >= 2) | ((pos == 1) & F.lead(score).over(w).isNotNull()) | F.lead(score, 2).over(w).isNotNull()
    return F.when(has_third, total / weights).otherwise(score)


def _chunk_window():
    return Window.partitionBy("seq_id", "_chunk").orderBy("pos")


def suppress_spikes(series: DataFrame, margin: float = SPIKE_MARGIN, chunk: int = CHUNK) -> DataFrame:
    """Adds ``suppressed``: isolated peaks are pulled to their raw neighbours; series shorter than 3 pass through."""
    w = _chunk_window()
    return (
        with_halo(numbered(series), "pos", 2, 2, chunk)
        .withColumn("suppressed", _suppressed(F.col("score"), F.col("pos"), w, margin))
        .filter("_own")
        .drop("_chunk", "_own")
    )


def smooth(series: DataFrame, window: int = 5, source: str = "score", chunk: int = CHUNK) -> DataFrame:
    """Adds ``smoothed``: weighted mean with weights renormalised at the ends; series shorter than 3 pass through."""
    kernel, w = bartlett_kernel(window), _chunk_window()
    half = max(2, window // 2)
    return (
        with_halo(numbered(series), "pos", half, half, chunk)
        .withColumn("smoothed", _smoothed(F.col(source), F.col("pos"), w, kernel))
        .filter("_own")
        .drop("_chunk", "_own")
    )


def suppress_and_smooth(series: DataFrame, window: int = 5, margin: float = SPIKE_MARGIN, chunk: int = CHUNK) -> DataFrame:
    """Both steps over one exchange and one sort."""
    kernel, w = bartlett_kernel(window), _chunk_window()
    half = max(2, window // 2) + 2
    return (
        with_halo(numbered(series), "pos", half, half, chunk)
        .withColumn("suppressed", _suppressed(F.col("score"), F.col("pos"), w, margin))
        .withColumn("smoothed", _smoothed(F.col("suppressed"), F.col("pos"), w, kernel))
        .filter("_own")
        .drop("_chunk", "_own")
    )


def stable_segments(series: DataFrame, threshold: Column, source: str = "score", chunk: int = CHUNK, at: str = "pos") -> DataFrame:
    """Runs of consecutive rows (by ``at``) at or above the threshold: idx of the first and the last one, length, mean score."""
    hit = numbered(series).filter(F.col(source) >= threshold).select(
        "seq_id", "idx", F.col(at).alias("pos"), F.col(source).alias("_s"), F.floor(F.col(at) / chunk).alias("_chunk")
    )
    ends = [F.min("idx").alias("start_frame"), F.max("idx").alias("end_frame")]
    runs = (
        hit.withColumn("_island", F.col("pos") - F.row_number().over(_chunk_window()))
        .groupBy("seq_id", "_chunk", "_island")
        .agg(*ends, F.min("pos").alias("_from"), F.max("pos").alias("_to"), F.sum("_s").alias("_sum"))
        .drop("_chunk", "_island")
    )
    # only a run on a chunk border can continue in the neighbour chunk
    on_border = (F.col("_from") % chunk == 0) | (F.col("_to") % chunk == chunk - 1)
    by_start = Window.partitionBy("seq_id").orderBy("_from")
    fresh = F.coalesce(F.col("_from") != F.lag("_to").over(by_start) + 1, F.lit(True))
    joined = (
        runs.filter(on_border)
        .withColumn("_fresh", fresh.cast("long"))
        .withColumn("_group", F.sum("_fresh").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("seq_id", "_group")
        .agg(
            F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.min("_from").alias("_from"),
            F.max("_to").alias("_to"), F.sum("_sum").alias("_sum"),
        )
        .drop("_group")
    )
    length = F.col("_to") - F.col("_from") + 1
    return runs.filter(~on_border).unionByName(joined).select(
        "seq_id", "start_frame", "end_frame", length.alias("duration_frames"), r4(F.col("_sum") / length).alias("average_score")
    )


def _chunk_runs(series: DataFrame, threshold: Column, source: str, chunk: int, at: str) -> DataFrame:
    """Per series and chunk, in one grouping: rows, longest run, the run at each border and the best TOP_FRAMES values."""
    w = _chunk_window()
    value = F.col(source)
    cut = numbered(series).select("seq_id", F.col(at).alias("pos"), value.alias("_s"), (value >= threshold).alias("_hit"), F.floor(F.col(at) / chunk).alias("_chunk"))
    runs = cut.withColumn(
        "_island", F.when(F.col("_hit"), F.col("pos") - F.sum(F.col("_hit").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ).withColumn("_rank", F.row_number().over(Window.partitionBy("seq_id", "_chunk").orderBy(F.desc("_s"))))
    islands = runs.groupBy("seq_id", "_chunk", "_island").agg(
        F.count("*").alias("_n"), F.min("pos").alias("_from"), F.max("pos").alias("_to"),
        F.collect_list(F.when(F.col("_rank") <= TOP_FRAMES, F.col("_s"))).alias("_top"),
    )
    hit = F.col("_island").isNotNull()
    return islands.groupBy("seq_id", "_chunk").agg(
        F.sum("_n").alias("n"), F.max(F.when(hit, F.col("_n"))).alias("longest"),
        F.max(F.when(hit & (F.col("_from") % chunk == 0), F.col("_n"))).alias("head"),
        F.max(F.when(hit & (F.col("_to") % chunk == chunk - 1), F.col("_n"))).alias("tail"),
        F.flatten(F.collect_list("_top")).alias("top"),
    )


def _series_runs(series: DataFrame, threshold: Column, source: str, chunk: int, at: str = "pos") -> DataFrame:
    """Rows, longest run and the mean of the best TOP_FRAMES values of each series, from one row per chunk."""
    parts = F.sort_array(F.collect_list(F.struct("_chunk", "n", F.coalesce("longest", F.lit(0)).alias("longest"), F.coalesce("head", F.lit(0)).alias("head"), F.coalesce("tail", F.lit(0)).alias("tail"))))
    grouped = _chunk_runs(series, threshold, source, chunk, at).groupBy("seq_id").agg(parts.alias("parts"), F.slice(F.sort_array(F.flatten(F.collect_list("top")), False), 1, TOP_FRAMES).alias("top"))
    zero = F.lit(0).cast("long")

    def add(state, c):
        # a run goes on from the chunk before, if there is one, into this one's head
        whole = c["head"] == chunk
        joined = F.when(c["_chunk"] == state["chunk"] + 1, state["open"]).otherwise(zero) + c["head"]
        return F.struct(
            (state["n"] + c["n"]).alias("n"), F.greatest(state["longest"], c["longest"], joined).alias("longest"), F.when(whole, joined).otherwise(c["tail"]).alias("open"),
            c["_chunk"].alias("chunk"),
        )

    total = F.aggregate("parts", F.struct(zero.alias("n"), zero.alias("longest"), zero.alias("open"), zero.alias("chunk")), add)
    mean = F.aggregate("top", F.lit(0.0), lambda a, x: a + x) / F.size("top")
    return grouped.select("seq_id", total.alias("t"), mean.alias("top_mean")).select("seq_id", "t.n", F.col("t.longest").alias("longest_streak"), "top_mean")


def _with_continuity(df: DataFrame) -> DataFrame:
    ratio = F.col("longest_streak") / F.col("n")
    score = F.when(F.col("longest_streak") > 0, 0.6 * F.least(F.lit(1.0), F.col("longest_streak") / 4.0) + 0.4 * ratio).otherwise(0.0)
    return df.withColumn("streak_ratio", r4(ratio)).withColumn("frame_continuity_score", r4(score))


def continuity(series: DataFrame, threshold: Column, source: str = "score", chunk: int = CHUNK, at: str = "pos") -> DataFrame:
    """Longest run (by ``at``), its share of the series and the continuity score, one row per series."""
    return _with_continuity(_series_runs(series, threshold, source, chunk, at)).select("seq_id", "n", "longest_streak", "streak_ratio", "frame_continuity_score")


def top_mean(series: DataFrame, source: str, chunk: int = CHUNK) -> DataFrame:
    """Mean of the TOP_FRAMES highest values per series: the best per chunk first, then the best of those."""
    return _series_runs(series, F.lit(0.0), source, chunk).select("seq_id", "top_mean")


def temporal_strength(smoothed: DataFrame, threshold: Column, source: str = "smoothed", chunk: int = CHUNK, at: str = "pos") -> DataFrame:
    """Continuity plus 0.7 * top-3 mean + 0.3 * continuity score, one row per series; runs and best values in one pass."""
    df = _with_continuity(_series_runs(smoothed, threshold, source, chunk, at))
    strength = clamp01(F.col("top_mean") * 0.7 + F.col("frame_continuity_score") * 0.3)
    return df.withColumn("temporal_strength", r4(strength)).drop("top_mean")


def best_until_confident(frames: DataFrame, max_frames: int = 6, confident: float = 85.0) -> DataFrame:
    """Best frame verdict when a scan of the first ``max_frames`` frames stops at the first confident hit.

    Expects seq_id, idx, verdict, confidence; other columns go along. The highest confidence wins, the earliest on ties. Only the first
    ``max_frames`` rows matter, so the group is cut before anything else; everything after is an aggregate.
    """
    place = F.row_number().over(Window.partitionBy("seq_id").orderBy("idx"))
    early = frames.withColumn("_place", place).filter(F.col("_place") <= max_frames).drop("_place")
    hit = (F.col("verdict") == "Relevant") & (F.col("confidence") >= confident)
    first_hit = Window.partitionBy("seq_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(hit.cast("int")).over(first_hit), F.lit(0))
    kept = early.withColumn("_seen", seen).filter(F.col("_seen") == 0)
    others = [c for c in frames.columns if c not in ("seq_id", "idx", "verdict", "confidence")]
    best = F.max_by(F.struct("idx", "verdict", "confidence", *others), F.struct("confidence", -F.col("idx")))
    return kept.groupBy("seq_id").agg(F.count("*").alias("n_scanned"), best.alias("b")).select("seq_id", "n_scanned", "b.*")
