"""Frame sampling plans, the blur gate with sharper neighbours, and near-duplicate suppression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenmatch.session import many_tasks

# Fixed values of the frame rules.
INTERVAL_SECONDS = 2.0
EVEN_FRAMES = 6
MAX_KEPT = 15
BLUR_LIMIT = 40.0
NEIGHBOUR_OFFSETS = (-5, -2, 2, 5)
SAME_HISTOGRAM = 0.98
SAME_STRUCTURE = 0.05
LOOK_BACK = 3
THUMB_PIXELS = 1024


def sample_interval(videos: DataFrame, seconds: float = INTERVAL_SECONDS) -> DataFrame:
    """First, last and every ``int(fps * seconds)``-th frame of each (video_id, total_frames, fps)."""
    n = F.col("total_frames")
    step = F.greatest(F.lit(1), F.floor(F.col("fps") * seconds)).cast("long")
    frames = F.array_union(F.sequence(F.lit(0).cast("long"), n - 1, step), F.array(n - 1))
    return videos.filter((n > 0) & (F.col("fps") > 0)).select("video_id", "total_frames", F.explode(frames).alias("frame_idx"))


def sample_even(videos: DataFrame, max_frames: int = EVEN_FRAMES) -> DataFrame:
    """All frames of short videos, else first, last and evenly spaced ones."""
    n = F.col("total_frames")
    spaced = F.transform(
        F.sequence(F.lit(0), F.lit(max_frames - 1)),
        lambda i: F.when(i == max_frames - 1, n - 1).otherwise(F.floor((n - 1) / (max_frames - 1) * i)),
    )
    frames = F.when(n <= max_frames, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array_distinct(spaced))
    return videos.filter(n > 0).select("video_id", "total_frames", F.explode(frames).alias("frame_idx"))


def replace_blurry(frames: DataFrame, features: DataFrame, limit: float = BLUR_LIMIT) -> DataFrame:
    """(video_id, frame_idx, use_idx): the first sharp neighbour in offset order for each given frame, if any."""
    offsets = F.posexplode(F.array(*[F.lit(o) for o in NEIGHBOUR_OFFSETS])).alias("_order", "_offset")
    wanted = frames.select("video_id", "frame_idx", "total_frames", offsets).withColumn("use_idx", F.col("frame_idx") + F.col("_offset"))
    inside = wanted.filter((F.col("use_idx") >= 0) & (F.col("use_idx") < F.col("total_frames")))
    sharp = features.filter(F.col("blur_score") >= limit).select("video_id", F.col("frame_idx").alias("use_idx"))
    return inside.join(sharp, ["video_id", "use_idx"]).groupBy("video_id", "frame_idx").agg(F.min_by("use_idx", "_order").alias("use_idx"))


def blur_filter(frames: DataFrame, features: DataFrame, limit: float = BLUR_LIMIT) -> DataFrame:
    """Blurry inner frames take a sharper neighbour, or are dropped below half the limit when there is none."""
    scored = frames.join(features.select("video_id", "frame_idx", "blur_score"), ["video_id", "frame_idx"])
    inner = (F.col("frame_idx") != 0) & (F.col("frame_idx") != F.col("total_frames") - 1)
    blurry = inner & (F.col("blur_score") < limit)
    found = replace_blurry(scored.filter(blurry), features, limit)
    return (
        scored.join(found, ["video_id", "frame_idx"], "left")
        .filter(~(blurry & F.col("use_idx").isNull() & (F.col("blur_score") < limit * 0.5)))
        .withColumn("replaced", F.col("use_idx").isNotNull())
        .withColumn("use_idx", F.coalesce("use_idx", "frame_idx"))
    )


def frame_diff(a: Column, b: Column) -> Column:
    """Mean absolute difference of two 32x32 grey thumbnails, scaled to [0, 1]."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x)
    return total / THUMB_PIXELS / 255.0


def histogram_correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two histograms; 1 when either is constant."""
    def total(v):
        return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)

    def of(pair):
        x, y, n = pair["x"], pair["y"], F.size(pair["x"])
        mx, my = total(x) / n, total(y) / n
        sxy = total(F.zip_with(x, y, lambda p, q: p * q)) - n * mx * my
        sxx = total(F.transform(x, lambda p: p * p)) - n * mx * mx
        syy = total(F.transform(y, lambda q: q * q)) - n * my * my
        return F.when(F.abs(sxx * syy) > 2.220446049250313e-16, sxy / F.sqrt(sxx * syy)).otherwise(1.0)

    return F.transform(F.array(F.struct(a.alias("x"), b.alias("y"))), of)[0]


KEPT = "video_id long, frame_idx long, kept_order int"


def _correlations(last: np.ndarray, hists: np.ndarray) -> np.ndarray:
    """Correlation of one histogram with each of several; 1 where one of them is flat."""
    n = len(last)
    sxy = hists @ last - n * hists.mean(axis=1) * last.mean()
    scale = ((last * last).sum() - n * last.mean() ** 2) * ((hists * hists).sum(axis=1) - n * hists.mean(axis=1) ** 2)
    some = np.abs(scale) > 2.220446049250313e-16
    return np.where(some, sxy / np.sqrt(np.where(some, np.abs(scale), 1.0)), 1.0)


class _Kept:
    """What later decisions of a video depend on: how many frames are kept and the last ``LOOK_BACK`` of them."""

    def __init__(self, video: int):
        self.video, self.n, self.recent = video, 0, []

    def next(self, hists: np.ndarray, thumbs: np.ndarray) -> int | None:
        """Place of the first of these frames that is no copy of a kept one."""
        new = np.ones(len(hists), bool)
        if self.recent:
            new &= ~(_correlations(self.recent[-1][0], hists) > SAME_HISTOGRAM)
            for _, thumb in self.recent:
                new &= ~(np.abs(thumbs - thumb).sum(axis=1) / THUMB_PIXELS / 255.0 < SAME_STRUCTURE)
        return int(np.argmax(new)) if new.any() else None

    def keep(self, hist: np.ndarray, thumb: np.ndarray) -> int:
        self.recent = [*self.recent, (hist, thumb)][-LOOK_BACK:]
        self.n += 1
        return self.n - 1


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def dedupe_frames(features: DataFrame, max_kept: int = MAX_KEPT, batch: int | None = None) -> DataFrame:
    """Frames kept after near-duplicate suppression: (video_id, frame_idx, kept_order).

    A frame is skipped when its histogram equals the last kept one or its thumbnail one of the last three kept ones.
    Which frames count as kept depends on earlier decisions, so this is not a window. Features are (video_id,
    frame_idx, hist, thumb) of the sampled frames; all histograms have one length, and all thumbnails.

    Each task streams its videos in frame order, in Arrow batches (of at most ``batch`` frames, if given). A video of any
    length leaves the last three kept frames and a count from one batch to the next, and nothing else.
    """
    slim = features.select(F.col("video_id").cast("long").alias("video_id"), F.col("frame_idx").cast("long").alias("frame_idx"), "hist", "thumb")
    target = pa.schema([("video_id", pa.int64()), ("frame_idx", pa.int64()), ("kept_order", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for whole in batches:
            for at in range(0, whole.num_rows, batch or max(1, whole.num_rows)):
                part = whole.slice(at, batch or whole.num_rows)
                video, frame = (part.column(c).to_numpy() for c in ("video_id", "frame_idx"))
                hists, thumbs = _matrix(part.column("hist")), _matrix(part.column("thumb"))
                out: list[tuple[int, int, int]] = []
                starts = np.flatnonzero(np.append(True, video[1:] != video[:-1]))
                for a, b in zip(starts, [*starts[1:], len(video)]):
                    if state is None or state.video != video[a]:
                        state = _Kept(video[a])
                    while a < b and state.n < max_kept and (step := state.next(hists[a:b], thumbs[a:b])) is not None:
                        a += step
                        out.append((video[a], frame[a], state.keep(hists[a].copy(), thumbs[a].copy())))
                        a += 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

    return slim.repartition(many_tasks(slim.sparkSession), "video_id").sortWithinPartitions("video_id", "frame_idx").mapInArrow(run, KEPT)
