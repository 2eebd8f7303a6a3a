"""Quality by compression: dictionaries of good and bad texts, and the calibrated difference of compressed sizes."""

from __future__ import annotations

import math

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenmatch.llm.arrow import fields, map_batches

#: Bounds of the fit: labelled rows of each class for a dictionary, further ones for the calibration, and the largest text
#: (bytes) among them. Scoring has no bound.
SAMPLE, CALIBRATION, LARGEST = 2000, 500, 32768
#: Bytes of a dictionary, length and hashed bytes of its segments, compression level.
SIZE, SEGMENT, HASHED, LEVEL = 110 << 10, 200, 8, 3


class Model:
    """Two dictionaries and the line that turns a difference into odds; a few hundred kilobytes."""

    def __init__(self, bad: bytes, good: bytes, slope: float, shift: float):
        self.dictionaries, self.slope, self.shift = (bad, good), slope, shift
        self._open()

    def __getstate__(self):
        return self.dictionaries, self.slope, self.shift

    def __setstate__(self, state):
        self.dictionaries, self.slope, self.shift = state
        self._open()

    def _open(self) -> None:
        self.compressors = []
        for raw in self.dictionaries:
            known = zstandard.ZstdCompressionDict(raw)
            known.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False))

    def difference(self, text: bytes) -> float:
        """How much smaller the good dictionary makes a text than the bad one, as a share of both sizes: -1 to 1."""
        bad, good = (len(c.compress(text)) for c in self.compressors)
        return (bad - good) / (bad + good)

    def score(self, text: bytes) -> float:
        x = self.slope * self.difference(text) + self.shift
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of SIZE bytes at most; too few texts for training serve as they are."""
    total = sum(map(len, texts))
    if len(texts) >= 20 and total > 8 * SEGMENT * 20:
        try:
            return zstandard.train_dictionary(min(SIZE, total // 4), texts, k=SEGMENT, d=HASHED).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(texts)[:SIZE]


def fit_line(points: list[tuple[float, int, float]]) -> tuple[float, float]:
    """Slope and shift of the logistic line over (difference, label, weight), by Newton steps with a weak pull to (30, 0)."""
    slope, shift, pull = 30.0, 0.0, 1e-4
    for _ in range(50):
        gs, gt, hss, hst, htt = pull * (slope - 30), pull * shift, pull, 0.0, pull
        for x, label, w in points:
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, slope * x + shift))))
            r, v = w * (p - label), w * p * (1 - p)
            gs, gt = gs + r * x, gt + r
            hss, hst, htt = hss + v * x * x, hst + v * x, htt + v
        det = hss * htt - hst * hst
        step_s, step_t = (htt * gs - hst * gt) / det, (hss * gt - hst * gs) / det
        size = max(1.0, abs(step_s) / 50, abs(step_t) / 5)
        slope, shift = max(0.0, slope - step_s / size), shift - step_t / size
        if abs(step_s) < 1e-6 and abs(step_t) < 1e-8:
            break
    return slope, shift


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality") -> Model:
    """Model of the labelled rows for which ``learn`` (over doc_id) holds.

    Of each class the labels that come first by a hash of doc_id are taken: SAMPLE for its dictionary and CALIBRATION others
    for the line, where each class weighs as much as it has labels. Only those ids, a fixed number, are sent to the tasks that
    look for their texts, so no text is shuffled. Rows with a null doc_id, text or label, texts over LARGEST bytes and
    contradicting labels of one doc_id are not learnt from; of several texts of an id the first in order is. With no rows of a class its dictionary is empty, and with none at
    all every score is one half.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("__label")).filter("doc_id is not null and __label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("__label").alias("__label"), F.max("__label").alias("__high")).filter("__label = __high").filter(learn)
    shares = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    bytes_, points = {}, []
    chosen = known.filter("__label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE + CALIBRATION).unionByName(
        known.filter("__label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE + CALIBRATION)
    )
    wanted = docs.select("doc_id", F.col("text").alias("__text")).filter(F.octet_length("__text") <= LARGEST)
    # one text for an id, however many rows have it
    found = wanted.join(F.broadcast(chosen), "doc_id").groupBy(F.xxhash64("doc_id").alias("__at"), "doc_id", "__label").agg(F.min("__text").alias("__text")).collect()
    found.sort(key=lambda r: (r["__at"], r["doc_id"]))
    for side in (0, 1):
        texts = [r["__text"].encode() for r in found if r["__label"] == side]
        held = min(CALIBRATION, len(texts) // 5)
        bytes_[side] = dictionary([t for t in texts[held:] if t])
        points.append((side, texts[:held]))
    model = Model(bytes_[0], bytes_[1], 0.0, 0.0)
    seen = [(model.difference(t), side, shares[side] / total * 1000 / len(texts)) for side, texts in points for t in texts]
    if seen:
        model.slope, model.shift = fit_line(seen)
    return model


def score_texts(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the score (0 to 1) of every row's whole text.

    Defined cases: a null text is empty and scored as such; repeated rows get equal scores, whatever their doc_id; an empty
    table gives no rows. Other columns are ignored.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        yield {**{k: batch.column(k) for k in keep}, "score": [known.value.score((x or "").encode("utf-8", "replace")) for x in batch.column("__text").to_pylist()]}

    return map_batches(docs.select(*keep, F.col("text").alias("__text")), fields(docs, keep, "score double"), work)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, modulo 3, is 1. A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
