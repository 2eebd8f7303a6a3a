"""Quality rules as weak supervision: votes, accuracies by expectation-maximisation, posterior quality."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenmatch.llm.arrow import fields, map_batches
from lumenmatch.session import staged

WORD = re.compile(r"[^ \t-\r]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 8
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper_words long, n_exclaim long, n_distinct long"
#: Vote of a rule: 0 abstains, 1 bad, 2 good.
ABSTAIN, BAD, GOOD = 0, 1, 2
ROUNDS = 50
#: How often a rule accuses a good and a bad document, taken in advance, and how many times the documents of that class these
#: figures weigh. The rules are written to accuse few good texts; junk is of many kinds, of which a rule knows one.
ACCUSED_GOOD, WEIGHT_GOOD = 0.002, 20.0
ACCUSED_BAD, WEIGHT_BAD = 0.1, 1.0


def stats_of(text: str | None) -> tuple[int, ...]:
    """Counts of one text, in the order of ``STATS``; no text counts as empty."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    repeat = 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW))))
        seen: set = set()
        if len(set(windows)) < len(windows):
            again = {w for w in windows if w in seen or seen.add(w)}
            end = 0
            for i, w in enumerate(windows):
                if w in again:
                    repeat += i + WINDOW - max(i, end)
                    end = i + WINDOW
    return (
        n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat,
        len(lines), sum(map(str.isupper, words)), text.count("!"), len(set(words)),
    )


def text_stats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``STATS`` of every row's whole text."""
    schema = fields(docs, keep, STATS)
    names = schema.names[len(keep) :]

    def work(batch):
        rows = [stats_of(x) for x in batch.column("__text").to_pylist()]
        yield {**{k: batch.column(k) for k in keep}, **dict(zip(names, zip(*rows)))}

    return map_batches(docs.select(*keep, F.col(text).alias("__text")), schema, work)


def _vote(bad: Column, good: Column | None = None) -> Column:
    return (F.when(bad, BAD) if good is None else F.when(bad, BAD).when(good, GOOD)).otherwise(ABSTAIN)


def votes() -> dict[str, Column]:
    """The rules over ``STATS``. One that looks for a kind of junk abstains where it finds none."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / n
    return {
        "length": _vote(F.col("n_words") < 20, F.col("n_words") >= 50),
        "symbols": _vote(10 * F.col("n_symbols") > n),
        "exclaims": _vote(5 * F.col("n_exclaim") > n),
        "capitals": _vote(10 * F.col("n_upper_words") > 3 * n),
        "repeats": _vote(100 * F.col("n_repeat_words") > 25 * n),
        "lines": _vote(10 * F.col("n_dup_lines") > 6 * F.col("n_lines")),
        "variety": _vote((F.col("n_words") >= 50) & (100 * F.col("n_distinct") < 15 * F.least(n, F.lit(500))), 10 * F.col("n_distinct") >= 3 * F.least(n, F.lit(1000))),
        "word_length": _vote((mean < 2.5) | (mean > 15)),
    }


def fit_accuracies(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[dict[int, tuple[float, ...]]]]:
    """Share of good documents, and for each rule and class the probabilities of abstaining, a vote against and one in favour.

    ``patterns``: vote tuples and how many documents have them, at most three to the number of rules. The first round takes
    any vote against a document as evidence against it; later ones weigh rules by what they are estimated to do. Estimates of
    votes against are drawn to the figures taken in advance, so that the bad class can't shrink to one kind of junk.
    """
    total = sum(n for _, n in patterns)
    rules = len(patterns[0][0]) if patterns else 0
    good = [0.02 if BAD in v else 0.98 for v, _ in patterns]
    share, rates = 0.5, []
    for _ in range(ROUNDS):
        share = (sum(n * g for (_, n), g in zip(patterns, good)) + 1) / (total + 2)
        rates = []
        for r in range(rules):
            everywhere = [sum(n for (v, n) in patterns if v[r] == k) for k in range(3)]
            of = {}
            for side, before, weight in ((BAD, ACCUSED_BAD, WEIGHT_BAD), (GOOD, ACCUSED_GOOD, WEIGHT_GOOD)):
                cast = [sum(n * (g if side == GOOD else 1 - g) for (v, n), g in zip(patterns, good) if v[r] == k) for k in range(3)]
                mass = sum(cast) + 1
                accused = (cast[BAD] + before * weight * mass) / (sum(cast) + weight * mass)
                # the rest by what the class did, half drawn to what all documents did
                rest = [cast[k] / mass + everywhere[k] / max(total, 1) + 1e-6 for k in (ABSTAIN, GOOD)]
                of[side] = ((1 - accused) * rest[0] / sum(rest), accused, (1 - accused) * rest[1] / sum(rest))
            rates.append(of)
        was, good = good, [posterior(v, share, rates) for v, _ in patterns]
        if max((abs(a - b) for a, b in zip(was, good)), default=0) < 1e-9:
            break
    return share, rates


def posterior(vote: tuple[int, ...], share: float, rates: list[dict[int, tuple[float, ...]]]) -> float:
    """Probability that a document with these votes is good."""
    odds = math.log(share) - math.log1p(-share)
    for v, of in zip(vote, rates):
        odds += math.log(of[GOOD][v]) - math.log(of[BAD][v])
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def weak_quality(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``STATS``, base_failed, quality (posterior) and kept of every row.

    A text with under 20 words, or over 30 of 100 words in windows of eight that the text repeats, fails at once. Others are
    kept at a posterior of one half or more. Votes are counted by pattern (at most 3 ** 8, a fixed bound), so only those
    counts reach the driver and only as many probabilities are sent back.

    Defined cases: a null text is empty and fails; rows are judged one by one, so repeated rows and null ids get equal
    verdicts; an empty table gives no rows. Other columns are ignored.
    """
    rules = votes()
    code = sum((v * 3**i for i, v in enumerate(rules.values())), F.lit(0))
    rows = staged(text_stats(docs, text, keep).withColumn("__votes", code), "votes")
    counted = sorted((r["__votes"], r["n"]) for r in rows.groupBy("__votes").agg(F.count("*").alias("n")).collect())
    patterns = [(tuple(c // 3**i % 3 for i in range(len(rules))), n) for c, n in counted]
    share, rates = fit_accuracies(patterns)
    judged = [(c, posterior(v, share, rates)) for (c, _), (v, _) in zip(counted, patterns)]
    table = docs.sparkSession.createDataFrame(judged, "__votes int, quality double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.join(F.broadcast(table), "__votes").select(
        *keep, *[f.name for f in rows.schema if f.name not in (*keep, "__votes")], failed.alias("base_failed"), "quality", (~failed & (F.col("quality") >= 0.5)).alias("kept")
    )
