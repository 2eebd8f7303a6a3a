"""Tables of search terms of any size: containment by a multi-pattern automaton, close words by deletion neighbourhoods.

Terms are rows, not literals, so a plan is as large for ten thousand terms as for one. Whatever can be decided by a word alone is
decided once per distinct word of all texts, not once per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenmatch.functions.text import MAX_EDITS, normalize_text, words
from lumenmatch.operators import similarity
from lumenmatch.session import many_tasks, staged

#: Bytes of terms that one automaton holds; a larger table is searched block by block.
BLOCK = 8 << 20
TERMS = "kind string, pos int, term string"


def term_table(spark: SparkSession, **lists: list[str]) -> DataFrame:
    """kind, pos, term of short lists, e.g. of one brand."""
    return spark.createDataFrame([(kind, k, t) for kind, terms in lists.items() for k, t in enumerate(terms)], TERMS)


def normalized_terms(terms: DataFrame) -> DataFrame:
    """The rows whose term isn't null or empty, with its normal form ``norm``."""
    return terms.filter(F.col("term") != "").withColumn("norm", normalize_text(F.col("term")))


class Automaton:
    """Finds which of many strings a text contains. Travels as the list of strings and is built once per worker."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        self.machine = None

    def __getstate__(self):
        return self.strings

    def __setstate__(self, strings):
        self.__init__(strings)

    def inside(self, text: str) -> list[str]:
        if self.machine is None:
            self.machine = ahocorasick.Automaton()
            for s in self.strings:
                if s:
                    self.machine.add_word(s, s)
            self.machine.make_automaton()
            self.always = [""] if "" in self.strings else []
        return self.always + (list({s for _, s in self.machine.iter(text)}) if len(self.machine) else [])


def contained(rows: DataFrame, text: str, norms: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` without ``text``, once for each string ``norm`` of ``norms`` that the text contains, with that string.

    The table of strings is measured; a block of at most ``block`` bytes at a time is made an automaton, which the tasks
    hold while they stream the rows. Null texts contain nothing; an empty string is contained in every text.
    """
    spark = rows.sparkSession
    strings = norms.select("norm").distinct()
    size = strings.agg(F.coalesce(F.sum(F.octet_length("norm") + 8), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block))
    keep = [c for c in rows.columns if c != text]
    schema = T.StructType([T.StructField(c, rows.schema[c].dataType, True) for c in keep] + [T.StructField("norm", T.StringType())])
    target = to_arrow_schema(schema)

    def search(part: int) -> DataFrame:
        own = strings.filter(F.pmod(F.xxhash64("norm"), F.lit(blocks)) == part)
        shared = spark.sparkContext.broadcast(Automaton(sorted(r["norm"] for r in own.collect())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, found = [], []
                for k, value in enumerate(batch.column(text).to_pylist()):
                    for norm in shared.value.inside(value) if value is not None else ():
                        at.append(k)
                        found.append(norm)
                if at:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in keep), pa.array(found, pa.string())], schema=target)

        return rows.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, map(search, range(blocks)))


def beside(rows: DataFrame, side: DataFrame, on: str, size: int) -> DataFrame:
    """``rows`` joined with ``side``, which is broadcast only if it has few bytes (``size``, measured or bounded).

    Left to itself Spark guesses: rows from a compressed file, or exploded from short ones, seem as small as what they came
    from, so it would send the many words of all texts through the driver.
    """
    return rows.join(F.broadcast(side) if size <= similarity.BROADCAST_BYTES else side.hint("merge"), on)


def deletions(strings: DataFrame, column: str, name: str = "variant") -> DataFrame:
    """The rows with every string that up to ``MAX_EDITS`` (two) deletions leave of ``column``, itself included, none empty.

    Deletions are exploded one after the other, the second one not before the first, so a string of n characters gives at
    most 1 + n + n (n - 1) / 2 rows.
    """
    without = lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.substring(c, 1, i - 1), F.substring(c, i + 1, F.length(c))))
    once = strings.withColumn("_i", F.explode(F.sequence(F.lit(0), F.length(column)))).withColumn("_once", without(F.col(column), F.col("_i")))
    # 0 takes nothing away; after a first deletion at i the second one is at i or later
    seconds = F.when((F.col("_i") == 0) | (F.length("_once") < F.col("_i")), F.array(F.lit(0))).otherwise(F.concat(F.array(F.lit(0)), F.sequence("_i", F.length("_once"))))
    twice = once.withColumn("_j", F.explode(seconds)).withColumn(name, without(F.col("_once"), F.col("_j")))
    return twice.drop("_i", "_j", "_once").filter(F.col(name) != "")


def close_words(vocabulary: DataFrame, norms: DataFrame) -> DataFrame:
    """word, norm: distinct words within ``MAX_EDITS`` edits of a term of three characters or more.

    Two strings within two edits leave a common string after at most two deletions each, so an equi-join on deletions finds
    every such pair; the distance is then computed for those alone. Words shorter or longer than any term by more than two
    characters have no deletions made.
    """
    long = norms.select("norm").filter(F.length("norm") >= 3).distinct()
    n = F.length("norm")
    bound = F.sum((1 + n * (n + 1) / 2) * (2 * F.octet_length("norm") + 8))
    shortest, longest, size = long.agg(F.min(n), F.max(n), F.coalesce(bound, F.lit(0))).first()
    fit = vocabulary.filter(F.length("word").between((shortest or 1) - MAX_EDITS, (longest or 0) + MAX_EDITS))
    pairs = beside(deletions(fit.select("word"), "word"), deletions(long, "norm"), "variant", size)
    near = (F.abs(F.length("word") - F.length("norm")) <= MAX_EDITS) & (F.levenshtein("word", "norm", MAX_EDITS) >= 0)
    return pairs.filter(near).select("word", "norm").distinct()


def words_of_terms(vocabulary: DataFrame, norms: DataFrame, fuzzy: Column) -> DataFrame:
    """word, norm, exact: distinct words that contain a term without blanks (exact), or, where ``fuzzy``, lie close to one."""
    single = norms.filter((F.col("norm") != "") & ~F.contains("norm", F.lit(" ")))
    inside = contained(vocabulary.select("word", F.col("word").alias("_text")), "_text", single).withColumn("exact", F.lit(True))
    near = close_words(vocabulary, norms.filter(fuzzy)).withColumn("exact", F.lit(False))
    return inside.unionByName(near).groupBy("word", "norm").agg(F.bool_or("exact").alias("exact"))


def spanning(norms: DataFrame) -> DataFrame:
    """Terms that words alone can't decide: those with a blank, and those that are empty once normalised."""
    return norms.filter((F.col("norm") == "") | F.contains("norm", F.lit(" ")))


def numbered(norms: DataFrame) -> DataFrame:
    """``norms``, written once, with a number ``n`` for each different ``norm``."""
    norms = staged(norms, "norms")
    return norms.join(staged(norms.select("norm").distinct().withColumn("n", F.monotonically_increasing_id()), "numbers"), "norm")


def by_word(found: DataFrame, norms: DataFrame) -> DataFrame:
    """word, held, near: the numbers of the terms that a word contains, and of those it is only close to; a row per word."""
    of = found.join(norms.select("norm", "n").distinct(), "norm").groupBy("word")
    return of.agg(F.collect_list(F.when(F.col("exact"), F.col("n"))).alias("held"), F.collect_list(F.when(~F.col("exact"), F.col("n"))).alias("near"))


def word_hits(exploded: DataFrame, found: DataFrame, norms: DataFrame) -> DataFrame:
    """The rows of ``exploded``, with ``held`` and ``near`` in place of their ``word``; those whose word has no term go."""
    known = staged(by_word(found, norms), "words")
    size = known.agg(F.coalesce(F.sum(F.octet_length("word") + 8 * (F.size("held") + F.size("near")) + 32), F.lit(0))).first()[0]
    return beside(exploded, known, "word", size).drop("word")


def whole_hits(found: DataFrame, norms: DataFrame) -> DataFrame:
    """Rows with ``norm`` that a whole text contains, in the form of ``by_word``."""
    n = found.join(norms.select("norm", "n").distinct(), "norm").drop("norm")
    return n.select(*[c for c in n.columns if c != "n"], F.array("n").alias("held"), F.array().cast("array<bigint>").alias("near"))


def by_item(hits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, exact: each term once per item. ``hits`` have the terms of one word a row, so what is shuffled is a row per word
    of an item, not one per word and term."""
    of = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    items = hits.groupBy(*keys).agg(of("held"), of("near"))
    tell = lambda c, exact: F.transform(c, lambda n: F.struct(n.alias("n"), F.lit(exact).alias("exact")))
    every = F.concat(tell(F.col("held"), True), tell(F.array_except("near", "held"), False))
    return items.select(*keys, F.inline(every))


def dealt(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and text, dealt to many tasks: a file whose rows lie in one group would be one task's work, however long it is."""
    return rows.select(*keys, text).repartition(many_tasks(rows.sparkSession), *keys, text)


def normal_texts(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, _norm: the normalised texts, written once."""
    return staged(dealt(rows, keys, text).select(*keys, normalize_text(F.col(text)).alias("_norm")), "normal")


def find_terms(docs: DataFrame, keys: list[str], text: str, terms: DataFrame) -> DataFrame:
    """keys, term, exact: the terms of a table (term) that each text holds, normalised, or has a word close to.

    ``keys`` name a document; rows with equal keys are one. Terms with blanks are searched for in whole normalised texts, all
    others in the distinct words. Null and empty terms are left out; null texts hold none; equal terms are one.
    """
    norms = numbered(normalized_terms(terms.select("term")).distinct())
    # the texts are read three times; normalising them is most of the work, writing them is not
    normal = normal_texts(docs, keys, text)
    exploded = normal.select(*keys, F.explode(words(F.col("_norm"))).alias("word"))
    vocabulary = staged(exploded.select("word").distinct(), "vocabulary")
    hits = word_hits(exploded, words_of_terms(vocabulary, norms, F.lit(True)), norms)
    wide = spanning(norms)
    if wide.limit(1).count():
        hits = hits.unionByName(whole_hits(contained(normal, "_norm", wide), norms))
    return by_item(hits, keys).join(norms, "n").select(*keys, "term", "exact")
