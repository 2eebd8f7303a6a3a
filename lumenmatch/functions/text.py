"""Text predicates for brand terms: normalisation, containment, bounded edit distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, Arabic alef forms and Arabic vowel marks.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# as a class for the regular expressions; all beyond U+1680 are one test for other characters
_NO_BLANK = r"\x{09}-\x{0D}\x{1C}-\x{1F}\x{85}\x{A0}[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
SPACE = rf"[\x{{20}}{_NO_BLANK}]"
ALEF_FORMS = "[أإآ]"
ALEF = "ا"
VOWEL_MARKS = "[ً-ٟ]"
MAX_EDITS = 2


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def normalize_text(c: Column) -> Column:
    """Lower case, trimmed, one alef form, no vowel marks, single spaces."""
    c = F.regexp_replace(strip(F.lower(c)), ALEF_FORMS, ALEF)
    # single blanks, which most white space is, stay as they are
    return F.regexp_replace(F.regexp_replace(c, VOWEL_MARKS, ""), rf"{SPACE}{{2,}}|[{_NO_BLANK}]", " ")


def words(normalized: Column) -> Column:
    """Distinct words of a normalised text."""
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda w: w != ""))


def fuzzy_contains(haystack: Column, needle: Column) -> Column:
    return F.contains(normalize_text(haystack), normalize_text(needle))


def close_word(word_list: Column, needle: Column, max_edits: int = MAX_EDITS) -> Column:
    """Some word within ``max_edits`` of a normalised needle of at least three characters."""
    near = F.exists(
        F.filter(word_list, lambda w: F.abs(F.length(w) - F.length(needle)) <= max_edits),
        lambda w: F.levenshtein(w, needle, max_edits) >= 0,
    )
    return (F.length(needle) >= 3) & near


def fuzzy_match(haystack: Column, needle: Column, max_edits: int = MAX_EDITS) -> Column:
    h, n = normalize_text(haystack), normalize_text(needle)
    return F.contains(h, n) | close_word(words(h), n, max_edits)


def fixed(c: Column, places: int) -> Column:
    """``%.<places>f`` rounded on the exact binary value, as printf does.

    Spark's formatter rounds the shortest decimal form half up, which differs for values already rounded to four
    places. The rounding error of ``c * 10^places`` is recovered by splitting ``c`` so that both partial products are exact.
    """
    scale = F.lit(10.0**places)
    product = c * scale
    upper = c * 134217729.0 - (c * 134217729.0 - c)
    error = (upper * scale - product) + (c - upper) * scale
    down = F.floor(product).cast("double")
    rest = product - down
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (down % 2 == 1))))
    return F.format_string(f"%.{places}f", (down + F.when(up, 1.0).otherwise(0.0)) / scale)


def fixed3(c: Column) -> Column:
    return fixed(c, 3)
