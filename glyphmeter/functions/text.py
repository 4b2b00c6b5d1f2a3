"""Column kernels on texts: edit distance, words, n-grams, readability, numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distance import edit_distance


def with_edit_distance(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with the Levenshtein distance of two columns."""
    return df.withColumn(name, edit_distance(F.col(a), F.col(b)))


def words(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Joined runs of n tokens; shifted copies are zipped, so the tokens are made n times and not once for each run."""
    size = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    out = F.slice(tokens, F.lit(1), size)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(tokens, F.lit(1 + k), size), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


# The Flesch coefficients (base, words per sentence, syllables per word).
FLESCH = {"en": (206.835, 1.015, 84.6), "fr": (207.0, 1.015, 73.6)}


# Letters and vowels of words under the ASCII profile, and in texts as they are.
LETTERS = {False: ("[a-z]+", "[aeiouy]+"), True: (r"[\p{L}\p{M}]+", "[aeiouyàâäáãåéèêëíîïóôöòõøúûüùÿœæ]+")}


def flesch(text: Column, lang: str = "en", as_written: bool = False) -> Column:
    """Reading ease; null without a word. Syllables are groups of vowels, at least one a word."""
    base, per_sentence, per_word = FLESCH[lang]
    letters, vowels = LETTERS[as_written]
    one = letters.removesuffix("+")
    # words of letters that are no vowels have one syllable
    silent = f"(?<!{one})[{one}&&[^{vowels.removesuffix('+').strip('[]')}]]+(?!{one})"
    count = lambda x, pattern: F.regexp_count(x, F.lit(pattern))
    # what is given to a function is made once
    counts = F.transform(F.array(F.struct(text.alias("text"), F.lower(text).alias("low"))), lambda s: F.struct(
        count(s["low"], letters).alias("n"), F.greatest(F.lit(1), count(s["text"], "[.!?]+")).alias("sentences"), (count(s["low"], vowels) + count(s["low"], silent)).alias("syllables"),
    ))
    return F.transform(counts, lambda c: F.when(c["n"] > 0, F.lit(base) - F.lit(per_sentence) * (c["n"] / c["sentences"]) - F.lit(per_word) * (c["syllables"] / c["n"])))[0]


# Roman digits.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman_value(numeral: Column) -> Column:
    """The value of a Roman numeral by the rule that a smaller digit before a larger one counts against it."""
    digit = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("right"))
    step = lambda acc, c: F.struct((acc.total + F.when(digit[c] < acc.right, -digit[c]).otherwise(digit[c])).alias("total"), digit[c].alias("right"))
    return F.aggregate(F.reverse(F.filter(F.split(F.upper(numeral), ""), lambda c: c != "")), start, step, lambda acc: acc.total)


def markdown_text(text: Column) -> Column:
    """Markdown without its marks: fences, images, links, headings, lists, quotes, rules, emphasis, code."""
    for pattern, to in ((r"(?m)^```[^\n]*$", ""), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}[ \t]+", ""), (r"(?m)^[ \t]*(?:[-*_][ \t]*){3,}$", ""), (r"(?m)^[ \t]*[-*+][ \t]+", ""), (r"(?m)^[ \t]*\d+\.[ \t]+", ""), (r"(?m)^>[ \t]?", ""), (r"(\*\*|__)(.+?)\1", "$2"), (r"(\*|_)([^*_\n]+?)\1", "$2"), (r"`([^`]*)`", "$1")):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def page_selection(spec: Column, total: Column) -> Column:
    """Page numbers of a selector like 1-3,7 that lie within total, distinct and in order; "all" and an empty selector take every page."""
    part = lambda p: F.sequence(F.split_part(p, F.lit("-"), F.lit(1)).cast("int"), F.when(p.contains("-"), F.split_part(p, F.lit("-"), F.lit(2)).cast("int")).otherwise(p.cast("int")))
    bare = F.lower(F.regexp_replace(spec, " ", ""))
    every = F.when(total > 0, F.sequence(F.lit(1), total)).otherwise(F.array().cast("array<int>"))
    listed = F.when(~bare.isin("all", ""), bare)
    pages = F.flatten(F.transform(F.split(listed, ","), part))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(pages, lambda p: (p >= 1) & (p <= total)))), every)


def shown(value: Column, digits: int = 4) -> Column:
    """A value as reports show it: rounded, 0 for none. Statistics must not be made of it."""
    return F.round(F.coalesce(value, F.lit(0.0)), digits)
