"""Queries on signs of manuscripts, prints and archives, Roman numerals and number sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import philology as P
from ..operators.alignment import character_scores
from ..sources import derived
from ..sources.derived import OUTPUTS_SQL, SCRIBAL_SQL
from .registry import register

_ABBREVIATIONS_SQL = " UNION ALL ".join(
    f"SELECT engine, '{sign}' AS abbreviation, CAST((length(gt) - length(replace(gt, '{sign}', ''))) / {len(sign)} AS BIGINT) AS total, contains(hyp, '{sign}') AS strict, "
    + " OR ".join(f"regexp_matches(low, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){f}($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])')" if len(f) <= 2 else f"contains(low, '{f}')" for f in forms)
    + " AS written FROM s WHERE contains(gt, '" + sign + "')"
    for sign, forms in P.ABBREVIATIONS.items()
)


@register(f"""WITH {SCRIBAL_SQL}, s AS (SELECT *, lower(hyp) AS low FROM scribal), a AS ({_ABBREVIATIONS_SQL})
SELECT engine, abbreviation, CAST(sum(total) AS BIGINT) AS total, CAST(coalesce(sum(total) FILTER (strict), 0) AS BIGINT) AS strict, CAST(coalesce(sum(total) FILTER (strict OR written), 0) AS BIGINT) AS expanded
FROM a GROUP BY ALL""")
def abbreviation_preservation(spark, sf_dir):
    """Medieval abbreviations that an output keeps as they are, or keeps or writes out."""
    rows = derived.scribal(spark, sf_dir).select("engine", F.inline(P.abbreviation_scores(F.col("gt"), F.col("hyp"))))
    return rows.groupBy("engine", "abbreviation").agg(*[F.sum(c).alias(c) for c in ("total", "strict", "expanded")])


def _scribal_lines(spark, sf_dir):
    return derived.split_lines(derived.scribal(spark, sf_dir).withColumns({"stratum": F.lit(None).cast("string"), "corpus": F.lit(None).cast("string")}))


@register()
def early_sign_preservation(spark, sf_dir):
    """Signs of old prints that an output keeps in their places, by category; by aligned characters, so without SQL."""
    return character_scores(_scribal_lines(spark, sf_dir), "engine", P.early_sign(F.col("g")))


@register()
def medieval_character_coverage(spark, sf_dir):
    """Characters of medieval fonts that an output keeps in their places, by character."""
    return character_scores(_scribal_lines(spark, sf_dir), "engine", P.medieval(F.col("g")))


@register()
def archive_mark_preservation(spark, sf_dir):
    """Marks of modern archives by category, kept as they are, or kept or written out; their borders need look-arounds, which DuckDB has not."""
    # all engines read the same ground truth, so its marks are looked for once
    marked = lambda docs: docs.withColumn("found", P.archive_marks(F.col("gt")))
    rows = derived.varied(spark, sf_dir, marked).select("engine", F.inline(P.archive_scores(F.col("gt"), F.col("hyp"), F.col("found"))))
    some = lambda c: F.sum(F.when(F.col(c), F.col("total")).otherwise(0))
    return rows.groupBy("engine", "category").agg(F.sum("total").alias("total"), some("strict").alias("kept"), some("expanded").alias("expanded")).withColumnRenamed("kept", "strict")


_NUMERALS_SQL = rf"""{OUTPUTS_SQL},
found AS (SELECT engine, doc_id, hyp, unnest(regexp_extract_all(gt, '{P._LETTERS_ASCII}')) AS numeral FROM outputs),
n AS (SELECT engine, doc_id, hyp, numeral, regexp_replace(upper(numeral), 'J$', 'I') AS form, count(*) AS total FROM found GROUP BY ALL),
p AS (SELECT *, list_transform(string_split(form, ''), lambda c: CASE c WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 ELSE 1000 END) AS d,
 translate(numeral, 'IVXLCDMJivxlcdmj', 'ivxlcdmjIVXLCDMJ') AS swapped, CASE WHEN regexp_matches(numeral, '[iIjJ]$') THEN numeral[:-2] || translate(numeral[-1:], 'IJij', 'JIji') ELSE numeral END AS turned
 FROM n WHERE regexp_matches(form, '^[IVXLCDM]+$') AND NOT regexp_matches(form, '{P._NEVER}')),
v AS (SELECT *, CAST(CAST(list_sum([CASE WHEN i < len(d) AND d[i] < d[i + 1] THEN -d[i] ELSE d[i] END for i in range(1, len(d) + 1)]) AS BIGINT) AS VARCHAR) AS value,
 regexp_extract_all(hyp, '[A-Za-z]+') AS words, regexp_extract_all(hyp, '[0-9]+') AS numbers FROM p),
s AS (SELECT engine, total, CASE WHEN list_contains(words, numeral) THEN 'strict_preserved' WHEN list_contains(words, swapped) THEN 'case_changed'
 WHEN turned <> numeral AND (list_contains(words, turned) OR list_contains(words, translate(turned, 'IVXLCDMJivxlcdmj', 'ivxlcdmjIVXLCDMJ'))) THEN 'j_dropped' WHEN list_contains(numbers, value) THEN 'converted_to_arabic' ELSE 'lost' END AS status FROM v)"""


@register(f"WITH {_NUMERALS_SQL} SELECT engine, status, CAST(sum(total) AS BIGINT) AS numerals FROM s GROUP BY ALL")
def roman_restitution(spark, sf_dir):
    """What becomes of the Roman numerals of the ground truth, by status."""
    rows = derived.outputs(spark, sf_dir).withColumn("found", P.romans(F.col("gt"), ascii_words=not derived.is_as_written())).where("size(found) > 0")
    each = rows.select("engine", "hyp", "found", F.explode(F.array_distinct("found")).alias("numeral"))
    each = each.select("engine", F.size(F.filter("found", lambda x: x == F.col("numeral"))).alias("n"), P.roman_status(F.col("numeral"), F.col("hyp")).alias("status"))
    return each.groupBy("engine", "status").agg(F.sum("n").alias("numerals"))


@register()
def number_sequence_preservation(spark, sf_dir):
    """Years, Roman numerals, leaves, amounts and regnal years that an output keeps: in form, and in value.

    As multisets within a document: equal forms have equal values, so what is kept in value is the least count of each
    value. Texts are read as they are; the patterns need look-arounds, which DuckDB has not.
    """
    side = lambda c, g: F.transform(P.number_sequences(F.col(c)), lambda x: F.struct(x.category.alias("category"), x.form.alias("form"), x.value.alias("value"), F.lit(g).alias("g")))
    rows = derived.as_written(derived.outputs, "outputs")(spark, sf_dir).select("engine", "doc_id", F.inline(F.concat(side("gt", 1), side("hyp", 0))))
    forms = rows.groupBy("engine", "doc_id", "category", "value", "form").agg(F.sum("g").alias("g"), F.sum(1 - F.col("g")).alias("h"))
    values = forms.groupBy("engine", "doc_id", "category", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum(F.least("g", "h")).alias("strict"))
    return values.groupBy("engine", "category").agg(F.sum("g").alias("wanted"), F.sum("strict").alias("strict"), F.sum(F.least("g", "h")).alias("value")).where("wanted > 0")


@register("SELECT CAST(doc_id AS BIGINT) AS number, CASE WHEN doc_id > 0 THEN " + " || ".join(f"repeat('{s}', CAST(({e}) AS BIGINT))" for s, e in (("M", "doc_id // 1000"), *((a, f"({b}) // {c}") for a, b, c in (("CM", "doc_id % 1000", 900), ("D", "doc_id % 1000 % 900", 500), ("CD", "doc_id % 1000 % 900 % 500", 400), ("C", "doc_id % 1000 % 900 % 500 % 400", 100), ("XC", "doc_id % 100", 90), ("L", "doc_id % 100 % 90", 50), ("XL", "doc_id % 100 % 90 % 50", 40), ("X", "doc_id % 100 % 90 % 50 % 40", 10), ("IX", "doc_id % 10", 9), ("V", "doc_id % 10 % 9", 5), ("IV", "doc_id % 10 % 9 % 5", 4), ("I", "doc_id % 10 % 9 % 5 % 4", 1))))) + " END AS numeral FROM documents")
def roman_formats(spark, sf_dir):
    """Every document's number as a Roman numeral; null for 0."""
    return derived.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("number"), P.to_roman(F.col("doc_id")).alias("numeral"))
