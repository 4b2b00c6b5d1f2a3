"""The queries on outputs over texts as they are, with all their characters: NAME_whole beside NAME under the ASCII profile.

The SQL is that of NAME without the mask. DuckDB's levenshtein counts bytes, so it is given the texts with a control
character for each character beyond ASCII, of which the tables have fewer. Its word boundaries are ASCII, so texts are
cut into words where a pattern asks for them.
"""

from __future__ import annotations

import re

from ..functions.text import LETTERS
from ..operators.tokens import LOOKS
from ..sources import derived
from .registry import ORACLES, QUERIES, register

#: Without SQL in any case, but resting on the masked outputs.
_NO_SQL = ("word_error_rates", "document_word_error_rates", "confusion_matrix", "top_confused_characters", "bootstrap_intervals")
#: What patterns of the masked texts are over texts as they are.
_WIDER = {"[A-Z][a-z]+": r"\p{Lu}[\p{Ll}\p{M}]+"}
_LETTERS = [(f"'{masked}'", f"'{whole}'") for masked, whole in zip(LETTERS[False], LETTERS[True], strict=True)] + [("'[a-z]'", r"'[\p{L}\p{M}]'")]
#: The characters of the documents beyond ASCII, in either case, and as many control characters that no text has.
_BEYOND = r"(SELECT coalesce(string_agg(c, '' ORDER BY c), '') FROM (SELECT DISTINCT unnest(regexp_extract_all(text || lower(text), '[^\x00-\x7F]')) AS c FROM documents))"
_CONTROL = "array_to_string(list_transform(list_concat(range(1, 9), range(14, 32)), lambda x: chr(CAST(x AS INTEGER))), '')"


def _bytewise(sql: str) -> str:
    single = lambda x: f"translate({x}, {_BEYOND}, {_CONTROL})"
    return re.sub(r"levenshtein\((\w+(?:\[i\])?), (\w+(?:\[i\])?)\)", lambda m: f"levenshtein({single(m[1])}, {single(m[2])})", sql)


def _bounded(sql: str) -> str:
    """Patterns between word boundaries as whole words, parted by what is neither letter, mark, digit nor underscore."""
    words = lambda text, pattern: f"list_filter(string_split_regex({text}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '{_WIDER.get(pattern, pattern)}'))"
    return re.sub(r"regexp_extract_all\((\w+|\w+\(\w+\)), '\\b(.+?)\\b'\)", lambda m: words(m[1], m[2]), sql)


def _sql(name: str) -> str | None:
    sql = _bounded(_bytewise(ORACLES.get(name, "")))
    if name == "flesch_delta":
        for masked, whole in _LETTERS:
            sql = sql.replace(masked, whole)
    for masked, whole in zip(*LOOKS.values(), strict=True):
        sql = sql.replace(f"regexp_matches(token, '{masked}')", f"regexp_matches(token, '{whole}')")
    return sql.replace(derived.MASKED_SQL, derived.WHOLE_SQL) or None


# hallucination_metrics is not here: hallucination_scores reads texts as they are.
for _name in [n for n in QUERIES if n in _NO_SQL or n != "hallucination_metrics" and derived.MASKED_SQL in ORACLES.get(n, "")]:
    register(_sql(_name))(derived.as_written(QUERIES[_name], f"{_name}_whole"))
