"""Signs of old prints, manuscripts and archives, Roman numerals and number sequences, as column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import matches, roman_value

# Medieval signs of abbreviation and what they stand for.
ABBREVIATIONS = {"ꝑ": ("per", "par"), "ꝓ": ("pro",), "ꝗ": ("qui",), "ꝙ": ("quia",), "ꝯ": ("us", "con"), "⁊": ("et",), "ꝝ": ("rum",), "ꝫ": ("et",), "ꝭ": ("is",), "p̃": ("par", "per"), "q̃": ("que", "qui"), "ñ": ("an", "en")}

# Marks of modern archives by category, and their written-out forms.
ARCHIVE_MARKS = {
    "civility_titles": {"Mme": ["Madame"], "Mlle": ["Mademoiselle"], "Mgr": ["Monseigneur"], "Dr": ["Docteur"], "Pr": ["Professeur"], "Me": ["Maître"], "M.": ["Monsieur"], "R.P.": ["Révérend Père"], "S.M.": ["Sa Majesté"], "S.A.R.": ["Son Altesse Royale"], "S.E.": ["Son Excellence"], "S.S.": ["Sa Sainteté"]},
    "ordinals": {
        "1ᵉʳ": ["1er", "premier"], "1ʳᵉ": ["1re", "première", "premiere"], "2ᵈ": ["2d", "second"], "2ᵈᵉ": ["2de", "seconde"], "2ᵉ": ["2e", "deuxième", "deuxieme"], "3ᵉ": ["3e", "troisième", "troisieme"], "Iᵉʳ": ["Ier", "premier"], "Vᵉ": ["Ve", "cinquième", "cinquieme"],
        "XIᵉ": ["XIe", "onzième", "onzieme"], "XIIᵉ": ["XIIe", "douzième", "douzieme"], "XVIᵉ": ["XVIe", "seizième", "seizieme"], "XVIIᵉ": ["XVIIe", "dix-septième", "dix-septieme"], "XVIIIᵉ": ["XVIIIe", "dix-huitième", "dix-huitieme"], "XIXᵉ": ["XIXe", "dix-neuvième", "dix-neuvieme"], "XXᵉ": ["XXe", "vingtième", "vingtieme"],
    },
    "currency": {"₶": ["livre tournois", "livres tournois"], "₣": ["franc", "francs"], "ƒ": ["florin", "florins"], "£": ["livre", "livres", "pound", "pounds"], "l.": ["livre", "livres"], "s.": ["sol", "sols", "sou", "sous"], "d.": ["denier", "deniers"]},
    "administrative": {"arr.": ["arrondissement"], "dép.": ["département", "departement"], "cant.": ["canton"], "com.": ["commune"], "reg.": ["régiment", "regiment"], "prov.": ["province"]},
    "civil_status": {"°": ["né", "née"], "†": ["mort", "morte", "décédé", "décédée"], "✶": ["naissance"], "⚭": ["marié", "mariée", "épousa", "epousa"], "ép.": ["épouse", "époux", "epouse", "epoux"], "vve": ["veuve"]},
    "typographic_punctuation": {"«": ['"'], "»": ['"'], "—": ["-", "--"], "–": ["-"], "…": ["..."], "’": ["'"], "‘": ["'"]},
    "latin_abbr_modern": {"e.g.": ["for example", "par exemple", "exempli gratia"], "i.e.": ["c'est-à-dire", "id est", "that is"], "etc.": ["et cetera", "et caetera"], "cf.": ["confer", "voir"], "ibid.": ["ibidem"], "op. cit.": ["opere citato", "opus citatum"], "ad lib.": ["ad libitum"], "N.B.": ["nota bene"]},
    "bibliographic": {"vol.": ["volume"], "t.": ["tome"], "p.": ["page"], "pp.": ["pages"], "n°": ["numéro", "numero", "no"], "fasc.": ["fascicule"], "éd.": ["édition", "edition"], "ms.": ["manuscrit"], "f.": ["folio"], "r°": ["recto"], "v°": ["verso"]},
    "address": {"bd": ["boulevard"], "av.": ["avenue"], "r.": ["rue"], "pl.": ["place"], "imp.": ["impasse"], "fbg": ["faubourg"]},
}
# What may stand before and after a mark with a point.
_BEFORE, _AFTER = r"(?<![^\s,;:!?(\[«\"'])", r"(?![^\s,;:!?)\]»\"'…])"

# Old print signs by category; a vowel with a combining tilde counts as its tilde.
EARLY_SIGNS = {"ligatures": "ﬀﬁﬂﬃﬄﬅﬆ", "long_s": "ſ", "dotless_i": "ı", "ampersand": "&", "nasal_tildes": "ãÃñÑõÕũŨẽẼĩĨ̃"}

# Ranges and single characters of medieval fonts.
MEDIEVAL_RANGES = ((0xE000, 0xF8FF), (0xA720, 0xA7FF), (0x1DC0, 0x1DFF), (0xFB00, 0xFB4F))
MEDIEVAL_SINGLE = "þÞðÐƿǷſæÆœŒøØƀŧđħȝȜꜿ"


def early_sign(character: Column) -> Column:
    """Category of an old print sign; null for other characters."""
    return F.coalesce(*[F.when(F.instr(F.lit(signs), character) > 0, name) for name, signs in EARLY_SIGNS.items()])


def medieval(character: Column) -> Column:
    """The character itself if medieval fonts define it, else null."""
    code = F.ascii(character)
    known = F.instr(F.lit(MEDIEVAL_SINGLE), character) > 0
    for low, high in MEDIEVAL_RANGES:
        known = known | code.between(low, high)
    return F.when(known, character)


def _holds_any(text: Column, forms: list[str]) -> Column:
    return F.regexp_like(text, F.lit("(?iU)" + "|".join(rf"\b{re.escape(f)}\b" if f.isascii() and f.isalnum() else re.escape(f) for f in forms)))


def abbreviation_scores(gt: Column, hyp: Column) -> Column:
    """Array of (abbreviation, total, strict, expanded): the signs of gt, kept as they are in hyp, or kept or written out.

    A sign is kept if hyp holds it anywhere; a form of one or two letters must be a word of its own.
    """
    rows, low = [], F.lower(hyp)
    for sign, forms in ABBREVIATIONS.items():
        n = ((F.length(gt) - F.length(F.replace(gt, F.lit(sign), F.lit("")))) / len(sign)).cast("bigint")
        strict = F.contains(hyp, F.lit(sign))
        written = F.lit(False)
        for form in forms:
            written = written | (F.regexp_like(low, F.lit(rf"(?U)\b{form}\b")) if len(form) <= 2 else F.contains(low, F.lit(form)))
        rows.append(F.struct(F.lit(sign).alias("abbreviation"), n.alias("total"), F.when(strict, n).otherwise(0).cast("bigint").alias("strict"), F.when(strict | written, n).otherwise(0).cast("bigint").alias("expanded")))
    return F.filter(F.array(*rows), lambda r: r.total > 0)


def mark_pattern(mark: str) -> str:
    """The expression of one mark: with its borders if it has a point, as a word if it is one, else as it is."""
    if "." in mark:
        return _BEFORE + re.escape(mark) + _AFTER
    return rf"\b{re.escape(mark)}\b" if mark.isascii() and mark.isalnum() else re.escape(mark)


#: All marks, the longest first, so that the longest wins wherever several begin.
_MARKS = sorted(((m, c, forms) for c, ms in ARCHIVE_MARKS.items() for m, forms in ms.items()), key=lambda x: -len(x[0]))
#: A place where no mark begins is left after one look at its sign.
_ANY_MARK = f"(?U)(?=[{''.join(re.escape(c) for c in sorted({m[0] for m, *_ in _MARKS}))}])(?:" + "|".join(mark_pattern(m) for m, *_ in _MARKS) + ")"


def archive_marks(text: Column) -> Column:
    """The marks of modern archives in a text, in order, none overlapping another."""
    return F.regexp_extract_all(text, F.lit(_ANY_MARK), F.lit(0))


def archive_scores(gt: Column, hyp: Column, found: Column | None = None) -> Column:
    """Array of (category, total, strict, expanded) as in abbreviation_scores, by the category of the mark; found are the marks of gt where they are known."""
    found = archive_marks(gt) if found is None else found
    category = F.create_map(*[F.lit(x) for m, c, _ in _MARKS for x in (m, c)])
    strict = lambda m: _case(m, lambda mark, forms: F.regexp_like(hyp, F.lit("(?U)" + mark_pattern(mark))))
    wide = lambda m: _case(m, lambda mark, forms: F.regexp_like(hyp, F.lit("(?U)" + mark_pattern(mark))) | _holds_any(hyp, forms))
    return F.transform(F.array_distinct(found), lambda m: F.struct(category[m].alias("category"), F.size(F.filter(found, lambda x: x == m)).cast("bigint").alias("total"), strict(m).alias("strict"), wide(m).alias("expanded")))


def _case(m: Column, test) -> Column:
    out = None
    for mark, _, forms in _MARKS:
        out = F.when(m == mark, test(mark, forms)) if out is None else out.when(m == mark, test(mark, forms))
    return out.otherwise(False)


# --- Roman numerals ---------------------------------------------------------------------------------------------

_LETTERS = "(?U)\\b[IVXLCDMivxlcdmj]+\\b"
_LETTERS_ASCII = r"\b[IVXLCDMivxlcdmj]+\b"
# What no numeral holds, too many of a digit and subtractions that are not made.
_NEVER = "VV|LL|DD|IIIII|XXXXX|CCCCC|MMMMMM|I[LCDM]|V[XLCDM]|X[DM]|L[CDM]|DM"


def roman_form(numeral: Column) -> Column:
    """Upper case, with a final j read as i."""
    return F.regexp_replace(F.upper(numeral), "J$", "I")


def is_roman(numeral: Column) -> Column:
    form = roman_form(numeral)
    return F.regexp_like(form, F.lit("^[IVXLCDM]+$")) & ~F.regexp_like(form, F.lit(_NEVER))


def romans(text: Column, least: int = 1, ascii_words: bool = False) -> Column:
    """The plausible Roman numerals of a text of least digits or more, in order."""
    return F.filter(matches(text, _LETTERS_ASCII if ascii_words else _LETTERS), lambda n: (F.length(n) >= least) & is_roman(n))


def to_roman(number: Column) -> Column:
    """The usual form of a number from 1 on; null below."""
    # The parts a numeral is made of.
    parts = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
    out, rest = F.lit(""), number.cast("bigint")
    for value, sign in parts:
        out, rest = F.concat(out, F.repeat(F.lit(sign), F.floor(rest / value).cast("int"))), rest % value
    return F.when(number > 0, out)


def roman_status(numeral: Column, hyp: Column) -> Column:
    """What becomes of a numeral in hyp: strict_preserved, case_changed, j_dropped, converted_to_arabic or lost; the first that holds."""
    words, numbers = F.regexp_extract_all(hyp, F.lit("[A-Za-z]+"), F.lit(0)), F.regexp_extract_all(hyp, F.lit("[0-9]+"), F.lit(0))
    swap = lambda c: F.translate(c, "IVXLCDMJivxlcdmj", "ivxlcdmjIVXLCDMJ")
    last = F.right(numeral, F.lit(1))
    turned = F.when(F.lower(last).isin("i", "j"), F.concat(F.left(numeral, F.length(numeral) - 1), F.translate(last, "IJij", "JIji"))).otherwise(numeral)
    has = lambda c: F.array_contains(words, c)
    return (
        F.when(has(numeral), "strict_preserved").when(has(swap(numeral)), "case_changed").when((turned != numeral) & (has(turned) | has(swap(turned))), "j_dropped")
        .when(F.array_contains(numbers, roman_value(roman_form(numeral)).cast("string")), "converted_to_arabic").otherwise("lost")
    )


# --- number sequences -------------------------------------------------------------------------------------------

# The patterns of years, leaves, amounts and regnal years, and the units that are one.
_YEAR = r"(?U)\b(?:1[0-9]{3}|20[0-9]{2})\b"
_LEAF = r"(?U)\b(?:fol\.?|f\.|pp\.|p\.|n\.°|n°)\s*(\d+(?:\s*-\s*\d+)?)\s*([rvRV])?"
_MONEY = r"(?iuU)\b(\d+(?:[.,]\d+)?)\s*(livres?|sols?|deniers?|écus?|florins?|francs?|l\.|s\.|d\.|£|€|₣)(?=\b|[\s,;.!?:]|$)"
_REGNAL = r"(?U)\b(?:l['’]\s*)?an\s+(?:de\s+(?:grâce|la\s+R[eé]publique)\s+)?([IVXLCDMivxlcdm]+|\d{1,4})\b"
_UNITS = {"livres": "livre", "l.": "livre", "sols": "sol", "s.": "sol", "deniers": "denier", "d.": "denier", "écus": "écu", "florins": "florin", "francs": "franc"}


def number_sequences(text: Column) -> Column:
    """Array of (category, form, value) of the years, Roman numerals (two digits or more), leaves, amounts and regnal years of a text."""
    item = lambda category, form, value: F.struct(F.lit(category).alias("category"), form.alias("form"), value.cast("string").alias("value"))
    part = lambda m, pattern, k: F.regexp_extract(m, "(?s)^(?:" + pattern + ")", k)
    unit = lambda m: F.lower(part(m, _MONEY, 2))
    units = F.create_map(*[F.lit(x) for kv in _UNITS.items() for x in kv])
    one = lambda m: F.coalesce(F.try_element_at(units, unit(m)), unit(m))
    numeral = lambda m: part(m, _REGNAL, 1)
    regnal = lambda m: F.when(F.regexp_like(numeral(m), F.lit("^[0-9]+$")), F.try_to_number(numeral(m), F.lit("9999")).cast("int")).when(is_roman(numeral(m)), roman_value(roman_form(numeral(m))))
    return F.concat(
        F.transform(matches(text, _YEAR), lambda m: item("year", m, m)),
        F.transform(romans(text, 2), lambda m: item("roman", m, roman_value(roman_form(m)))),
        F.transform(matches(text, _LEAF), lambda m: item("foliation", F.regexp_replace(m, r"(?U)^\s+|\s+$", ""), F.concat(F.regexp_replace(part(m, _LEAF, 1), r"(?U)\s+", ""), F.lower(part(m, _LEAF, 2))))),
        F.transform(matches(text, _MONEY), lambda m: item("currency", m, F.concat(F.replace(part(m, _MONEY, 1), F.lit(","), F.lit(".")), F.lit(" "), one(m)))),
        F.filter(F.transform(matches(text, _REGNAL), lambda m: item("regnal", m, regnal(m))), lambda x: x.value.isNotNull()),
    )
