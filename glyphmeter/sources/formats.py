"""Payload formats as columns: ALTO and PAGE documents, entity and reading-order JSON, canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import words

_ALTO_STRING = "struct<_CONTENT:string,_SUBS_TYPE:string,_SUBS_CONTENT:string,_HPOS:int,_VPOS:int,_WIDTH:int,_HEIGHT:int>"
ALTO = f"struct<Layout:struct<Page:array<struct<PrintSpace:struct<TextBlock:array<struct<TextLine:array<struct<String:array<{_ALTO_STRING}>>>>>>>>>>"
PAGE = "struct<Page:array<struct<TextRegion:array<struct<TextLine:array<struct<TextEquiv:array<struct<Unicode:string>>>>>>>>>"
ENTITIES = "array<struct<label:string,start:int,end:int,text:string>>"


def _escaped(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def _printable(xml: Column) -> Column:
    """xml without the characters that XML 1.0 has no form for; some of them part words, so they go last."""
    return F.regexp_replace(xml, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def _printed_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), words), lambda w: F.size(w) > 0)


def to_alto(text: Column) -> Column:
    """An ALTO document of one block with the lines of a text; blank lines are not printed."""
    line = lambda ws: F.concat(F.lit('<TextLine><String CONTENT="'), F.array_join(ws, '"/><SP/><String CONTENT="'), F.lit('"/></TextLine>'))
    body = F.array_join(F.transform(_printed_lines(_escaped(text)), line), "")
    return _printable(F.concat(F.lit('<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout><Page ID="p1"><PrintSpace><TextBlock ID="b1">'), body, F.lit("</TextBlock></PrintSpace></Page></Layout></alto>")))


def to_page(text: Column) -> Column:
    """A PAGE document of one region with the lines of a text; blank lines are not printed."""
    line = lambda ws: F.concat(F.lit("<TextLine><TextEquiv><Unicode>"), F.array_join(ws, " "), F.lit("</Unicode></TextEquiv></TextLine>"))
    body = F.array_join(F.transform(_printed_lines(_escaped(text)), line), "")
    return _printable(F.concat(F.lit('<PcGts><Page imageFilename="p1"><TextRegion id="r1">'), body, F.lit("</TextRegion></Page></PcGts>")))


def _safe(xml: Column) -> Column:
    """Documents with a document type or entities of their own are refused (null)."""
    return F.when(~F.upper(xml).contains("<!DOCTYPE") & ~F.upper(xml).contains("<!ENTITY"), xml)


def read_alto(xml: Column) -> Column:
    """The document as nested columns; null where it is refused or broken."""
    return F.from_xml(_safe(xml), ALTO, {"mode": "PERMISSIVE", "ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"})


def read_page(xml: Column) -> Column:
    return F.from_xml(_safe(xml), PAGE, {"mode": "PERMISSIVE", "ignoreNamespace": "true"})


def _each(items: Column, f) -> Column:
    return F.transform(F.filter(items, lambda x: x.isNotNull()), f)


def _block_lines(lines: Column) -> Column:
    """Texts of the lines of a block; a word that is divided at a line's end stands whole on its first line."""
    strings = _each(lines, lambda x: F.coalesce(x["String"], F.array()))
    part = lambda s, n: F.coalesce(s["_SUBS_TYPE"] == f"HypPart{n}", F.lit(False))

    def text(line: Column, i: Column) -> Column:
        next_first = F.get(F.get(strings, i + 1), F.lit(0))
        last_first = F.get(F.get(strings, i - 1), F.size(F.get(strings, i - 1)) - 1)
        # without the whole word, its second half is on the next line; a half whose first one is missing stands for itself
        second = F.when(part(next_first, 2), next_first["_CONTENT"]).otherwise("")
        word = lambda s: F.when(part(s, 1), F.coalesce(s["_SUBS_CONTENT"], F.concat(F.regexp_replace(s["_CONTENT"], "-$", ""), second))).otherwise(s["_CONTENT"])
        kept = F.filter(line, lambda s: ~(part(s, 2) & (s["_SUBS_CONTENT"].isNotNull() | F.coalesce(part(last_first, 1), F.lit(False)))))
        return F.array_join(F.transform(kept, word), " ")

    return F.transform(strings, text)


def _alto_blocks(alto: Column) -> Column:
    blocks = F.flatten(_each(alto["Layout"]["Page"], lambda p: F.coalesce(p["PrintSpace"]["TextBlock"], F.array())))
    return _each(blocks, lambda b: _block_lines(b["TextLine"]))


def alto_lines(alto: Column) -> Column:
    """Lines of all blocks of all pages."""
    return F.flatten(_alto_blocks(alto))


def alto_text(alto: Column) -> Column:
    """The text of a document: its blocks, parted by a blank line; null where there is no document."""
    return F.array_join(F.transform(F.filter(_alto_blocks(alto), lambda b: F.size(b) > 0), lambda b: F.array_join(b, "\n")), "\n\n")


def page_lines(page: Column) -> Column:
    """Lines of all pages, by the first reading of each."""
    regions = F.flatten(_each(page["Page"], lambda p: p["TextRegion"]))
    return F.flatten(_each(regions, lambda r: _each(r["TextLine"], lambda x: F.coalesce(F.get(x["TextEquiv"], F.lit(0))["Unicode"], F.lit("")))))


def _bare_or_under(json: Column, kind: str, key: str) -> Column:
    """A JSON list, or the list under a key of an object."""
    return F.when(F.ltrim(json).startswith("{"), F.from_json(json, f"struct<{key}:{kind}>")[key]).otherwise(F.from_json(json, kind))


def read_entities(json: Column) -> Column:
    """Entity spans, from a bare list or under entities; null where broken, spans that end before their start dropped."""
    found = _bare_or_under(json, ENTITIES, "entities")
    return F.filter(found, lambda e: e["start"] <= e["end"])


def read_order(json: Column) -> Column:
    """Region names in reading order, from a bare list or under region_order."""
    return _bare_or_under(json, "array<string>", "region_order")


def canonical_text(json: Column) -> Column:
    """The first text that a canonical JSON document has under its usual keys."""
    # Keys of texts, in order of priority.
    return F.coalesce(*[F.get_json_object(json, f"$.{k}") for k in ("text", "content", "markdown", "plain", "value")])
