"""Secret scanner: fixed base patterns and an assignment-aware lexer with constant propagation.

The lexer reads source and configuration syntax as name-literal pairs: assignments and joins of strings, entries of
dictionaries and nested blocks, bare values of configuration lines, options of commands, XML elements and attributes,
and what comments hold of these. It follows names that stand for earlier literals and scores each literal by the words
of the name it ends up in, or of a block around it, and by its own look.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "lexed")
# The base patterns and their least lengths (of group 2 for the first).
_ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_LEAST_ASSIGN = 6

#: Words of a name and how much they speak for a secret; pairs of neighbouring words count too.
_NAME_SCORES = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "credential": 0.9, "credentials": 0.9, "cred": 0.8, "creds": 0.8, "apikey": 1.0, "auth": 0.6, "api key": 1.0, "access key": 1.0, "private key": 1.0, "signing key": 1.0, "encryption key": 1.0, "secret key": 1.0, "client secret": 1.0}
#: Words that tell of something about a secret rather than of the secret.
_NAME_AGAINST = {"count", "length", "len", "size", "max", "min", "limit", "field", "label", "name", "hint", "url", "uri", "path", "file", "type", "policy", "expiry", "expires", "ttl", "header", "prompt", "regex", "pattern", "id"}
_STEMS = ("pass", "pwd", "secret", "token", "cred", "auth", "key")
#: Least product of the name's and the literal's score.
THRESHOLD = 0.4

_STRING = r"\"{3}(?:[^\\]|\\.)*?\"{3}|'{3}(?:[^\\]|\\.)*?'{3}|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"
_NAME = r"[A-Za-z_$][\w$]*(?:[.\-][A-Za-z_$][\w$]*)*"
_TERM = rf"(?:{_STRING}|{_NAME})"
#: name [type] operator expression of strings and names. The target may be quoted or end in a quoted index.
_PAIR = re.compile(
    rf"(?<![\w$.\-])(?:[\"']({_NAME})[\"']|({_NAME}))(?:\[[\"']({_NAME})[\"']\])?[ \t]*(?::[ \t]*[A-Za-z_][\w.\[\]<>]*[ \t]*=|\+=|\.=|\|\|=|\?=|:=|=>|=(?!=)|:)[ \t]*(?:[rbuf](?=[\"']))?"
    rf"({_TERM}(?:[ \t]*[+.&]?[ \t]*(?:{_STRING})|[ \t]*[+&][ \t]*{_NAME})*)"
)
#: A whole line of configuration: name = bare value.
_LINE = re.compile(rf"(?m)^[ \t]*(?:export[ \t]+|set[ \t]+|setx[ \t]+|ENV[ \t]+|-[ \t]+)*({_NAME})[ \t]*(\+=|\?=|:=|[:=])[ \t]*([^\s\"'`#;,{{}}\[\]()<>]+)[ \t]*$")
#: Options of a command: --name value or --name=value.
_OPTION = re.compile(rf"(?<!\S)--({_NAME})(?:=|[ \t]+)(?:({_STRING})|([^\s\"'`;|&<>-][^\s\"'`;|&<>]*))")
#: XML: an element's text, what names an attribute and what gives its value, and what neither may cross.
_ELEMENT = re.compile(rf"<({_NAME})(?:[ \t]+(?:name|key|id)[ \t]*=[ \t]*[\"']({_NAME})[\"'])?[ \t]*>[ \t]*([^<>\s][^<>\n]*)</\1>")
_NAMING = re.compile(rf"\b(?:name|key|id)[ \t]*=[ \t]*[\"']({_NAME})[\"']")
_VALUE = re.compile(rf"\bvalue[ \t]*=[ \t]*({_STRING})")
_BREAK = re.compile(r"[<>\n]")
_PART = re.compile(rf"({_STRING})|({_NAME})")
#: Strings, in which the marks of comments mean nothing, comments to the end of a line, and marks that open longer ones.
_COMMENT = re.compile(rf"({_STRING})|(?:(?<=\s)|^)(?:#|//|;)[^\n]*|(/\*|<!--)", re.M)
_CLOSES = {"/*": "*/", "<!--": "-->"}
#: What opens and closes a nested block, with its name, and the heads of indented blocks.
_BLOCK = re.compile(rf"({_STRING})(?![ \t]*[:=]?[ \t]*\{{)|(?:[\"']?({_NAME})[\"']?[ \t]*[:=]?[ \t]*)?([{{])|([}}])")
_HEAD = re.compile(rf"(?m)^([ ]*)(?:-[ ]+)?[\"']?({_NAME})[\"']?:[ \t]*$")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|changeme|change_me|none|null|true|false|undefined|example.*|your[_\- ].*|my[_\- ]?(?:password|secret|token)|todo|test|password|secret|token|redacted)$|^\$\w+$|\$[{(]|\{\{|^\{[^{}]*\}$|<[^<>]*>|%\(|^%\w+%$|^\w+\(.*\)$|\s")
#: Share of an enclosing block's score that its members have.
INHERITED = 0.8


def name_score(name: str) -> float:
    """0 to 1: how surely a literal under this name is a secret."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if any(w in _NAME_AGAINST for w in words[-1:]) or any(w in ("max", "min", "count") for w in words):
        return 0.0
    pairs = [" ".join(p) for p in zip(words, words[1:], strict=False)]
    return max((_NAME_SCORES.get(w, 0.0) for w in words + pairs), default=0.0)


def nested_score(name: str, around: tuple[str, ...]) -> float:
    """name_score, or a share of that of a block around the name unless the name speaks against it."""
    own, words = name_score(name), _WORDS.findall(name)
    if own or words and words[-1].lower() in _NAME_AGAINST:
        return own
    return INHERITED * max((name_score(n) for n in around), default=0.0)


def literal_score(value: str) -> float:
    """0 to 1: how much a literal looks like a secret; placeholders and text with spaces score 0."""
    if len(value) < 6 or _PLACEHOLDER.search(value):
        return 0.0
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, entropy / 4.0 + 0.15 * (kinds - 1))


def _quoted(text: str, a: int, b: int) -> tuple[str, int, int]:
    """A string's inside."""
    marks = 3 if text[a : a + 3] in ('"""', "\'\'\'") and b - a >= 6 else 1
    return "s", a + marks, b - marks


def _pairs(view: str) -> list[tuple[int, str, str, list[tuple[str, int, int]]]]:
    """(place, name, operator, terms) of every assignment; a term is a string (s), a name (n) or a bare value (b)."""
    found = []
    for m in _PAIR.finditer(view):
        terms = [_quoted(view, *p.span(1)) if p[1] else ("n", *p.span(2)) for p in _PART.finditer(view, m.start(4), m.end(4))]
        found.append((m.start(), m[3] or m[1] or m[2], "+=" if view[m.start() : m.start(4)].rstrip().endswith(("+=", ".=")) else "=", terms))
    if "\n" in view or "=" in view or ":" in view:
        for m in _LINE.finditer(view):
            found.append((m.start(1), m[1], m[2], [("b", *m.span(3))]))
    if "--" in view:
        for m in _OPTION.finditer(view):
            found.append((m.start(), m[1], "=", [_quoted(view, *m.span(2)) if m[2] else ("b", *m.span(3))]))
    if "<" in view:
        found += [(m.start(), m[2] or m[1], "=", [("s", m.start(3), m.start(3) + len(m[3].rstrip(" \t")))]) for m in _ELEMENT.finditer(view)]
        found += _attributes(view)
    return sorted(found, key=lambda x: (x[0], x[3][-1][2]))


def _attributes(view: str) -> list[tuple[int, str, str, list[tuple[str, int, int]]]]:
    """Attributes that name something, each with the next that gives a value in the same tag and line, if any; in one pass."""
    found, values, at, past = [], list(_VALUE.finditer(view)), 0, 0
    breaks = [m.start() for m in _BREAK.finditer(view)] if values else []
    for m in _NAMING.finditer(view) if values else ():
        if m.start() < past:
            continue
        while at < len(values) and values[at].start() < m.end():
            at += 1
        if at == len(values):
            break
        k = bisect_left(breaks, m.end())
        if k == len(breaks) or breaks[k] > values[at].start():
            found.append((m.start(), m[1], "=", [_quoted(view, *values[at].span(1))]))
            past = values[at].end()
    return found


def _comments(text: str) -> list[tuple[int, int]]:
    """Spans of comments; a mark that is never closed opens none."""
    found, at, open_ = [], 0, set(_CLOSES)
    while m := _COMMENT.search(text, at):
        at = m.end()
        if m[2]:
            end = text.find(_CLOSES[m[2]], at) if m[2] in open_ else -1
            if end < 0:  # nor is any later one
                open_.discard(m[2])
                continue
            at = end + len(_CLOSES[m[2]])
        if not m[1]:
            found.append((m.start(), at))
    return found


def _blocks(view: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of the named blocks in braces and of those by indentation."""
    found, open_ = [], []
    if "{" in view:
        for m in _BLOCK.finditer(view):
            if m[3]:
                open_.append((m.start(3), m[2] or ""))
            elif m[4] and open_:
                start, name = open_.pop()
                found.append((start, m.end(), name))
        found += [(start, len(view), name) for start, name in open_]
    for m in _HEAD.finditer(view):
        depth, end = len(m[1]), m.end()
        while (line := re.compile(r"\n([ ]*)(?:([^\s])[^\n]*)?").match(view, end)) and (line[2] is None or len(line[1]) > depth or len(line[1]) == depth and line[2] == "-"):
            end = line.end()
        found.append((m.end(), end, m[2]))
    return [b for b in found if b[2]]


def _secrets(view: str) -> set[tuple[int, int]]:
    """Spans of literals of one view that reach a sensitive name, directly, by a join of parts or through other names."""
    blocks, inside, known, found = None, [], {}, set()
    for at, name, operator, terms in _pairs(view):
        spans: tuple[tuple[int, int], ...] = known.get(name, ()) if operator == "+=" else ()
        for kind, a, b in terms:
            value = view[a:b]
            refers = value in known or value[:1] == "$" or name_score(value) >= 0.5 and re.fullmatch(_NAME, value)
            if kind == "s" or kind == "b" and not refers:
                spans += ((a, b),)
            else:  # a name stands for what it was given; one that is unknown, for nothing
                spans += known.get(value, known.get(value.lstrip("$"), ()))
        spans = tuple(dict.fromkeys(spans))
        # a line that is read both as a pair of names and as a bare value is what either finds
        known[name] = spans or known.get(name, ()) if terms[0][0] == "b" else spans
        if spans:
            look = literal_score("".join(view[a:b] for a, b in spans))
            if look:
                if blocks is None:
                    blocks = sorted(_blocks(view), reverse=True)
                # pairs come in the order of the text, so each block is opened and closed once
                while blocks and blocks[-1][0] <= at:
                    inside.append(blocks.pop())
                inside = [b for b in inside if at < b[1]]
                if nested_score(name, tuple(b[2] for b in inside)) * look >= THRESHOLD:
                    found.update(s for s in spans if s[1] > s[0])
    return found


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans of literals that a sensitive name is given, in code and, apart from it, in comments.

    What a comment assigns is judged like the rest, but the code does not see it as a constant, nor one comment another's.
    """
    comments = _comments(text)
    code, at = [], 0
    for a, b in comments:
        code += [text[at:a], " " * (b - a)]
        at = b
    found = _secrets("".join([*code, text[at:]]))
    for a, b in comments:
        found.update((x + a + 1, y + a + 1) for x, y in _secrets(text[a + 1 : b]))
    return sorted(found)


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind; base matches and what the lexer adds."""
    if not text:
        return []
    low, out = text.lower(), []
    if any(w in low for w in _ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _LEAST_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    if any(s in low for s in _STEMS) and any(mark in text for mark in ("=", ":", "--", "<")):
        base = [(a, b) for _, a, b in out]
        out += [("lexed", a, b) for a, b in lexed(text) if not any(x <= a and b <= y for x, y in base)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with every span replaced by [kind]; overlapping spans become one, named after the first."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end) of every row of docs (doc_id, text).

    Whole texts are read. A null or empty text has no spans; repeated rows give repeated results; an empty table gives
    an empty one. No row needs another, so nothing is shuffled.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [find_spans(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans], kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, each secret in their text replaced by its kind in brackets.

    Null and empty texts stay as they are, repeated rows come back repeated, and an empty table gives an empty one.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            clean = pa.array([redacted(t, s) if t and (s := find_spans(t)) else t for t in texts], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), clean)

    return docs.mapInArrow(run, docs.schema)
