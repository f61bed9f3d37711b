"""Functions that built-ins can't express, as Arrow-batched UDFs: HTML text, Unicode folding, sections."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F, types as T

# Names whose text is left out, the section patterns, and where the next item begins.
HIDDEN = frozenset({"script", "style", "noscript", "svg", "template"})
SECTIONS = {
    "business": ("Business", r"\bitem\s+1[\.\s:-]+business\b"),
    "risk_factors": ("Risk Factors", r"\bitem\s+1a[\.\s:-]+risk\s+factors\b"),
    "mda": ("Management's Discussion and Analysis", r"\bitem\s+7[\.\s:-]+management.?s\s+discussion\s+and\s+analysis\b"),
    "liquidity": ("Liquidity and Capital Resources", r"\bliquidity\s+and\s+capital\s+resources\b"),
    "market_risk": ("Market Risk", r"\bitem\s+7a[\.\s:-]+quantitative\s+and\s+qualitative\s+disclosures\b|\bitem\s+3[\.\s:-]+quantitative\s+and\s+qualitative\s+disclosures\b"),
    "competition": ("Competition", r"\bcompetition\b"),
    "strategy_outlook": ("Strategy and Outlook", r"\b(strategy|outlook)\b"),
}
NEXT_ITEM = r"\bitem\s+(?:1a|1b|2|3|4|5|6|7|7a|8|9|9a|9b)\b"
LEAST_BODY = 500
#: What each section's matches begin with; those not named here begin with an item.
OPENINGS = {"liquidity": ("liquidity",), "competition": ("competition",), "strategy_outlook": ("strategy", "outlook")}
#: So many rows of an Arrow batch are Python objects at a time.
ROWS_AT_ONCE = 64
LEGAL_SUFFIXES = ("public limited company", "limited liability company", "joint stock company", "corporation", "incorporated", "company", "limited", "corp", "inc", "ltd", "llc", "plc", "lp", "llp", "nv", "n v", "sa", "s a", "ag", "se", "spa", "s p a")
SECURITY_SUFFIXES = ("common stock", "ordinary shares", "class a", "class b", "class c")

_ITEM = re.compile(NEXT_ITEM)
_PATTERNS = {key: re.compile(pattern) for key, (_, pattern) in SECTIONS.items()}


def by_rows(make: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """An array of make(...) of each row, a few rows at a time."""
    parts = (zip(*(c.slice(i, ROWS_AT_ONCE).to_pylist() for c in columns), strict=True) for i in range(0, len(columns[0]), ROWS_AT_ONCE))
    return pa.concat_arrays([pa.array([], kind), *(pa.array([make(*row) for row in part], kind) for part in parts)])


def single_blanks(text: str) -> str:
    """Each run of blanks, line ends aside, as one space."""
    for mark in "\t\r\f\v":
        text = text.replace(mark, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text


class _Events(HTMLParser):
    """Text nodes as they stand, and 1 or -1 where a hidden element begins or ends."""

    def __init__(self, html: str):
        super().__init__()
        self.events: list[str | int] = []
        self.handle_data = self.events.append
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        self.events += [1] * (tag in HIDDEN)

    def handle_endtag(self, tag):
        self.events += [-1] * (tag in HIDDEN)


def text_of_html(html: str | None, hide: bool = True) -> str | None:
    """Stripped text nodes, one a line, without those of scripts and styles if `hide`."""
    if html is None:
        return None
    return _shown(_Events(html).events, hide)


def _shown(events: list[str | int], hide: bool) -> str:
    steps = [e if hide and isinstance(e, int) else 0 for e in events]
    # how many hidden elements are open: an end without a beginning closes none
    depths = accumulate(steps, lambda depth, step: max(0, depth + step))
    texts = (e.strip() for e, depth in zip(events, depths, strict=True) if isinstance(e, str) and not depth)
    return "\n".join(filter(None, texts))


@F.arrow_udf(T.StringType())
def html_text(html: pa.Array) -> pa.Array:
    return by_rows(text_of_html, pa.string(), html)


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("all_text", T.StringType())]))
def html_texts(html: pa.Array) -> pa.Array:
    """text, and all_text with scripts and styles, as the plain document decoder has it; parsed once for both."""

    def both(own: str | None) -> dict:
        events = None if own is None else _Events(own).events
        return {name: None if events is None else _shown(events, hide) for name, hide in (("text", True), ("all_text", False))}

    return by_rows(both, pa.struct([("text", pa.string()), ("all_text", pa.string())]), html)


def decoded(content: bytes | None, content_type: str | None = None) -> str | None:
    """UTF-8, else Latin-1; HTML (by type or by its first characters) becomes text; blanks normalised."""
    if content is None:
        return None
    try:
        text = content.decode()
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    head = text[:500].lower()
    if "html" in (content_type or "").lower() or any(mark in head for mark in ("<html", "<document", "<sec-document")):
        text = text_of_html(text)
    return re.sub(r"\n{3,}", "\n\n", single_blanks(text.replace("\0", " "))).strip()


@F.pandas_udf(T.StringType())
def decode_document(content: pd.Series, content_type: pd.Series) -> pd.Series:
    return pd.Series([decoded(c, t) for c, t in zip(content, content_type, strict=True)], dtype=object)


def lower_alike(text: str) -> str:
    """The text in lower case, character by character: patterns in lower case fit it where they fit the text in any case."""
    for mark, plain in (("İ", "i"), ("ı", "i"), ("ſ", "s"), ("\u212a", "k")):  # what else is i, s or k in any case
        text = text.replace(mark, plain)
    return text.lower()


def _places(text: str, word: str) -> list[int]:
    """Where the word stands in the text."""
    out, at = [], text.find(word)
    while at >= 0:
        out.append(at)
        at = text.find(word, at + 1)
    return out


def sections_of(text: str) -> list[dict]:
    """Each section's first place with a body of 500 characters before the next item, else its last place.

    Sections end where the next one or the next item begins: at the next mark of both, merged in order. Patterns are only
    tried where one of the words stands with which their matches begin.
    """
    low = lower_alike(text)
    labels = _places(low, "item")
    items = [at for at in labels if _ITEM.match(low, at)] + [len(text)]
    places: dict[int, str] = {}
    for key, pattern in _PATTERNS.items():
        starts = sorted(at for word in OPENINGS[key] for at in _places(low, word)) if key in OPENINGS else labels
        spans = [m.span() for at in starts if (m := pattern.match(low, at))]
        full = (a for a, b in spans if items[bisect_left(items, b)] - a >= LEAST_BODY)
        places |= {a: key for a in [next(full, spans[-1][0])]} if spans else {}
    marks = sorted({*items, *places})
    out = []
    for start in sorted(places):
        stop = marks[bisect_right(marks, start)] if start < len(text) else start
        own = text[start:stop].strip()
        out.append({"section_key": places[start], "title": SECTIONS[places[start]][0], "start": start, "stop": stop, "text_hash": hashlib.sha256(own.encode()).hexdigest()})
    return out


_SECTION = T.ArrayType(T.StructType([T.StructField("section_key", T.StringType()), T.StructField("title", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("text_hash", T.StringType())]))


_ARROW_SECTION = pa.list_(pa.struct([("section_key", pa.string()), ("title", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("text_hash", pa.string())]))


@F.arrow_udf(_SECTION)
def detect_sections(text: pa.Array) -> pa.Array:
    return by_rows(lambda x: None if x is None else sections_of(single_blanks(x)), _ARROW_SECTION, text)


def folded(label: str | None) -> str | None:
    """Compatibility form, case folded, words joined by one space."""
    return None if label is None else " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", label).casefold()))


def company_name(label: str | None) -> str | None:
    """The folded name without security and legal endings, taken off again and again but never to nothing."""
    name = folded(label)
    for suffixes in (SECURITY_SUFFIXES, LEGAL_SUFFIXES):
        while name and (found := next((s for s in suffixes if name.endswith(f" {s}")), None)):
            name = name[: -len(found) - 1]
    return name


@F.pandas_udf(T.StringType())
def fold_label(label: pd.Series) -> pd.Series:
    return label.map(folded)


@F.pandas_udf(T.StringType())
def fold_company(label: pd.Series) -> pd.Series:
    return label.map(company_name)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])))
def line_spans(lines: pd.Series, text: pd.Series) -> pd.Series:
    """Where each of a page's lines stands in the page's text, in characters: each is looked for after the one found before it, and null if it isn't there."""

    def spans(own, page: str | None) -> list | None:
        at, out = 0, []
        for line in [] if own is None else own:
            start = -1 if not line or not page else page.find(line, at)
            at = start + len(line) if start >= 0 else at
            out.append(None if start < 0 else {"start": start, "stop": at})
        return None if own is None else out

    return pd.Series([spans(*row) for row in zip(lines, text, strict=True)], dtype=object)
