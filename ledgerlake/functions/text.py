"""Text functions as Spark expressions: normalising, hashing, shingles, flags and display."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Phrases and patterns that results depend on.
BOILERPLATE = (
    "forward looking statements",
    "actual results may differ materially",
    "safe harbor",
    "not undertake any obligation to update",
    "all rights reserved",
    "non gaap financial measures",
    "not a solicitation",
)
SIGNALS = ("revenue", "growth", "risk", "customer", "business", "management", "cash", "liquidity", "market", "competition", "operations")
INJECTIONS = (r"(?i)ignore\s+(all\s+)?previous\s+instructions", r"(?i)system\s+prompt", r"(?i)developer\s+message", r"(?i)you\s+are\s+now")
KEY_SECRET = r"\b(?:sk|pk)-[A-Za-z0-9_-]{8,}\b"
NAMED_SECRET = r"(?i)\b(api[_-]?key|token|password|secret)\s*[=:]\s*[^\s,;]+"
URL_SECRET = r"(?i)(https?://[^:/\s]+:)[^@/\s]+@"


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def strip(text: str | Column) -> Column:
    return F.regexp_replace(_col(text), r"^\s+|\s+$", "")


def content_hash(text: str | Column) -> Column:
    return F.sha2(_col(text).cast("binary"), 256)


def joined_hash(*parts: str | Column) -> Column:
    """sha256 of the parts joined by a bar; null parts are empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)


def normalise_document(text: str | Column) -> Column:
    """NUL becomes a space, runs of blanks one space, three and more line ends two; no white space at the ends."""
    blanks = F.regexp_replace(F.translate(_col(text), "\0", " "), "[ \\t\\r\\f\\x0B]+", " ")
    return strip(F.regexp_replace(blanks, "\\n{3,}", "\n\n"))


def lower_words(text: str | Column) -> Column:
    """Words of letters, digits and underscores in lower case, joined by one space; unlike folded ones, each letter stays (ß)."""
    return F.trim(F.regexp_replace(F.lower(_col(text)), r"[^\p{L}\p{N}_]+", " "))


def fingerprint_words(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z0-9]+"), 0)


def fingerprint_text(text: str | Column) -> Column:
    return F.array_join(fingerprint_words(text), " ")


def shingles(text: str | Column, size: int = 5) -> Column:
    """Distinct runs of `size` words; the distinct words of shorter texts."""
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.array_join(F.slice(w, i + 1, size), " "))
    return let(fingerprint_words(text), lambda w: F.array_distinct(F.when(F.size(w) < size, w).otherwise(runs(w))))


def jaccard(left: Column, right: Column) -> Column:
    """1 for two empty sets, 0 for one."""
    both, none = F.size(F.array_union(left, right)), (F.size(left) == 0) | (F.size(right) == 0)
    return F.when(both == 0, 1.0).when(none, 0.0).otherwise(F.size(F.array_intersect(left, right)) / both)


def is_boilerplate(text: str | Column) -> Column:
    return fingerprint_text(text).rlike("|".join(BOILERPLATE))


def has_signal(text: str | Column) -> Column:
    return fingerprint_text(text).rlike("|".join(SIGNALS))


def sentences(text: str | Column) -> Column:
    """Cut after . ! or ? and white space where a capital or digit follows."""
    return F.filter(F.transform(F.split(strip(text), "(?<=[.!?])\\s+(?=[A-Z0-9])"), strip), lambda s: s != "")


def cut_at_space(text: Column, most: int | Column) -> Column:
    """The first `most` characters up to their last space, all of them if there is none."""
    head = F.left(text, F.lit(most) if isinstance(most, int) else most)
    return strip(F.when(head.contains(" "), F.regexp_replace(head, " [^ ]*$", "")).otherwise(head))


def summary(text: str | Column, most_sentences: int = 3, most_chars: int = 900) -> Column:
    """Short texts whole; else the first sentence and those with signal words, cut at a space."""

    def pick(clean: Column) -> Column:
        chosen = lambda s: F.slice(F.concat(F.slice(s, 1, 1), F.filter(F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), has_signal)), 1, most_sentences)
        told = let(sentences(clean), lambda s: F.array_join(chosen(s), " "))
        return F.when(F.length(clean) <= most_chars, clean).otherwise(let(told, lambda t: F.when(F.length(t) > most_chars, cut_at_space(t, most_chars)).otherwise(t)))

    return let(normalise_document(text), pick)


def rough_tokens(text: str | Column) -> Column:
    """A quarter of the characters, rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.length(_col(text)) / 4)).cast("long")


def truncated(content: Column, tokens: Column) -> Column:
    """The content cut to four characters a token, back to the last space unless nothing is left."""
    head = F.left(content, (tokens * 4).cast("int"))
    return F.when(cut_at_space(content, (tokens * 4).cast("int")) == "", head).otherwise(cut_at_space(content, (tokens * 4).cast("int")))


def preview(text: str | Column, most: int = 360) -> Column:
    flat = strip(F.regexp_replace(_col(text), r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(cut_at_space(flat, most), F.lit("...")))


def injection_flags(text: str | Column) -> Column:
    return F.filter(F.array(*[F.when(_col(text).rlike(p), F.lit(f"pattern_{k}")) for k, p in enumerate(INJECTIONS, 1)]), lambda x: x.isNotNull())


def sanitised(text: str | Column, most: int = 100_000) -> Column:
    """Without control characters, with line feeds as line ends, cut to `most` characters."""
    plain = F.regexp_replace(_col(text), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")
    return F.left(F.regexp_replace(plain, "\\r\\n|\\r", "\n"), F.lit(most))


def redacted(text: str | Column, mark: str = "[REDACTED]") -> Column:
    plain = F.regexp_replace(_col(text), KEY_SECRET, mark)
    return F.regexp_replace(F.regexp_replace(plain, NAMED_SECRET, f"$1={mark}"), URL_SECRET, f"$1{mark}@")


def url_allowed(url: str | Column, hosts: tuple[str, ...]) -> Column:
    """https, an allowed host or its subdomain, no credentials, and no address literal."""
    scheme, host, user = (F.try_parse_url(_col(url), F.lit(part)) for part in ("PROTOCOL", "HOST", "USERINFO"))
    name = F.lower(host)
    fits = F.lit(False)
    for allowed in hosts:
        fits = fits | (name == allowed) | name.endswith("." + allowed)
    return F.coalesce((F.lower(scheme) == "https") & user.isNull() & fits & ~name.rlike(r"^[0-9.]+$|:"), F.lit(False))


def decimal_text(value: Column) -> Column:
    """Fixed notation without trailing zeros."""
    plain = value.cast("string")
    return F.when(plain.contains("."), F.regexp_replace(plain, "\\.?0+$", "")).otherwise(plain)


# The words for sums of money, the largest first.
MONEY_WORDS = {"trillion": 1e12, "billion": 1e9, "million": 1e6}


def display_value(value: Column, unit: Column, largest: str = "trillion") -> Column:
    """Money in trillions, billions or millions, none above `largest`; percent with its sign; thousands separators, no trailing zeros."""
    shown = lambda x: F.regexp_replace(F.format_number(F.bround(x, 2), 2), "\\.?0+$", "")
    size, top = F.abs(value), MONEY_WORDS[largest]
    money = F.concat(F.lit("USD "), F.coalesce(*[F.when(size >= one, F.concat(shown(value / one), F.lit(f" {word}"))) for word, one in MONEY_WORDS.items() if one <= top], shown(value)))
    return F.when(F.upper(unit) == "USD", money).when(F.lower(unit) == "percent", F.concat(shown(value), F.lit("%"))).otherwise(F.concat_ws(" ", shown(value), unit))


def answer_pieces(text: str | Column, most: int = 120) -> Column:
    """Words packed greedily into pieces of at most `most` characters; a longer word is a piece of its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    add = lambda a, w: F.when(a["now"] == "", F.struct(a["done"].alias("done"), w.alias("now"))).when(F.length(a["now"]) + 1 + F.length(w) <= most, F.struct(a["done"].alias("done"), F.concat_ws(" ", a["now"], w).alias("now"))).otherwise(F.struct(F.array_append(a["done"], a["now"]).alias("done"), w.alias("now")))
    return F.aggregate(F.filter(F.split(strip(text), r"\s+"), lambda w: w != ""), start, add, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.array_append(a["done"], a["now"])))


def retrieval_period(fiscal_year: Column, fiscal_period: Column, period_end: Column) -> Column:
    """Year and period, else the period's last day."""
    return F.coalesce(F.when(fiscal_year.isNotNull() & (fiscal_period != ""), F.concat_ws(":", fiscal_year.cast("string"), fiscal_period)), period_end.cast("string"))


def context_period(fiscal_year: Column, fiscal_period: Column) -> Column:
    """Year and period, else the year."""
    return F.coalesce(F.when(fiscal_year.isNotNull() & (fiscal_period != ""), F.concat_ws(":", fiscal_year.cast("string"), fiscal_period)), fiscal_year.cast("string"))


def filing_url(cik: Column, accession: Column, document: Column) -> Column:
    return F.concat_ws("/", F.lit("https://www.sec.gov/Archives/edgar/data"), cik.cast("long").cast("string"), F.replace(accession, F.lit("-"), F.lit("")), document)


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """A share with 0 for an empty whole."""
    return F.when(whole <= 0, 0.0).otherwise(F.bround(part / F.greatest(whole, F.lit(1)), digits))


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    """A share with 1 for an empty whole."""
    return F.when(whole == 0, 1.0).otherwise(F.bround(part / F.greatest(whole, F.lit(1)), digits))


def event_key(prefix: str, *parts: str | Column) -> Column:
    """A stable key of an event: the prefix, a colon, and the hash of its parts."""
    return F.concat(F.lit(f"{prefix}:"), joined_hash(*parts))


def year_before(day: Column) -> Column:
    """The same day a year earlier; 29 February gives the 28th."""
    return F.add_months(day, -12)


def without_trailing_date(label: str | Column) -> Column:
    """The label without a last word that is a valid ISO date; a label that is nothing else stays."""
    text = strip(label)
    last = F.regexp_extract(text, r"\s(\d{4}-\d{2}-\d{2})$", 1)
    return F.when(F.try_to_date(last).isNotNull(), strip(F.regexp_replace(text, r"\s\S+$", ""))).otherwise(text)


# What a series' label ends with by operation.
OPERATION_MARKS = {"year_over_year_growth": "YoY", "quarter_over_quarter_growth": "QoQ", "cagr": "CAGR", "rolling_average": "rolling average", "normalized_index": "index"}


def series_label(label: Column, operation: Column) -> Column:
    """The label with its operation's mark, unless it already holds it in any case."""
    mark = F.coalesce(*[F.when(operation == name, mark) for name, mark in OPERATION_MARKS.items()], F.lit(""))
    return F.when((mark == "") | F.contains(F.lower(label), F.lower(mark)), label).otherwise(F.concat_ws(" ", label, mark))


def normalised_cik(cik: str | Column) -> Column:
    """Ten digits; null for what is no number of at most ten digits."""
    digits = strip(cik)
    return F.when(digits.rlike(r"^\d{1,10}$"), F.lpad(digits, 10, "0"))


def normalised_ticker(ticker: str | Column) -> Column:
    """Upper case without a leading dollar sign or any space."""
    return F.upper(F.regexp_replace(F.regexp_replace(_col(ticker), r"\s+", ""), r"^\$", ""))


def names_mention(name: Column, mention: Column) -> Column:
    """Whether a folded name begins with a folded mention of at least four characters, or of several words."""
    long_enough = (F.length(mention) >= 4) | mention.contains(" ")
    return F.coalesce(long_enough & ((name == mention) | name.startswith(mention)), F.lit(False))


def number_display(text: str | Column) -> Column:
    """The text with numbers before USD, percent or % as `display_value` shows them; each is rewritten in its place.

    Numbers may have thousands separators and decimals. A piece is a run of other text and one number with its unit.
    """
    number = r"-?\d[\d,]*(?:\.\d+)?"
    unit = r"(?:\s?USD\b|\s?percent\b|\s?%)"
    parts = F.regexp_extract_all(_col(text), F.lit(rf"(?s)(?:(?!(?<![\w.,-]){number}{unit}).)+|{number}{unit}"), 0)

    def shown(piece: Column) -> Column:
        value = F.replace(F.regexp_extract(piece, rf"^({number}){unit}$", 1), F.lit(","), F.lit("")).try_cast("double")
        kind = F.when(piece.endswith("USD"), "USD").otherwise("percent")
        return F.when(value.isNull(), piece).otherwise(display_value(value, kind))

    return F.array_join(F.transform(parts, shown), "")
