"""Entity resolution in batches: labels found in texts, and extracted mentions ranked against companies.

Labels are found by equality: a text's word runs, of the lengths that labels have, are joined to the labels, so the
work follows the texts and no text meets a label that it does not hold. Label tables follow the number of companies;
Spark broadcasts them only where their size allows it, and shuffles by label otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerlake.functions.text import let
from ledgerlake.functions.udfs import fold_company, fold_label

# Names of metrics and the phrases that stand for them, patterns, and words that name no company.
METRIC_ALIASES = {
    "revenue": ("revenue", "revenues", "sales", "net sales", "дохід", "виручка"),
    "net_income": ("net income", "net earnings", "profit", "чистий прибуток"),
    "operating_income": ("operating income", "operating profit", "операційний прибуток"),
    "assets": ("total assets", "assets", "активи"),
    "cash_and_equivalents": ("cash and cash equivalents", "cash", "грошові кошти"),
    "research_and_development_expense": ("research and development", "r&d expense", "r&d", "витрати на дослідження"),
    "operating_cash_flow": ("operating cash flow", "cash from operations", "операційний грошовий потік"),
    "free_cash_flow": ("free cash flow", "fcf", "вільний грошовий потік"),
    "employees": ("employees", "headcount", "працівники", "штат"),
}
ACCESSION = r"\b\d{10}-\d{2}-\d{6}\b"
DATE = r"\b20\d{2}-(?:0[1-9]|1[0-2])-(?:[0-2]\d|3[01])\b"
YEAR = r"\b(?:19\d{2}|20\d{2}|2100)\b"
YEAR_RANGE = r"(?i)\b(19\d{2}|20\d{2}|2100)\s*(?:to|through|[-–—])\s*(19\d{2}|20\d{2}|2100)\b"
FORM = r"(?i)\b(?:10-K|10-Q|8-K|20-F|40-F|6-K|S-1)\b"
PERIOD = r"(?i)\b(?:FY|Q[1-4]|H[12])\b"
NO_COMPANY = (
    "area", "bar", "bars", "cash", "chart", "charts", "graph", "graphs", "growth", "income", "line", "lines",
    "margin", "plot", "plots", "profit", "rate", "rates", "revenue", "sales", "scatter", "table",
)
SCORES = {"ticker": 100, "cik": 100, "marked_mention": 95, "mention_ticker": 90, "legal_exact": 85, "name_exact": 75, "legal_prefix": 70, "name_prefix": 60}
CLEAR_MARGIN = 15


def _found(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0))


def fiscal_years(text: Column, longest: int = 20) -> Column:
    """Years named, and those inside ranges of at most `longest` years, ascending."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(YEAR_RANGE), 1).alias("a"), F.regexp_extract_all(text, F.lit(YEAR_RANGE), 2).alias("b"))
    inside = F.transform(pairs, lambda p: let(p["b"].cast("int") - p["a"].cast("int"), lambda n: F.when((n >= 0) & (n <= longest), F.sequence(p["a"].cast("int"), p["a"].cast("int") + n)).otherwise(F.array().cast("array<int>"))))
    return F.array_sort(F.array_distinct(F.concat(_found(text, YEAR).cast("array<int>"), F.flatten(inside))))


def dates(text: Column) -> Column:
    """Days of this century that exist, in order of first mention."""
    return F.filter(F.transform(_found(text, DATE), lambda d: F.try_to_date(d, "yyyy-MM-dd")), lambda d: d.isNotNull())


def metrics(words: Column) -> Column:
    """Metrics named in a folded text, in the fixed order."""
    said = F.concat(F.lit(" "), words, F.lit(" "))
    plain = lambda alias: f" {alias.replace('&', ' ')} "
    held = [F.when(F.greatest(*[said.contains(plain(a)) for a in aliases]), F.lit(metric)) for metric, aliases in METRIC_ALIASES.items()]
    return F.filter(F.array(*held), lambda m: m.isNotNull())


def parsed(queries: DataFrame, text: str) -> DataFrame:
    """The rows with what patterns find in a text: accessions, forms, periods, years, dates, metrics. Null text: empty."""
    plain = F.coalesce(F.col(text), F.lit(""))
    return queries.withColumns({
        "accession_numbers": _found(plain, ACCESSION), "filing_forms": F.array_distinct(F.transform(_found(plain, FORM), F.upper)),
        "fiscal_periods": F.array_distinct(F.transform(_found(plain, PERIOD), F.upper)), "fiscal_years": fiscal_years(plain),
        "dates": dates(plain), "metrics": metrics(fold_label(plain)),
    })


def label_dictionary(companies: DataFrame, tickers: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """(label, company_id, match_kind) of all names, numbers, aliases and symbols, old symbols included; one kind a pair.

    Kinds are ranked as listed: of several kinds that give a company the same label the first stays.
    """
    sources = [
        companies.select("company_id", F.lit(0).alias("_rank"), F.lit("legal_name").alias("match_kind"), fold_label("legal_name").alias("label")),
        companies.select("company_id", F.lit(1), F.lit("display_name"), fold_label("display_name")),
        companies.select("company_id", F.lit(2), F.lit("cik"), fold_label("cik")),
        companies.select("company_id", F.lit(3), F.lit("normalized_name"), fold_company("legal_name")),
    ]
    if aliases is not None:
        sources.append(aliases.select("company_id", F.lit(4), F.lit("alias"), fold_label("alias")))
    if tickers is not None:
        sources.append(tickers.select("company_id", F.lit(5), F.lit("ticker"), fold_label("symbol")))
    every = sources[0]
    for more in sources[1:]:
        every = every.union(more)
    return every.filter("label <> ''").groupBy("label", "company_id").agg(F.min_by("match_kind", "_rank").alias("match_kind"))


def _runs(words: Column, size: int) -> Column:
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))
    return F.when(F.size(words) >= size, runs).otherwise(F.array().cast("array<string>"))


def word_runs(words: Column, shortest: int, longest: int) -> Column:
    """Distinct runs of words of the lengths allowed."""
    return F.array_distinct(F.concat(*[_runs(words, n) for n in range(shortest, longest + 1)])) if longest >= shortest else F.array().cast("array<string>")


def runs_named(rows: DataFrame, text: str, names: DataFrame, name: str, longest: int = 8, on: tuple[str, ...] = ()) -> DataFrame:
    """The rows beside each of the names that stands in their folded text as whole words, on equal `on`.

    Names of up to `longest` words meet the text's runs of the lengths that occur. A longer one meets it at its first
    `longest` words, and is then looked for whole, so rows and expressions don't grow with the longest name.
    """
    words = F.size(F.split(name, " "))
    head = names.withColumn("_head", F.array_join(F.slice(F.split(name, " "), 1, longest), " "))
    found = {r[0] for r in names.select(F.least(words, F.lit(longest + 1)).alias("n")).distinct().collect()}  # at most `longest` + 1 numbers
    lengths = sorted({min(n, longest) for n in found})
    if not lengths:
        return rows.limit(0).join(head.limit(0).drop("_head"), list(on)) if on else rows.limit(0).crossJoin(head.limit(0).drop("_head"))
    runs = F.array_distinct(F.concat(*[_runs(F.split(text, " "), n) for n in lengths]))
    told = rows.withColumn("_head", F.explode(runs))
    if max(found) <= longest:  # no name needs the whole text, which then isn't moved with each of its runs
        return told.drop(text).join(head, ["_head", *on]).drop("_head")
    met = told.join(head, ["_head", *on]).drop("_head")
    return met.filter((words <= longest) | F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), name, F.lit(" ")))).drop(text)


def label_matches(queries: DataFrame, labels: DataFrame, key: str, text: str, longest: int = 8, fold: Callable[[Column], Column] = fold_label) -> DataFrame:
    """(key, mention, status, company_id, n_companies, match_kind) of the companies that each text names.

    `labels` has label, company_id, match_kind; labels of over `longest` words are refused. A label inside a longer
    matched one is dropped. Labels of the same companies count once, the longest first. A label of several companies
    is ambiguous and has no company_id. `fold` makes a text's words, joined by one space, alike to those of the labels.
    """
    bounds = labels.agg(F.min(F.size(F.split("label", " "))).alias("a"), F.max(F.size(F.split("label", " "))).alias("b")).first()
    if bounds["b"] is not None and bounds["b"] > longest:
        raise ValueError(f"labels have up to {bounds['b']} words; {longest} are allowed")
    low, high = (bounds["a"], bounds["b"]) if bounds["b"] is not None else (1, 0)
    grouped = labels.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_companies"), F.min("company_id").alias("_first"), F.min_by("match_kind", "company_id").alias("match_kind"),
        F.struct(F.count(F.lit(1)).alias("n"), F.min("company_id").alias("m"), F.bit_xor(F.xxhash64("company_id")).alias("x"), F.bit_xor(F.xxhash64("company_id", F.lit(1))).alias("y")).alias("_set"),
    )
    runs = queries.select(key, F.split(fold(F.coalesce(F.col(text), F.lit(""))), " ").alias("_w")).select(key, F.explode(word_runs(F.col("_w"), low, high)).alias("label"))
    found = runs.join(grouped, "label")
    parts = let(F.split("label", " "), lambda w: F.filter(word_runs(w, 1, max(high - 1, 1)), lambda r: F.length(r) < F.length(F.array_join(w, " "))))
    inner = found.select(F.col(key).alias("_key"), F.explode(parts).alias("_part")).distinct()
    outer = found.join(inner, F.col(key).eqNullSafe(F.col("_key")) & (F.col("label") == F.col("_part")), "left_anti")
    first = F.struct((-F.length("label")).alias("n"), F.col("label").alias("l"))
    once = outer.groupBy(key, "_set").agg(F.min_by(F.struct("label", "n_companies", "_first", "match_kind"), first).alias("_m"))
    alone = F.col("_m.n_companies") == 1
    return once.select(key, F.col("_m.label").alias("mention"), F.when(alone, "resolved").otherwise("ambiguous").alias("status"), F.when(alone, F.col("_m._first")).alias("company_id"), F.col("_m.n_companies").alias("n_companies"), F.col("_m.match_kind").alias("match_kind"))


def accession_matches(queries: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """(key, accession_number, document_id, status) of every accession that `parsed` found."""
    asked = queries.select(key, F.explode("accession_numbers").alias("accession_number"))
    known = documents.filter("accession_number is not null").groupBy("accession_number").agg(F.min("document_id").alias("document_id"))
    return asked.join(known, "accession_number", "left").select(key, "accession_number", "document_id", F.when(F.col("document_id").isNull(), "unresolved").otherwise("resolved").alias("status"))


def normal_ticker(value: Column) -> Column:
    """Upper case without a leading dollar; null for nothing or several words."""
    plain = F.regexp_replace(F.upper(F.trim(value)), r"^\$", "")
    return F.when((plain != "") & ~plain.contains(" "), plain)


def normal_cik(value: Column) -> Column:
    """Ten digits, zeros in front; null for anything but one to ten digits."""
    plain = F.trim(value)
    return F.when(plain.rlike(r"^\d{1,10}$"), F.lpad(plain, 10, "0"))


def distinct_mentions(mentions: DataFrame, order: str) -> DataFrame:
    """The first of the mentions that are equal but for the case of mention, ticker and legal name."""
    keys = {"_a": F.lower("mention"), "_b": F.lower("ticker"), "_c": F.col("cik"), "_d": F.lower("legal_name")}
    rest = F.struct(*mentions.columns)
    return mentions.withColumns(keys).groupBy(*keys).agg(F.min_by(rest, order).alias("_r")).select("_r.*")


def _best_two(held: DataFrame, value: str) -> DataFrame:
    """The two best companies (ticker, score) of each value, ties by ticker; nobody asks for a third."""
    best = held.groupBy(value, "ticker").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy(value).orderBy(F.desc("score"), "ticker"))
    return best.withColumn("_place", place).filter("_place <= 2").drop("_place")


def _named(asked: DataFrame, labels: DataFrame, value: str, exact: int, prefix: int, kind: str) -> DataFrame:
    """Companies whose label is the value or begins with it, at a word's end: equality with every leading run of a label's words.

    A run that many companies share has its two best, so pairs grow with the mentions: a mention's best two among all
    its evidence are among the best two of each kind.
    """
    heads = labels.withColumn("_heads", let(F.split("label", " "), lambda w: F.transform(F.sequence(F.lit(1), F.size(w)), lambda n: F.array_join(F.slice(w, 1, n), " "))))
    heads = heads.select("ticker", "label", F.explode("_heads").alias("_head"))
    whole = F.col("_head") == F.col("label")
    long_enough = (F.length("_head") >= 4) | F.col("_head").contains(" ")
    best = _best_two(heads.filter(whole | long_enough).select("_head", "ticker", F.when(whole, exact).otherwise(prefix).alias("score")), "_head")
    return asked.filter(F.col(value) != "").join(best, F.col(value) == F.col("_head")).select("mention_id", "ticker", "score", F.lit(kind).alias("match_kind"))


def rank_companies(mentions: DataFrame, companies: DataFrame) -> DataFrame:
    """(mention_id, status, ticker, score, match_kind, runner_up) of each extracted mention; unresolved without candidates.

    `mentions` has mention_id, mention, ticker, cik, legal_name; `companies` has ticker, cik, name, one row a ticker.
    A name that is some company's whole label, and clearly so, beats hints. Names shared without a clear winner are
    ambiguous. Else all evidence is scored and the best must lead by the margin.
    """
    listed = companies.select(F.upper("ticker").alias("ticker"), normal_cik(F.col("cik")).alias("_cik"), fold_company("name").alias("label"))
    labels = listed.filter("label <> ''").select("ticker", "label")
    said = mentions.select("mention_id", F.trim("mention").alias("_said"), normal_ticker(F.col("ticker")).alias("_hint"), normal_ticker(F.col("mention")).alias("_own"), normal_cik(F.col("cik")).alias("_number"), fold_label("mention").alias("_word"), fold_company("mention").alias("_name"), fold_company("legal_name").alias("_legal"), (F.coalesce(F.col("cik") != "", F.lit(False)) | F.coalesce(F.col("legal_name") != "", F.lit(False))).alias("_backed"))
    marked, common = F.col("_said").startswith("$"), F.col("_word").isin(*NO_COMPANY)
    own = listed.select(F.col("ticker").alias("_listed"))
    said = said.join(own, F.col("_own") == F.col("_listed"), "left").withColumns({
        "_explicit": F.coalesce(F.col("_listed").isNotNull() & (marked | ((F.length("_own") > 1) & ~common)), F.lit(False)),
        "_no_name": common, "_no_ticker": ~marked & ~F.col("_backed") & common,
    }).drop("_listed")
    open_ticker = said.filter(~F.col("_no_ticker"))
    by = lambda rows, mine, theirs, score, kind: rows.join(listed, F.col(mine) == F.col(theirs)).select("mention_id", "ticker", score.alias("score"), F.lit(kind).alias("match_kind"))
    numbers = _best_two(listed.filter("_cik is not null").select("_cik", "ticker", F.lit(SCORES["cik"]).alias("score")), "_cik")
    names = _named(said.filter(~F.col("_no_name") | F.col("_backed")), labels, "_name", SCORES["name_exact"], SCORES["name_prefix"], "company_name")
    evidence = (
        by(open_ticker, "_hint", "ticker", F.lit(SCORES["ticker"]), "ticker")
        .unionByName(by(open_ticker, "_own", "ticker", F.when(F.col("_said").startswith("$"), SCORES["marked_mention"]).otherwise(SCORES["mention_ticker"]), "mention_ticker"))
        .unionByName(said.join(numbers, F.col("_number") == F.col("_cik")).select("mention_id", "ticker", "score", F.lit("cik").alias("match_kind")))
        .unionByName(_named(said, labels, "_legal", SCORES["legal_exact"], SCORES["legal_prefix"], "legal_name"))
        .unionByName(names)
    )
    best = evidence.groupBy("mention_id", "ticker").agg(F.max("score").alias("score"), F.max_by("match_kind", "score").alias("match_kind"))
    scored = _top_two(best, "a_")
    named = _top_two(_named(said.filter(~F.col("_explicit") & ~F.col("_no_name")), labels, "_name", 100, 80, "company_name").groupBy("mention_id", "ticker").agg(F.max("score").alias("score"), F.max("match_kind").alias("match_kind")), "n_")
    every = said.select("mention_id").join(named, "mention_id", "left").join(scored, "mention_id", "left")
    lead = lambda p: F.col(f"{p}second").isNull() | (F.col(f"{p}score") >= F.col(f"{p}second") + CLEAR_MARGIN)
    clear_name = F.col("n_score").isNotNull() & (F.col("n_score") >= 100) & lead("n_")
    shared_name = F.col("n_second").isNotNull() & ~lead("n_")
    status = F.when(clear_name, "resolved").when(shared_name, "ambiguous").when(F.col("a_score").isNull(), "unresolved").when(lead("a_"), "resolved").otherwise("ambiguous")
    pick = lambda c: F.when(clear_name, F.col(f"n_{c}")).when(~shared_name & lead("a_"), F.col(f"a_{c}"))
    return every.select("mention_id", status.alias("status"), pick("ticker").alias("ticker"), pick("score").alias("score"), pick("match_kind").alias("match_kind"))


def _top_two(ranked: DataFrame, prefix: str) -> DataFrame:
    """The best candidate of each mention and the runner-up's score, as columns with a prefix."""
    place = F.row_number().over(W.partitionBy("mention_id").orderBy(F.desc("score"), "ticker"))
    top = ranked.withColumn("_place", place).filter("_place <= 2")
    first = F.col("_place") == 1
    of_first = lambda c: F.max(F.when(first, F.col(c))).alias(f"{prefix}{c}")
    return top.groupBy("mention_id").agg(of_first("ticker"), of_first("score"), of_first("match_kind"), F.max(F.when(~first, F.col("score"))).alias(f"{prefix}second"))


def tickers_named(queries: DataFrame, companies: DataFrame, key: str, text: str, most: int = 5) -> DataFrame:
    """(key, ticker, match_kind): at most `most` companies a text names by symbol, then by a label of four characters or more.

    Symbols are case-sensitive runs of letters and digits; those of one letter need a dollar before them.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    symbols = F.array_distinct(F.regexp_extract_all(plain, F.lit(r"(?<![A-Za-z0-9])\$?[A-Za-z0-9.]*[A-Za-z0-9](?![A-Za-z0-9])"), 0))
    # a symbol of one letter has two characters with its dollar
    bare = queries.select(key, F.explode(F.filter(symbols, lambda s: F.length(s) > 1)).alias("_s")).select(key, F.regexp_replace("_s", r"^\$", "").alias("ticker"))
    by_symbol = bare.join(companies.select("ticker"), "ticker").select(key, "ticker", F.lit(0).alias("_rank"))
    labels = companies.select(F.col("ticker").alias("company_id"), fold_company("name").alias("label"), F.lit("company_name").alias("match_kind")).filter("length(label) >= 4")
    by_label = runs_named(queries.select(key, fold_label(plain).alias("_t")), "_t", labels, "label").select(key, F.col("company_id").alias("ticker"), F.lit(1).alias("_rank"))
    every = by_symbol.unionByName(by_label).groupBy(key, "ticker").agg(F.min("_rank").alias("_rank"))
    place = F.row_number().over(W.partitionBy(key).orderBy("_rank", "ticker"))
    return every.withColumn("_place", place).filter(F.col("_place") <= most).select(key, "ticker", F.when(F.col("_rank") == 0, "ticker").otherwise("company_name").alias("match_kind"))


def refers_back(text: Column, markers: tuple[str, ...], companies: Column) -> Column:
    """Whether a follow-up points at earlier companies: a marker as whole words, and two of them at least."""
    said = F.concat(F.lit(" "), fold_label(F.coalesce(text, F.lit(""))), F.lit(" "))
    marked = F.greatest(F.lit(False), *[said.contains(f" {m} ") for m in markers])
    return marked & (F.size(F.array_distinct(companies)) >= 2)


# Single words that name no company, though one's name may begin with them.
PREFIX_STOPWORDS = ("a", "an", "and", "company", "corp", "corporation", "inc", "llc", "ltd", "the")


def explicit_mentions(candidates: DataFrame, key: str = "question_id", question: str = "question") -> DataFrame:
    """(key, mention, ticker, cik, legal_name) of the candidates that their question names, each as the question has it.

    `candidates` has a row a candidate: the question beside mention, ticker, cik and legal_name. The mention itself comes
    first, then the ticker (of one letter only behind a dollar), then the first words of the legal name, then of the mention: four
    at most, the longest run that stands in the question. Candidates alike in all but case are one, the first by mention.
    """
    said = lambda phrase: F.concat(F.lit(" "), fold_label(F.coalesce(F.col(question), F.lit(""))), F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" "))) & (phrase != "")
    ticker = F.regexp_replace(F.upper(F.trim("ticker")), r"^\$", "")
    dollar = F.when(F.length(ticker) == 1, r"\$").otherwise(r"\$?")
    by_ticker = F.coalesce((ticker != "") & F.regexp_like(F.col(question), F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])"), dollar, F.lit(r"\Q"), F.replace(ticker, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![A-Za-z0-9])"))), F.lit(False))

    def prefix(name: str) -> Column:
        words = F.slice(F.regexp_extract_all(F.coalesce(F.col(name), F.lit("")), F.lit(r"(?U)(\w+)")), 1, 4)
        runs = F.transform(F.reverse(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)))), lambda n: F.array_join(F.slice(words, 1, n), " "))
        return F.when(F.size(words) > 0, runs).otherwise(F.array().cast("array<string>"))

    rows = candidates.withColumns({"_by_ticker": by_ticker, "_q": F.concat(F.lit(" "), fold_label(F.coalesce(F.col(question), F.lit(""))), F.lit(" ")), "_whole": F.coalesce(said(fold_label(F.coalesce("mention", F.lit("")))), F.lit(False))})
    # runs of words are folded a run a row, then the longest that stands in the question is taken
    tagged = rows.withColumn("_id", F.xxhash64(key, question, "mention", "ticker", "cik", "legal_name")).dropDuplicates(["_id"])
    every = tagged.select("_id", "_q", F.posexplode(F.concat(prefix("legal_name"), prefix("mention"))).alias("_place", "_run"))
    folded = every.withColumn("_f", fold_label("_run"))
    met = folded.filter((F.col("_f") != "") & ~F.col("_f").isin(*PREFIX_STOPWORDS) & F.col("_q").contains(F.concat(F.lit(" "), "_f", F.lit(" "))))
    best = met.groupBy(F.col("_id").alias("_of")).agg(F.min_by("_run", "_place").alias("_prefix"))
    named = tagged.join(best, F.col("_id") == F.col("_of"), "left").withColumn("_m", F.when(F.col("_whole"), F.col("mention")).when(F.col("_by_ticker"), F.col("ticker")).otherwise(F.col("_prefix"))).filter("_m is not null")
    own = W.partitionBy(key, fold_label("_m"), "ticker", "cik", fold_label(F.coalesce("legal_name", F.lit("")))).orderBy("_m", "_id")
    return named.withColumn("_n", F.row_number().over(own)).filter("_n = 1").select(key, F.col("_m").alias("mention"), "ticker", "cik", "legal_name")
