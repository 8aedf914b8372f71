"""Text column helpers built only from Spark SQL string functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Phrases that mark a text as market-wide news.
MARKET_PHRASES = (
    "s&p 500", "sp500", "nasdaq 100", "dow jones", "fomc", "federal reserve",
    "interest rates", "inflation", "cpi", "macroeconomic", "recession",
    "geopolitical", "global market", "central bank", "nonfarm payrolls",
)

# Answer words accepted as a recommendation.
RECOMMENDATION_WORDS = ("buy", "sell", "hold", "long", "short", "neutral", "wait")

# Conviction vocabulary.
HIGH_CONVICTION = ("strong", "clear", "compelling", "convincing", "robust", "definitive", "high conviction")
LOW_CONVICTION = ("weak", "uncertain", "mixed", "unclear", "marginal", "risk", "concern")

# Markers of each error class.
TRANSIENT_MARKERS = (
    "server disconnected without sending a response", "connection aborted", "connection reset",
    "read timeout", "request timed out", "timed out", "timeout", "temporarily unavailable",
    "502", "503", "504",
)
REFUSAL_MARKERS = ("text_au", "很抱歉", "无法提供相应的信息", "cannot provide", "unable to provide", "refusal")
QUOTA_MARKERS = ("没有可用token", "no available token", "resource has been exhausted", "quota", "resource_exhausted")

# Headings of a structured answer, and the seven that are extracted.
HEADINGS = (
    "Technical Analysis", "Fundamental Assessment", "Risk Assessment", "Price Target", "Catalysts",
    "Investment Thesis", "Timeline", "Final Recommendation", "Confidence",
)
SECTIONS = HEADINGS[:7]

# Source prefixes that carry no information on their own.
SOURCE_PREFIXES = ("YF:", "Alpaca:", "NYT:", "WM:", "WorldMonitor:")


def any_contains(text: Column, phrases) -> Column:
    """True when the text holds at least one phrase (plain substring)."""
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def count_contained(text: Column, phrases) -> Column:
    """Number of phrases the text holds."""
    return reduce(lambda a, b: a + b, [text.contains(p).cast("int") for p in phrases])


def strip(text: Column) -> Column:
    """Remove whitespace of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sanitize(text: Column, limit: int | None = None) -> Column:
    """Control whitespace to one blank, trim, double to single quotes; cut only where a limit is given."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n\t\x0B\f]+", " ")
    flat = F.translate(strip(flat), '"', "'")
    if limit is None:
        return flat
    return F.when(F.length(flat) > limit,
                  F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)


def shorten(text: Column, limit: int | None = None) -> Column:
    """Trim, and cut to the limit with an ellipsis where one is given; NULL becomes the empty text."""
    t = strip(F.coalesce(text, F.lit("")))
    if limit is None:
        return t
    return F.when(F.length(t) <= limit, t).otherwise(
        F.concat(F.regexp_replace(F.substring(t, 1, limit - 3), r"\s+$", ""), F.lit("...")))


def compose(title: Column | None, body: Column | None) -> Column:
    """'title. body' with missing parts as empty text; one-column form when only one exists."""
    blank = F.lit("")
    if title is not None and body is not None:
        return F.concat(F.coalesce(title, blank), F.lit(". "), F.coalesce(body, blank))
    return F.coalesce(title if title is not None else body, blank)


def safe_key(c: Column) -> Column:
    """Replace characters that are unsafe in a path by an underscore."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_\-. ]", "_")


def list_literal(text: Column) -> Column:
    """Elements of a list written as text, such as ['A', 'B'] or A,B."""
    bare = F.regexp_replace(text, r"[\[\]'\"]", "")
    return F.transform(F.split(bare, ","), lambda x: F.trim(x))


def normalize_ticker(c: Column) -> Column:
    """Trim, upper case, dot to hyphen."""
    return F.translate(F.upper(F.trim(c)), ".", "-")


def strip_tags(html: Column) -> Column:
    """Drop markup tags and collapse whitespace."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))


def article_hash(date: Column, title: Column, content: Column) -> Column:
    """md5 over date, title and the whole content."""
    blank = F.lit("")
    return F.md5(F.concat_ws("_", F.coalesce(date, blank), F.coalesce(title, blank), F.coalesce(content, blank)))


def words(text: Column) -> Column:
    """Whole words of a text: runs of letters, digits and underscore."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w != F.lit(""))


def normalize_recommendation(word: Column) -> Column:
    """Lower-cased word when it is an accepted recommendation, else NULL."""
    w = F.lower(word)
    return F.when(w.isin(*RECOMMENDATION_WORDS), w)


def recommendation(text: Column, fallback: tuple[str, ...] = ("hold", "sell", "buy")) -> Column:
    """Recommended action of a free-text answer.

    The last 'Final Recommendation: <word>' wins, then the first
    'Recommendation: <word>', then a keyword scan in the order of `fallback`
    (the older order is ("buy", "sell", "hold")), else 'unknown'.
    """
    tail = r"recommendation\s*[:\-]*\s*(?:\*\*|\*|#)?\s*([a-zA-Z]+)"
    finals = F.regexp_extract_all(text, F.lit(r"(?i)final\s+" + tail), F.lit(1))
    last = normalize_recommendation(F.try_element_at(finals, F.lit(-1)))
    first = normalize_recommendation(F.nullif(F.regexp_extract(text, r"(?i)" + tail, 1), F.lit("")))
    low = F.lower(text)
    pairs = {"hold": ("hold", "neutral"), "sell": ("sell", "short"), "buy": ("buy", "long")}
    scan = F.lit("unknown")
    for action in reversed(fallback):
        scan = F.when(any_contains(low, pairs[action]), F.lit(action)).otherwise(scan)
    return F.coalesce(last, first, scan)


def conviction(text: Column, recommended: Column) -> Column:
    """Confidence guessed from wording and length when none is stated."""
    low = F.lower(F.coalesce(text, F.lit("")))
    high_n, low_n = count_contained(low, HIGH_CONVICTION), count_contained(low, LOW_CONVICTION)
    base = (F.when((recommended == "hold") | low.contains("hold"), 0.55)
            .when(high_n > low_n, 0.75).when(low_n > high_n, 0.45).otherwise(0.60))
    n = F.length(low)
    adjusted = (F.when(n > 300, F.least(F.lit(0.95), base + 0.15))
                .when(n < 100, F.greatest(F.lit(0.35), base - 0.15)).otherwise(base))
    return F.greatest(F.lit(0.2), F.least(F.lit(0.95), adjusted))


def confidence(text: Column, recommended: Column, sections_text: Column | None = None) -> Column:
    """Stated confidence in [0, 1], else :func:`conviction` over `sections_text`.

    With `sections_text` left out the guess sees an empty text, as in the
    original order of steps, and yields 0.40 for hold and 0.45 otherwise.
    """
    stated = F.nullif(F.regexp_extract(text, r"(?is)confidence[^0-9]{0,40}([0-9]*\.?[0-9]+)", 1), F.lit(""))
    number = stated.try_cast("double")
    number = F.when(number > 1.0, number / 100.0).otherwise(number)
    number = F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    return F.coalesce(number, conviction(F.lit("") if sections_text is None else sections_text, recommended))


def section(text: Column, name: str, limit: int | None = None) -> Column:
    """Body below one heading, ending before the next known heading or the end of the text."""
    others = "|".join(h for h in HEADINGS if h != name)
    mark = r"(?:\*\*|##?\s*)?"
    pattern = (rf"(?is)(?:^|\n)\s*{mark}{name}(?:\*\*)?\s*[:\-]?\s*(.*?)"
               rf"(?=\n\s*{mark}(?:{others})(?:\*\*)?\s*[:\-]?\s*|\z)")
    return shorten(F.regexp_extract(text, pattern, 1), limit)


def error_class(message: Column) -> Column:
    """quota, refusal, transient or other, by markers in the lower-cased message."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return (F.when(any_contains(low, QUOTA_MARKERS), "quota")
            .when(any_contains(low, REFUSAL_MARKERS), "refusal")
            .when(any_contains(low, TRANSIENT_MARKERS), "transient").otherwise("other"))


def report_fields(report: Column) -> dict[str, Column]:
    """Verdict, decision and confidence of a written report.

    Verdict precedence: Final Recommendation, then the decision field, then the
    verdict field, then 'N/A'. Missing confidence is 0.
    """
    def pick(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(report, pattern, 1), F.lit(""))

    final = pick(r"\*\*Final Recommendation\*\*:\s*\*\*([A-Z_]+)\*\*")
    decision = pick(r"(?:Should Buy Now|Decision|Hold or Sell):\s*([A-Z]+)")
    verdict = pick(r"(?:Current\s+)?Verdict:\s*([A-Z_]+)")
    conf = pick(r"(?:Current\s+)?Confidence:\s*([0-9.]+)").try_cast("double")
    return {
        "verdict": F.coalesce(final, decision, verdict, F.lit("N/A")),
        "decision": F.coalesce(decision, F.lit("N/A")),
        "confidence": F.coalesce(conf, F.lit(0.0)),
    }


def tone(pos: Column, neg: Column) -> Column:
    """bullish / bearish / neutral from two sentiment shares; NULL when either is missing."""
    return (F.when(pos > neg, "bullish").when(neg > pos, "bearish")
            .when(pos.isNotNull() & neg.isNotNull(), "neutral"))
