"""Text expressions. All are built-in Spark expressions, so no text leaves the JVM.

Filters over arrays (a lambda) are interpreted; where rows of tokens are wanted, token_rows explodes first and filters rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = tuple(
    "a about all also an and are as at be been but by could did do for from had has have he i if in into is it its may more no not of on or out she should so "
    "than that the their then there they this to up was we what which who will with would you".split()
)
LOG_STOPWORDS = tuple("a an and for in of or the to".split())
#: English stop words for TF-IDF features; the same list goes into the checks.
ENGLISH = tuple(
    "about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for "
    "from further had has have having he her here hers him his how if in into is it its just me more most my no nor not now of off on once only or other our out over own "
    "same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who "
    "whom why will with would you your".split()
)


def tokens(c: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Runs of three or more ASCII letters, lower-cased, without stop words; duplicates stay."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-zA-Z]{3,}"), F.lit(0)), lambda t: ~t.isin(*stopwords))


def token_rows(c: Column) -> Column:
    """All words of three or more ASCII letters, lower-cased; rows that are stop words are dropped after exploding."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0))


def doc_text(title: Column, text: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))


def query_terms(q: Column) -> Column:
    """White-space words of three or more characters; no punctuation is stripped, duplicates stay."""
    return F.filter(F.split(F.trim(F.lower(F.coalesce(q, F.lit("")))), r"\s+"), lambda t: F.length(t) >= 3)


def log_terms(q: Column) -> Column:
    return F.filter(query_terms(q), lambda t: ~t.isin(*LOG_STOPWORDS))


def highlight(c: Column, q: Column) -> Column:
    """Marks occurrences of the query's words; text is unchanged if the query has none."""
    words = F.transform(query_terms(q), lambda t: F.concat(F.lit("\\Q"), t, F.lit("\\E")))
    marked = F.regexp_replace(c, F.concat(F.lit("(?i)("), F.array_join(words, "|"), F.lit(")")), F.lit("<mark>$1</mark>"))
    return F.when(F.size(query_terms(q)) > 0, marked).otherwise(c)


def embed_text(title: Column, snippet: Column) -> Column:
    """What an encoder sees: the title three times, then the snippet, 512 characters."""
    t = F.coalesce(title, F.lit(""))
    return F.substring(F.concat_ws(" ", t, t, t, F.coalesce(snippet, F.lit(""))), 1, 512)


def log_rank(message: Column) -> Column:
    return F.nullif(F.regexp_extract(message, r"rank\s+(\d+)", 1), F.lit("")).try_cast("int")


def log_url(message: Column) -> Column:
    return F.nullif(F.regexp_extract(message, r"https?://\S+", 0), F.lit(""))


def hour_of(iso: Column) -> Column:
    """Characters 12 and 13 of an ISO time stamp's text, null if it is shorter."""
    return F.when(F.length(iso) >= 13, F.substring(iso, 12, 2))


def features(c: Column) -> Column:
    """Single words of two or more word characters without stop words, and pairs of neighbours among them."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9_]{2,}"), F.lit(0)), lambda t: ~t.isin(*ENGLISH))
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.concat(words, F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b)))


def utc_now() -> Column:
    """The time of the query as ISO text in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def session_id() -> Column:
    """Eight characters of a random identifier, a new one for every row."""
    return F.substring(F.uuid(), 1, 8)
