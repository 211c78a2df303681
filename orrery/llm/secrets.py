"""Operator 6: secret scans by corpus-wide ownership frequency.

Candidates are matched by one regular expression inside the JVM.  Each is
reduced to a SHA-256 hash, so no secret leaves its document, and the hashes are
counted over the whole corpus by distinct repositories (``source`` and ``lang``
together by default) and distinct owners (``source``).  A candidate that more
than ``max_owners`` owners have is a widely copied example; one that few owners
have is live-looking if it is also random enough: at least ``min_distinct``
different characters, and at most a third of it in runs of one character or of
counted digits (1234...).

Results for odd input: a null or empty text has no candidates; a null source or
lang counts as one unknown owner or repository of its own; a secret that occurs
several times in a document gives one row with its number of occurrences;
repeated rows of a document add up; rows without a doc_id have one row of null
doc_id for each of their secrets, and count for owners and repositories but as
no document; further columns are ignored.  Redaction goes by text, so rows of
any doc_id, null too, lose their live-looking secrets, of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, maybe_broadcast, written

#: A name in any case, quoted or not, and = or : (also :=, =>) with any blanks on the line around it.
NAMED = r"(?i:password|passwd|pwd|(?:secret|token|api[_-]?key)(?:[_-]?(?:access[_-]?)?key)?)[\"']?[ \t]*(?::=|=>|=|:)[ \t]*"
#: A value begins with twelve plain characters and ends at its closing quote, or unquoted before a blank or delimiter, without marks that end sentences.
_START = r"[A-Za-z0-9_\-+/]{12,}+"
_REST = r"(?:[A-Za-z0-9_\-+/=.~!@#$%^*:?|]*[A-Za-z0-9_\-+/=~@#$%^*|])?"
KNOWN = r"((?:AKIA|ASIA)[0-9A-Z]{16}[0-9A-Za-z]*+|gh[pousr]_[0-9A-Za-z]{36,}+|sk-[0-9A-Za-z]{20,}+[0-9A-Za-z_\-]*+|xox[abprs]-[0-9A-Za-z-]{10,}+|AIza[0-9A-Za-z_\-]{35,}+)"
#: Four ways, a group each: in double quotes, in single ones, unquoted (or without a closing quote), or of a known form.
CANDIDATE = f"{NAMED}(?:\"({_START}[^\"\r\n]*+)\"|'({_START}[^'\r\n]*+)'|[\"']?({_START}{_REST}))|{KNOWN}"
#: The same for engines without possessive quantifiers, which only spare the search needless steps back.
_SQL_CANDIDATE = CANDIDATE.replace("}+", "}").replace("*+", "*")
MAX_OWNERS = 3
MIN_DISTINCT = 8
#: Runs of one printable character, and of counted digits: a value of which they cover more than a third is filler.
_DIGITS = r"0?1234(?:5(?:6(?:7(?:8(?:90?)?)?)?)?)?"
FILLER = r"([ -~])\1{3,}|" + _DIGITS
#: The same for engines without references to groups.
_SQL_FILLER = "|".join(f"[{chr(92) if chr(k) in '[]^-' + chr(92) else ''}{chr(k)}]{{4,}}" for k in range(32, 127)) + "|" + _DIGITS


def _value(match: Column) -> Column:
    """What a match of CANDIDATE assigns."""
    groups = [F.nullif(F.regexp_extract(match, CANDIDATE, g), F.lit("")) for g in (1, 2, 3, 4)]
    return F.coalesce(*groups)


def candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row per row of docs and secret: doc_id, owner, repository, text_key, secret; the texts are read by one pass of the pattern."""
    rows = docs.select("doc_id", F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce(repository, F.lit("")).alias("repository"), "text")
    found = rows.select("doc_id", "owner", "repository", "text", F.explode(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).alias("match"))
    return found.select("doc_id", "owner", "repository", F.sha2("text", 256).alias("text_key"), _value(F.col("match")).alias("secret"))


def is_random(secret: Column, min_distinct: int = MIN_DISTINCT) -> Column:
    """Whether a value has characters enough and isn't mostly filler."""
    rest = F.length(F.regexp_replace(secret, FILLER, ""))
    return (F.size(F.array_distinct(F.split(secret, ""))) >= min_distinct) & (rest * 3 >= F.length(secret) * 2)


def _judged(docs: DataFrame, owner: str, repository: tuple[str, ...], max_owners: int, min_distinct: int) -> tuple[DataFrame, DataFrame]:
    """The candidates as a written table (doc_id, owner, repository, text_key, secret_hash, is_random, n), and the verdict on every hash."""
    where = F.concat_ws("/", *[F.coalesce(F.col(c), F.lit("")) for c in repository])
    rows = candidates(docs, F.col(owner), where).select("doc_id", "owner", "repository", "text_key", F.sha2("secret", 256).alias("secret_hash"), is_random(F.col("secret"), min_distinct).alias("is_random"))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    # The few candidates are used twice; the documents are read once.
    rows = written(rows, "secrets-candidates")
    # The distinct counts need only the pairs, of which there are few per hash even for a secret that is everywhere.
    hashes = (
        rows.groupBy("secret_hash", "is_random", "owner", "repository").agg(F.count_distinct("doc_id").alias("d"))
        .groupBy("secret_hash", "is_random").agg(F.sum("d").alias("n_docs"), F.count_distinct("repository").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"))
    )
    return rows, hashes.withColumn("live", (F.col("n_owners") <= max_owners) & F.col("is_random")).drop("is_random")


def scan(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, min_distinct: int = MIN_DISTINCT) -> DataFrame:
    """doc_id, secret_hash, n, n_docs, n_repositories, n_owners, live: a row per document and candidate."""
    rows, hashes = _judged(docs, owner, repository, max_owners, min_distinct)
    return (
        rows.groupBy("doc_id", "secret_hash").agg(F.sum("n").alias("n")).join(hashes, "secret_hash")
        .select("doc_id", "secret_hash", "n", "n_docs", "n_repositories", "n_owners", "live")
    )


def redact(docs: DataFrame, mask: str = "[SECRET]", owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, min_distinct: int = MIN_DISTINCT) -> DataFrame:
    """The documents with every live-looking secret replaced by ``mask``; examples stay.

    What is live depends on the secret alone, so the list of a text is found by
    the text's own hash; columns and rows are those of docs, with n_chars
    brought up to date.
    """
    rows, hashes = _judged(docs, owner, repository, max_owners, min_distinct)
    key, live = fresh(docs, "text_key"), fresh(docs, "live_hashes")
    lists = rows.join(hashes.where("live"), "secret_hash").groupBy(F.col("text_key").alias(key)).agg(F.collect_set("secret_hash").alias(live))
    joined = docs.withColumn(key, F.sha2("text", 256)).join(maybe_broadcast(written(lists, "secrets-live")), key, "left")
    values = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), _value))
    mine = F.filter(values, lambda s: F.array_contains(F.col(live), F.sha2(s, 256)))
    # The longest goes first, so that none leaves a part of another that holds it.
    order = F.sort_array(F.transform(mine, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))), asc=False)
    masked = F.aggregate(order, F.col("text"), lambda t, s: F.replace(t, s["s"], F.lit(mask)))
    out = joined.withColumn("text", F.when(F.col(live).isNull(), F.col("text")).otherwise(masked))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(live).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


_GROUPS = ", ".join(f"nullif(regexp_extract(m, '{_sql(_SQL_CANDIDATE)}', {g}), '')" for g in (1, 2, 3, 4))
ORACLE = f"""
WITH f AS (
  SELECT doc_id, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repository, unnest(regexp_extract_all(text, '{_sql(_SQL_CANDIDATE)}', 0)) AS m
  FROM documents),
c AS (SELECT doc_id, owner, repository, coalesce({_GROUPS}) AS secret FROM f),
r AS (
  SELECT doc_id, owner, repository, sha256(secret) AS secret_hash, count(*) AS n,
         len(list_distinct(string_split(secret, ''))) >= {MIN_DISTINCT} AND 3 * length(regexp_replace(secret, '{_sql(_SQL_FILLER)}', '', 'g')) >= 2 * length(secret) AS is_random
  FROM c GROUP BY doc_id, owner, repository, secret),
o AS (
  SELECT secret_hash, count(DISTINCT doc_id) AS n_docs, count(DISTINCT repository) AS n_repositories, count(DISTINCT owner) AS n_owners
  FROM r GROUP BY secret_hash)
SELECT r.doc_id, r.secret_hash, CAST(sum(r.n) AS BIGINT) AS n, o.n_docs, o.n_repositories, o.n_owners,
       o.n_owners <= {MAX_OWNERS} AND r.is_random AS live
FROM r JOIN o USING (secret_hash)
GROUP BY r.doc_id, r.secret_hash, r.is_random, o.n_docs, o.n_repositories, o.n_owners
"""
