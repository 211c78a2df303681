"""The registered queries of the ten operators and of the pipeline, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, chat, counts, decontam, jaccard, langid, media, phrases, quality, secrets
from .common import table

#: What op8_token_counts edits: a source line is put before every document, and eight characters in its middle are rewritten.
EDITS = """
  array(struct(0 AS at, 0 AS until, concat(coalesce(source, ''), ': ') AS new),
        struct(cast(length(text) / 2 AS int) AS at, cast(length(text) / 2 AS int) + 8 AS until, ' revised text' AS new))
"""

QUERIES = {
    "op1_substring_dedup": lambda spark, d: phrases.repeated_spans(table(spark, d, "documents")),
    "op2_quality": lambda spark, d: quality.score(table(spark, d, "documents"), table(spark, d, "labels")),
    "op4_bpe": lambda spark, d: bpe.encode(table(spark, d, "documents")),
    "op3_decontaminate": lambda spark, d: decontam.leaks(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op5_media_clips": lambda spark, d: media.clips(media.films(table(spark, d, "embeddings"))),
    "op7_chat_format": lambda spark, d: chat.format_chats(table(spark, d, "conversations")),
    "op8_token_counts": lambda spark, d: counts.count_edited(table(spark, d, "documents"), F.expr(EDITS)),
    "op9_language_id": lambda spark, d: langid.identify(table(spark, d, "documents")),
    "op10_jaccard": lambda spark, d: jaccard.links(table(spark, d, "documents")),
    "op6_secret_scan": lambda spark, d: secrets.scan(table(spark, d, "documents")),
}

ORACLES = {
    "op1_substring_dedup": phrases.ORACLE,
    "op6_secret_scan": secrets.ORACLE,
    "op10_jaccard": jaccard.ORACLE,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
