"""Redaction events: listings and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a listing by default, and at most.
LISTED, MOST = 50, 100


def listing_limit(asked: int | None) -> int:
    return LISTED if asked is None or asked < 1 else min(asked, MOST)


def latest(events: DataFrame, key: str, asked: int | None = None) -> DataFrame:
    """The newest events first; a mapping shows only as hasMapping."""
    out = events.orderBy(F.desc(key)).limit(listing_limit(asked))
    return out.withColumn("hasMapping", F.col("mapping").isNotNull()).drop("mapping") if "mapping" in events.columns else out


def counters(events: DataFrame, status: str) -> DataFrame:
    """(total, anonymized, passthrough, errors) in one row."""
    return events.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(status) == s).alias(n) for s, n in (("anonymized", "anonymized"), ("passthrough", "passthrough"), ("error", "errors"))],
    )
