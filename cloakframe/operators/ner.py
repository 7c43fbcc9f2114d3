"""Findings of a user's model: token grouping and realignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .detect import SPANS

#: Entity types of model tags; others are ignored.
TAGS = {"PER": "PERSON", "PERSON": "PERSON", "LOC": "LOCATION", "LOCATION": "LOCATION", "GPE": "LOCATION"}


def entity_of_tag(tag: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])[tag]


def group_tokens(tokens: DataFrame, key: str) -> DataFrame:
    """(key, group, tag, words, score) from rows (key, index, entity, word, score).

    Neighbouring tokens of one tag make a group; a B- tag or a gap starts anew.
    Gaps and islands over a window per key.
    """
    by = Window.partitionBy(key).orderBy("index")
    kept = tokens.where("entity is not null and entity not in ('', 'O')").withColumn("_tag", F.regexp_replace("entity", "^[BI]-", ""))
    fresh = F.col("entity").startswith("B-") | (F.lag("index").over(by).isNull()) | (F.lag("index").over(by) != F.col("index") - 1) | (F.lag("_tag").over(by) != F.col("_tag"))
    grouped = kept.withColumn("group", F.sum(fresh.cast("int")).over(by))
    out = grouped.groupBy(key, "group", F.col("_tag").alias("tag")).agg(F.array_sort(F.collect_list(F.struct("index", "word"))).alias("_w"), F.avg("score").alias("score"))
    return out.select(key, "group", "tag", F.transform("_w", lambda w: w["word"]).alias("words"), "score")


def find_words(text: str, begin: int, words: list[str]) -> tuple[int, int] | None:
    """Where a group's words stand from ``begin`` on, whatever the white space."""
    plain = "".join(words).replace("##", "").replace("▁", " ").strip()
    if not plain:
        return None
    found = re.compile(r"\s*".join(r"\s+" if c == " " else re.escape(c) for c in plain)).search(text, begin)
    return found.span() if found else None


@F.pandas_udf(SPANS)
def aligned_spans(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Spans of a text's ordered groups array(words, entity_type, score)."""
    for texts, groups in batches:
        out = []
        for text, own in zip(texts, groups, strict=True):
            at, spans = 0, []
            for g in own:
                spot = find_words(text, at, list(g["words"]))
                if spot:
                    spans.append({"start": spot[0], "end": spot[1], "entity_type": g["entity_type"], "score": g["score"]})
                    at = spot[1]
            out.append(spans)
        yield pd.Series(out)
