"""Detection: rules, deny lists and models' findings as arrays of spans.

A span is struct(start int, end int, entity_type string, score double), in code
points, end exclusive. All of this is Column work without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.languages import CUSTOM
from .rules import CONTEXT_WORDS, Rule

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("entity_type", T.StringType()), T.StructField("score", T.DoubleType())])
SPANS = T.ArrayType(SPAN)
THRESHOLD = 0.4


def once(x: Column) -> Column:
    """``x``, worked out once for each row: the optimizer neither repeats it
    where it is used several times nor moves filters on it below. Filters on
    other columns should come before the step that uses this."""
    return F.when(F.monotonically_increasing_id() >= 0, x)


def no_spans() -> Column:
    return F.array().cast(SPANS)


def span(start: Column, end: Column, entity_type: Column, score: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), entity_type.alias("entity_type"), score.cast("double").alias("score"))


def value_of(text: Column, s: Column) -> Column:
    return F.substring(text, s["start"] + 1, s["end"] - s["start"])


def match_bounds(text: Column, pattern: str) -> Column:
    """array(struct(start, end)) of a pattern's leftmost matches.

    Splitting by the pattern gives the gaps between the same matches that
    ``regexp_extract_all`` returns; running lengths of both are the offsets.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        low = a["at"] + x["gap"]
        high = low + x["size"]
        return F.struct(high.alias("at"), F.concat(a["out"], F.array(F.struct(low.alias("start"), high.alias("end")))).alias("out"))

    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")))
    return F.aggregate(pairs, start, step, lambda a: a["out"])


def rule_spans(text: Column, language: Column, rule: Rule) -> Column:
    """Spans of one rule: gated by language and a match."""
    spans = F.transform(match_bounds(text, rule.pattern), lambda b: span(b["start"], b["end"], F.lit(rule.entity_type), F.lit(rule.score)))
    if rule.check is not None:
        spans = F.filter(spans, lambda s: rule.check(value_of(text, s)))
    gate = text.rlike(rule.pattern)
    if rule.languages:
        gate = language.isin(*rule.languages) & gate
    return F.when(gate, spans).otherwise(no_spans())


def detect_rules(text: Column, language: Column, rules: Sequence[Rule]) -> Column:
    """Unmerged spans of all rules, in rule order, then position.

    Neighbouring rules that need the same are gated by it together, so most
    texts are looked at a few times and not once for each rule."""
    parts = []
    for needs, group in groupby(rules, lambda r: r.needs):
        gate = text.contains(needs) if len(needs) == 1 else text.rlike(needs)
        parts.append(F.when(gate, F.concat(*[rule_spans(text, language, r) for r in group])).otherwise(no_spans()))
    return F.concat(*parts) if parts else no_spans()


#: What a context word adds, and the least score it leads to.
BOOST, LEAST_BOOSTED = 0.35, 0.4
#: Characters before a span in which a context word counts.
BEFORE = 60


def boosted(spans: Column, text: Column) -> Column:
    """Spans with higher scores where a context word of their type stands
    before them: as a whole word, in any case (scripts without spaces: anywhere)."""

    def raised(s: Column) -> Column:
        low = F.greatest(s["start"] - BEFORE, F.lit(0))
        near = F.substring(text, low + 1, s["start"] - low)
        told = F.lit(False)
        for kind, words in CONTEXT_WORDS.items():
            plain = "|".join(re.escape(w) if w.isascii() else w for w in words if w.isascii())
            other = "|".join(w for w in words if not w.isascii())
            pattern = "|".join(x for x in (rf"(?i)(?<![A-Za-z])(?:{plain})(?![A-Za-z])" if plain else "", other) if x)
            told = F.when(s["entity_type"] == kind, near.rlike(pattern)).otherwise(told)
        score = F.least(F.lit(1.0), F.greatest(s["score"] + BOOST, F.lit(LEAST_BOOSTED)))
        return span(s["start"], s["end"], s["entity_type"], F.when(told, score).otherwise(s["score"]))

    return F.transform(spans, raised)


#: Characters of a needle that the join is on.
HEAD = 3
#: Occurrences that one batch holds.
FOUND_ROWS = 1 << 16


def heads_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_digest, _head): the distinct strings of up to HEAD characters in texts."""
    for batch in batches:
        for i in range(batch.num_rows):
            own = batch.column(1)[i].as_py()
            heads = list(set(own).union(*[map("".join, zip(*[own[j:] for j in range(k)], strict=False)) for k in range(2, HEAD + 1)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(heads), pa.int64())), pa.array(heads, pa.string())], ["_digest", "_head"])


def needle_spans(df: DataFrame, key: str, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """(key, start, end, entity_type, score, value): every occurrence of a table
    of strings, of any size (those of one string may overlap).

    An equi-join of each text's distinct heads (up to three characters) with the
    strings' heads; a text then looks for those strings only. Texts aren't
    copied: heads go by the text's digest. Nulls and empty strings are no
    needles; repeated ones count once; a null key is carried as such.
    """
    listed = needles.select(F.col(needle).cast("string").alias("_value")).where("length(_value) > 0").distinct()
    listed = listed.withColumn("_head", F.substring("_value", 1, HEAD))
    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).where("length(_text) > 0").withColumn("_digest", F.sha2("_text", 256))
    heads = rows.select("_digest", "_text").mapInArrow(heads_of, "_digest string, _head string")
    wanted = heads.join(listed, "_head").groupBy("_digest").agg(F.collect_set("_value").alias("_values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            starts: list[int] = []
            values: list[str] = []

            def made(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int32()), pa.array(values, pa.string())], ["_key", "start", "value"])

            for i in range(batch.num_rows):
                own = batch.column(1)[i].as_py()
                for value in batch.column(2)[i].as_py():
                    spot = own.find(value)
                    while spot >= 0:
                        at.append(i)
                        starts.append(spot)
                        values.append(value)
                        if len(at) >= FOUND_ROWS:
                            yield made()
                            at, starts, values = [], [], []
                        spot = own.find(value, spot + 1)
            if at:
                yield made()

    found = rows.join(wanted, "_digest").select("_key", "_text", "_values").mapInArrow(run, T.StructType([T.StructField("_key", df.schema[key].dataType), T.StructField("start", T.IntegerType()), T.StructField("value", T.StringType())]))
    return found.select(F.col("_key").alias(key), "start", (F.col("start") + F.length("value")).alias("end"), F.lit(CUSTOM).alias("entity_type"), F.lit(1.0).alias("score"), "value")


def deny_spans(text: Column, needles: Sequence[str]) -> Column:
    """Every plain occurrence of listed strings: CUSTOM, score 1."""
    out = no_spans()
    for needle in needles:
        if needle:
            spans = F.transform(match_bounds(text, re.escape(needle) if needle.isascii() else r"\Q" + needle.replace(r"\E", r"\E\\E\Q") + r"\E"), lambda b: span(b["start"], b["end"], F.lit(CUSTOM), F.lit(1.0)))
            out = F.concat(out, F.when(text.contains(needle), spans).otherwise(no_spans()))
    return out


def at_least(spans: Column, threshold: float = THRESHOLD) -> Column:
    return F.filter(spans, lambda s: s["score"] >= threshold)


def of_types(spans: Column, entities: Sequence[str]) -> Column:
    """Requested types; deny-listed values always stay."""
    return F.filter(spans, lambda s: s["entity_type"].isin(*entities, CUSTOM))


def not_allowed(spans: Column, text: Column, allow: Sequence[str]) -> Column:
    """Spans whose text in the original isn't exactly an allowed value."""
    return F.filter(spans, lambda s: ~value_of(text, s).isin(*allow)) if allow else spans


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def same_bounds(a: Column, b: Column) -> Column:
    return (a["start"] == b["start"]) & (a["end"] == b["end"])


def outside_of(spans: Column, others: Column) -> Column:
    """Spans (a model's) that overlap none of others (structured ones)."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: overlaps(s, o)))


def entity_counts(spans: Column) -> Column:
    """map(entity type -> occurrences)."""
    types = F.transform(spans, lambda s: s["entity_type"])
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(types)), lambda t: F.struct(t, F.size(F.filter(types, lambda x: x == t)))))
