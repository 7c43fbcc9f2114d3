"""Text functions: line and column, placeholders, label parsing, report rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .languages import LABEL_KEYS, label_words

#: What a placeholder looks like; whole, and what may become one.
PLACEHOLDER = r"<[^<>\s]{1,64}_\d{1,6}(?:_[^<>\s]{1,32})?>"
LABEL_PARTS = r"^<([^<>\s]{1,64})_(\d{1,6})(?:_([^<>\s]{1,32}))?>$"
LONGEST_PLACEHOLDER = 106


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1


def column_of(text: Column, offset: Column) -> Column:
    """1-based column of a 0-based offset."""
    return F.length(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1)) + 1


def placeholders(text: Column) -> Column:
    """Distinct placeholder-shaped strings, by first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)))


def parsed_label(label: Column) -> Column:
    """struct(prefix, index, part) of a placeholder, else null; no part: null."""
    part = F.regexp_extract(label, LABEL_PARTS, 3)
    return F.when(
        label.rlike(LABEL_PARTS),
        F.struct(F.regexp_extract(label, LABEL_PARTS, 1).alias("prefix"), F.regexp_extract(label, LABEL_PARTS, 2).cast("int").alias("index"), F.when(part != "", part).alias("part")),
    )


def classified_label(label: Column, language: str) -> Column:
    """The entity type whose word a placeholder has, first in key order, else null."""
    shape = r"^<(.+)_\d{1,6}(?:_[^<>\s]{1,32})?>$"
    word, words, out = F.regexp_extract(label, shape, 1), label_words(language), F.lit(None).cast("string")
    for key in reversed(LABEL_KEYS):
        out = F.when(word == words[key], F.lit(key)).otherwise(out)
    return F.when(label.rlike(shape), out)


#: Fixed value: entity types that a simulated reply names first.
REPLY_ORDER = ("PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER")


def simulated_reply(labels: Column, language: str, template: str, most: int = 4) -> Column:
    """The template with up to ``most`` labels for {labels}: names, mails and
    phones first, each in order of appearance."""

    def rank(x: Column) -> Column:
        kind = classified_label(x, language)
        out = F.lit(len(REPLY_ORDER))
        for i, k in reversed(list(enumerate(REPLY_ORDER))):
            out = F.when(kind == k, F.lit(i)).otherwise(out)
        return out

    ordered = F.array_sort(F.transform(labels, lambda x, i: F.struct(rank(x).alias("r"), i.alias("i"), x.alias("x"))))
    return F.replace(F.lit(template), F.lit("{labels}"), F.array_join(F.transform(F.slice(ordered, 1, most), lambda s: s["x"]), ", "))


def finding_line(file: Column, line: Column, column: Column, entity_type: Column, score: Column) -> Column:
    return F.format_string("%s:%d:%d: %s (score %.2f)", file, line, column, entity_type, score)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def markdown_row(entity_type: Column, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
    return F.format_string("| %s | %.2f | %.2f | %.2f | %d |", entity_type, precision, recall, f1, support)
