"""Restoring masked texts from label -> value mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import placeholders


def ordered(mapping: Column) -> Column:
    """array(label, value) with longer labels first, else in order."""
    keyed = F.transform(mapping, lambda m, i: F.struct((-F.length(m["label"])).alias("n"), i.alias("i"), m["label"].alias("label"), m["value"].alias("value")))
    return F.array_sort(keyed)


def restored(text: Column, mapping: Column) -> Column:
    """Labels replaced one after the other; what a value brings in can be
    replaced by a later (shorter) label."""
    return F.aggregate(ordered(mapping), text, lambda t, m: F.replace(t, m["label"], m["value"]))


REPLACEMENTS = "array<struct<label:string,value:string,count:int>>"


def restored_with_report(text: Column, mapping: Column) -> Column:
    """struct(text, replacements(label, value, count), unresolved): unresolved
    are placeholders of the result that the mapping doesn't know."""
    start = F.struct(text.alias("text"), F.array().cast(REPLACEMENTS).alias("replacements"))

    def step(a: Column, m: Column) -> Column:
        n = ((F.length(a["text"]) - F.length(F.replace(a["text"], m["label"]))) / F.length(m["label"])).cast("int")
        one = F.struct(m["label"].alias("label"), m["value"].alias("value"), n.alias("count"))
        return F.struct(F.replace(a["text"], m["label"], m["value"]).alias("text"), F.when(n > 0, F.concat(a["replacements"], F.array(one))).otherwise(a["replacements"]).alias("replacements"))

    done = F.aggregate(ordered(mapping), start, step)
    known = F.transform(mapping, lambda m: m["label"])
    return F.struct(done["text"].alias("text"), done["replacements"].alias("replacements"), F.array_except(placeholders(done["text"]), known).alias("unresolved"))


def restore_table(df: DataFrame, mappings: DataFrame, keys: list[str], text: str, mapping: str = "mapping") -> DataFrame:
    """``df`` with restored_text, from a mapping table with one row per key."""
    return df.join(mappings.select(*keys, F.col(mapping).alias("_mapping")), keys, "left").withColumn("restored_text", F.when(F.col("_mapping").isNull(), F.col(text)).otherwise(restored(F.col(text), F.col("_mapping")))).drop("_mapping")


def latest_mappings(df: DataFrame, keys: list[str], order: str, mapping: str = "mapping", keep: int | None = None) -> DataFrame:
    """The last mapping saved under each key; of those the ``keep`` newest."""
    last = df.groupBy(*keys).agg(F.max_by(mapping, order).alias(mapping), F.max(order).alias(order))
    return last if keep is None else last.orderBy(F.desc(order)).limit(keep)


def restored_parts(parts: Column, mapping: Column) -> Column:
    """array(struct(type, text)) with the text parts restored; others as they are."""
    return F.transform(parts, lambda p: p.withField("text", F.when(p["type"] == "text", restored(p["text"], mapping)).otherwise(p["text"])))


def restored_completion(choices: Column, mapping: Column, content: str = "content") -> Column:
    """Contents (strings) of array(struct(content)) restored, choice by choice."""
    return F.transform(choices, lambda c: c.withField(content, restored(c[content], mapping)))


def restored_completion_parts(choices: Column, mapping: Column, parts: str = "parts") -> Column:
    """The same where the content of each choice is a list of parts."""
    return F.transform(choices, lambda c: c.withField(parts, restored_parts(c[parts], mapping)))
