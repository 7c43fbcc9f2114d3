"""Evaluation: predictions against gold spans, and reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.languages import NAME_PARTS, family_first
from ..functions.text import markdown_row, ratio
from .detect import at_least, detect_rules, once
from .labels import split_name_columns
from .rules import rules_of
from .spans import merge

COUNTS = "entity_type string, tp bigint, fp bigint, fn bigint"


def matched(gold: list[dict], found: list[dict]) -> dict[str, list[int]]:
    """[tp, fp, fn] by type: each prediction takes the first free gold span of
    its type that it overlaps."""
    out: dict[str, list[int]] = {}
    free = [g for g in gold if g["entity_type"] not in NAME_PARTS.values()]
    for p in found:
        row = out.setdefault(p["entity_type"], [0, 0, 0])
        hit = next((g for g in free if g["entity_type"] == p["entity_type"] and p["start"] < g["end"] and g["start"] < p["end"]), None)
        row[0 if hit is not None else 1] += 1
        free = [g for g in free if g is not hit]
    for g in free:
        out.setdefault(g["entity_type"], [0, 0, 0])[2] += 1
    return out


def evaluate(cases: DataFrame, gold: str, found: str, keys: list[str]) -> DataFrame:
    """(keys, entity_type, tp, fp, fn): cases are matched in Arrow batches
    without a shuffle, then summed."""

    def run(batches):
        for pdf in batches:
            rows = [(*(row[k] for k in keys), kind, *n) for row in pdf.to_dict("records") for kind, n in matched(list(row[gold]), list(row[found])).items()]
            yield pd.DataFrame(rows, columns=[*keys, "entity_type", "tp", "fp", "fn"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cases.select(*keys).schema)
    return merge_reports(cases.select(*keys, gold, found).mapInPandas(run, f"{ddl}, {COUNTS}"), keys)


def merge_reports(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys, "entity_type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def with_rates(counts: DataFrame) -> DataFrame:
    """precision, recall and f1; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def markdown(counts: DataFrame) -> DataFrame:
    rated = with_rates(counts)
    return rated.orderBy("entity_type").select(markdown_row(F.col("entity_type"), F.col("precision"), F.col("recall"), F.col("f1"), F.col("tp") + F.col("fn")).alias("row"))


def below_floor(counts: DataFrame, floors: dict[str, float]) -> DataFrame:
    """Rows whose recall is under their type's floor; none may be left."""
    spark = counts.sparkSession
    limits = spark.createDataFrame(list(floors.items()), "entity_type string, floor double")
    return with_rates(counts).join(F.broadcast(limits), "entity_type").where("recall < floor")


def evaluate_name_parts(cases: DataFrame, keys: list[str], text: str = "text", gold: str = "spans", language: str = "language") -> DataFrame:
    """(keys, entity_type, tp, fp, fn) of splitting the gold names that have
    gold parts: a part counts only with its exact bounds and type. No shuffle
    but the sums'."""
    parts, kinds = F.filter(gold, lambda s: s["entity_type"].isin(*NAME_PARTS.values())), list(NAME_PARTS.items())
    plain = lambda s, low: F.struct(s["entity_type"].alias("entity_type"), (s["start"] + low).alias("start"), (s["end"] + low).alias("end"))
    known = F.transform(parts, lambda s: plain(s, F.lit(0)))
    names = F.filter(gold, lambda s: (s["entity_type"] == "PERSON") & F.exists(parts, lambda p: (s["start"] <= p["start"]) & (p["end"] <= s["end"])))
    word = F.create_map(*[F.lit(x) for kv in kinds for x in kv])

    def split(s: Column) -> Column:
        found = split_name_columns(F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"]), family_first(F.col(language)))
        return F.transform(found, lambda p: F.struct(word[p["part"]].alias("entity_type"), (s["start"] + p["start"]).alias("start"), (s["start"] + p["end"]).alias("end")))

    rows = cases.select(*keys, once(known).alias("_gold"), once(F.flatten(F.transform(names, split))).alias("_found"))
    tagged = lambda array, *n: F.transform(array, lambda s: F.struct(s["entity_type"].alias("entity_type"), *[F.lit(x).cast("long").alias(c) for x, c in zip(n, ("tp", "fp", "fn"), strict=True)]))
    each = F.concat(tagged(F.array_intersect("_gold", "_found"), 1, 0, 0), tagged(F.array_except("_found", "_gold"), 0, 1, 0), tagged(F.array_except("_gold", "_found"), 0, 0, 1))
    return merge_reports(rows.withColumn("_each", once(each)).select(*keys, F.inline("_each")), keys)


#: Types of the table of model-free rules.
TABLE_TYPES = ("EMAIL_ADDRESS", "PHONE_NUMBER", "JP_POSTAL_CODE", "JP_MY_NUMBER", "CREDIT_CARD", "US_SSN", "IBAN_CODE")


def rules_table(cases: DataFrame, keys: list[str], text: str = "text", gold: str = "spans", language: str = "language") -> DataFrame:
    """(keys, entity_type, tp, fp, fn) of the rules alone, spans merged without
    trimming, on the types of ``TABLE_TYPES``."""
    kinds = lambda c: F.filter(c, lambda s: s["entity_type"].isin(*TABLE_TYPES))
    raw = cases.withColumn("_raw", once(at_least(detect_rules(F.col(text), F.col(language), rules_of(TABLE_TYPES)))))
    return evaluate(raw.select(*keys, kinds(F.col(gold)).alias("_gold"), merge(F.col("_raw")).alias("_found")), "_gold", "_found", keys)


def table_rows(lines: DataFrame, line: str) -> DataFrame:
    """(entity_type, precision, recall, f1, support) of the rows of a markdown
    table as ``markdown`` writes it; other lines are skipped."""
    cells = F.transform(F.split(line, r"\|"), lambda c: F.trim(c))
    rows = lines.select(cells.alias("_c")).where((F.size("_c") == 7) & F.get("_c", F.lit(2)).rlike(r"^[0-9.]+$"))
    return rows.select(F.get("_c", F.lit(1)).alias("entity_type"), *[F.get("_c", F.lit(i)).cast("decimal(6,2)").alias(n) for i, n in ((2, "precision"), (3, "recall"), (4, "f1"))], F.get("_c", F.lit(5)).cast("long").alias("support"))


def drift(now: DataFrame, documented: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with ``side``; none: no drift."""
    both = [a.exceptAll(b.select(*a.columns)).withColumn("side", F.lit(side)) for a, b, side in ((now, documented, "now"), (documented, now, "documented"))]
    return both[0].unionByName(both[1])
