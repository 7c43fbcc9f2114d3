"""Scan reports: findings with places and never the matched text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import column_of, finding_line, line_of


def findings(df: DataFrame, name: str, text: str, spans: str) -> DataFrame:
    """(file, line, column, start, end, entity_type, score), one row for each span."""
    rows = df.select(F.col(name).alias("file"), F.col(text).alias("_text"), F.explode(spans).alias("_s"))
    start: Column = F.col("_s.start")
    return rows.select("file", line_of(F.col("_text"), start).alias("line"), column_of(F.col("_text"), start).alias("column"), "_s.start", "_s.end", "_s.entity_type", "_s.score")


def report_lines(found: DataFrame) -> DataFrame:
    return found.select(finding_line(F.col("file").cast("string"), F.col("line"), F.col("column"), F.col("entity_type"), F.col("score")).alias("line"))


def report_json(found: DataFrame, inputs: int) -> DataFrame:
    """One JSON object per finding, with the number of inputs."""
    return found.select(F.to_json(F.struct("*")).alias("finding"), F.lit(inputs).cast("long").alias("inputs"))


def summary(df: DataFrame, name: str, spans: str) -> DataFrame:
    """(findings, files, inputs) in one row: the exit code is 1 if findings > 0."""
    n = F.size(spans)
    return df.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("findings"), F.count_distinct(F.when(n > 0, F.col(name))).alias("files"), F.count(F.lit(1)).alias("inputs"))
