"""Sinks: results, reports, mappings (only when asked for), restored texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def result_json(df: DataFrame, text: str = "masked_text", mapping: str = "mapping", entities: str = "entities") -> DataFrame:
    """One JSON object {text, mapping, entities} per row, in column result."""
    as_map = F.map_from_entries(F.transform(mapping, lambda m: F.struct(m["label"], m["value"])))
    return df.withColumn("result", F.to_json(F.struct(F.col(text).alias("text"), as_map.alias("mapping"), F.col(entities).alias("entities"))))


def write_mapping(df: DataFrame, path: str, keys: list[str], mapping: str = "mapping") -> None:
    """The mapping holds the originals: it is written only by this call."""
    df.select(*keys, mapping).write.json(path)


def write_report(found: DataFrame, path: str) -> None:
    found.write.json(path)


def write_texts(df: DataFrame, path: str, text: str) -> int:
    """Texts as lines; returns how many characters were written."""
    df.select(F.col(text)).write.text(path)
    return int(df.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0])


def sse_body(df: DataFrame, key: str, seq: str = "seq", data: str = "data") -> DataFrame:
    """(key, body): frames joined again in order."""
    frames = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(data).alias("d"))))
    return df.groupBy(key).agg(frames.alias("_f")).select(key, F.array_join(F.transform("_f", lambda f: F.concat(F.lit("data: "), f["d"], F.lit("\n\n"))), "").alias("body"))


def delta_frames(restored: DataFrame, key: str = "stream_id", choice: str = "choice", seq: str = "seq", text: str = "text", last: str = "last") -> DataFrame:
    """(key, seq, data) of restored chunks: one completion frame each; the chunk
    that ends a stream (``last``) has what was held back, and [DONE] after it."""
    delta = F.to_json(F.struct(F.array(F.struct(F.col(choice).alias("index"), F.struct(F.col(text).alias("content")).alias("delta"))).alias("choices")))
    data = F.when(F.col(last), F.array(delta, F.lit("[DONE]"))).otherwise(F.array(delta))
    rows = restored.select(key, F.col(seq).alias("_seq"), F.posexplode(data).alias("_at", "data"))
    return rows.select(key, (F.col("_seq") * 2 + F.col("_at")).alias("seq"), "data")
