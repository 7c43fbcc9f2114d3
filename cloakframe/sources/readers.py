"""Sources: whole files, literal texts, mappings, cases, chat bodies, event streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GOLDEN = "id string, language string, genre string, text string, spans array<struct<start:int,end:int,entity_type:string,value:string>>"
CASES = "description string, cases array<struct<id:string,language:string,text:string,cores:array<string>,deny_list:array<string>,allow_list:array<string>,must_mask:array<struct<entity_type:string,value:string,min_count:int>>,must_not_mask:array<string>,must_not_detect:array<struct<entity_type:string,value:string>>,notes:string>>"
CHAT = "model string, stream boolean, messages array<struct<role:string,content:string>>, _corrupt_record string"
PARTS = "array<struct<type:string,text:string>>"
MAPPING = "map<string,string>"


def literal_text(spark: SparkSession, text: str, name: str = "<text>") -> DataFrame:
    return spark.createDataFrame([(name, text)], "name string, text string")


def text_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(name, text, valid) of whole UTF-8 files; directories aren't descended
    into, and a file that isn't UTF-8 has valid false and null text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(list(paths))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return raw.select(F.col("path").alias("name"), text.alias("text"), text.isNotNull().alias("valid"))


def one_input(spark: SparkSession, text: str | None = None, files: Sequence[str] | None = None) -> DataFrame:
    """Exactly one of a text and files; ValueError otherwise."""
    if (text is None) == (not files):
        raise ValueError("give either a text or files")
    return literal_text(spark, text) if text is not None else text_files(spark, files or []).select("name", "text")


def mapping_from_json(column: Column) -> Column:
    """Ordered array(label, value) of a JSON object {label: value}."""
    return F.transform(F.map_entries(F.from_json(column, MAPPING)), lambda e: F.struct(e["key"].alias("label"), e["value"].alias("value")))


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLDEN).option("multiLine", True).json(path)


def fixture_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row per hand-written case of a JSON file with a list of them."""
    return spark.read.schema(CASES).option("multiLine", True).json(path).select(F.inline("cases"))


def chat_requests(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, model, stream, turn, role, parts, corrupt): one row per message;
    text content is one part. A body that isn't JSON has corrupt true."""
    parsed = df.select(key, F.from_json(body, CHAT, {"mode": "PERMISSIVE"}).alias("_b"))
    bad = F.col("_b").isNull() | F.col("_b._corrupt_record").isNotNull()
    rows = parsed.select(key, "_b.model", "_b.stream", bad.alias("corrupt"), F.posexplode_outer("_b.messages").alias("turn", "_m"))
    content = F.col("_m.content")
    parts = F.when(content.startswith("["), F.from_json(content, PARTS)).otherwise(F.array(F.struct(F.lit("text").alias("type"), content.alias("text"))))
    return rows.select(key, "model", "stream", "turn", F.col("_m.role").alias("role"), parts.alias("parts"), "corrupt")


def text_of_parts(parts: Column) -> Column:
    """The text parts, one per line."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")


def sse_frames(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, seq, data, done): frames of an event stream's body; the lines of
    one frame's data are joined, and [DONE] ends the stream."""
    frames = df.select(key, F.posexplode(F.split(F.replace(F.col(body), F.lit("\r\n"), F.lit("\n")), "\n\n")).alias("seq", "_f"))
    lines = F.filter(F.split("_f", "\n"), lambda x: x.startswith("data:"))
    data = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, "^data: ?", "")), "\n")
    return frames.where(F.size(lines) > 0).select(key, "seq", data.alias("data"), (data == "[DONE]").alias("done"))


def deltas(frames: DataFrame, key: str) -> DataFrame:
    """(key, choice, seq, chunk, done) of chat completion frames: seq counts the
    chunks of each choice, and done is its last one."""
    shape = "choices array<struct<index:int,delta:struct<content:string>>>"
    rows = frames.where("not done").select(key, F.col("seq").alias("_frame"), F.inline(F.from_json("data", shape)["choices"]))
    one = Window.partitionBy(key, "choice").orderBy("_frame")
    each = rows.select(key, F.coalesce("index", F.lit(0)).alias("choice"), "_frame", F.coalesce("delta.content", F.lit("")).alias("chunk"))
    return each.select(key, "choice", (F.row_number().over(one) - 1).cast("long").alias("seq"), "chunk", F.lead("_frame").over(one).isNull().alias("done"))
