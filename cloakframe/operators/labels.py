"""Labels: consistent placeholders per document or per conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.languages import FAMILY_NAME_FIRST, LABEL_KEYS, NAME_PARTS, label_words, per_language
from .detect import value_of
from .spans import EDGE

#: Surname particles of languages that put the given name first.
PARTICLES = ["al", "bin", "binti", "da", "das", "de", "degli", "del", "della", "den", "der", "di", "dos", "du", "el", "la", "le", "ten", "ter", "van", "von"]

ENTRIES = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("value", T.StringType())]))
PIECES = T.ArrayType(
    T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("entity_type", "value", "label")]])
)


def spliced(text: Column, pieces: Column) -> Column:
    """Text with pieces (start, end, label), disjoint and in order, put in."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(
        pieces,
        start,
        lambda a, p: F.struct(p["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, p["start"] - a["at"]), p["label"]).alias("out")),
        lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)),
    )
    return F.when(F.size(pieces) == 0, text).otherwise(done)


def valued_spans(text: Column, merged: Column) -> Column:
    """array(start, end, entity_type, value)."""
    return F.transform(merged, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"), value_of(text, s).alias("value")))


def label_pieces(valued: Column, language: Column) -> Column:
    """array(start, end, entity_type, value, label): a value's number is its
    place among the distinct values of its type, by first appearance."""
    distinct = F.array_distinct(F.transform(valued, lambda o: F.struct(o["entity_type"].alias("t"), o["value"].alias("v"))))

    def labelled(v: Column) -> Column:
        of_type = F.transform(F.filter(distinct, lambda o: o["t"] == v["entity_type"]), lambda o: o["v"])
        label = F.concat(F.lit("<"), per_language(language, v["entity_type"]), F.lit("_"), F.array_position(of_type, v["value"]).cast("string"), F.lit(">"))
        return F.struct(v["start"].alias("start"), v["end"].alias("end"), v["entity_type"].alias("entity_type"), v["value"].alias("value"), label.alias("label"))

    return F.when(F.size(valued) == 0, F.array().cast(PIECES)).otherwise(F.transform(valued, labelled))


def mapping_of(pieces: Column) -> Column:
    """Ordered array(label, value), each label once."""
    return F.array_distinct(F.transform(pieces, lambda p: F.struct(p["label"].alias("label"), p["value"].alias("value"))))


def split_name(source: str, family_first: bool) -> list[tuple[str, int, int]]:
    """(part, start, end) of a name of two or more words, in text order."""
    words, at = [], 0
    for piece in "".join(" " if c in EDGE else c for c in source).split(" "):
        if piece:
            words.append((at, at + len(piece)))
        at += len(piece) + 1
    if len(words) < 2:
        return []
    cut = len(words) - 1
    if not family_first:
        cut = next((i for i in range(1, cut) if source[slice(*words[i])].lower() in PARTICLES), cut)
    groups = [words[:1], words[1:cut], words[cut:]]
    names = ("last", "middle", "first") if family_first else ("first", "middle", "last")
    return [(name, g[0][0], g[-1][1]) for name, g in zip(names, groups, strict=True) if g]


def split_name_columns(source: Column, family_first: Column) -> Column:
    """The same as a Column: array(part, start, end)."""
    # words are found by walking the split gaps; offsets follow from lengths
    flat = F.translate(source, EDGE, "     ")
    pieces = F.split(flat, " ", -1)
    spot = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("w")),
        lambda a, p: F.struct((a["at"] + F.length(p) + 1).alias("at"), F.when(F.length(p) > 0, F.concat(a["w"], F.array(F.struct(a["at"].alias("s"), (a["at"] + F.length(p)).alias("e"))))).otherwise(a["w"]).alias("w")),
        lambda a: a["w"],
    )

    def parts(w: Column) -> Column:
        n = F.size(w)
        inner = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("i"), F.lower(F.substring(source, x["s"] + 1, x["e"] - x["s"])).isin(*PARTICLES).alias("p"))), lambda x: x["p"] & (x["i"] > 0) & (x["i"] < n - 1))
        cut = F.when(~family_first & (F.size(inner) > 0), F.get(inner, F.lit(0))["i"]).otherwise(n - 1)
        one = lambda name, a, b: F.struct(name.alias("part"), F.get(w, a)["s"].alias("start"), F.get(w, b)["e"].alias("end"))
        first = F.when(family_first, F.lit("last")).otherwise(F.lit("first"))
        last = F.when(family_first, F.lit("first")).otherwise(F.lit("last"))
        return F.concat(
            F.array(one(first, F.lit(0), F.lit(0))),
            F.when(cut > 1, F.array(one(F.lit("middle"), F.lit(1), cut - 1))).otherwise(F.array().cast("array<struct<part:string,start:int,end:int>>")),
            F.array(one(last, cut, n - 1)),
        )

    return F.when(F.size(spot) >= 2, parts(spot)).otherwise(F.array().cast("array<struct<part:string,start:int,end:int>>"))


def pieces_with_parts(text: str, merged: list[dict], language: str) -> tuple[list[dict], list[dict]]:
    """Pieces and ordered mapping, with names of several words labelled by part.

    A name's parts share its number; a later single word equal to a part that
    was seen takes that part's label.
    """
    words, family_first = label_words(language), language in FAMILY_NAME_FIRST
    numbers: dict[tuple[str, str], int] = {}
    used: dict[str, int] = {}
    part_label: dict[str, str] = {}
    mapping: dict[str, str] = {}
    pieces = []

    def number(kind: str, value: str, split: bool) -> int:
        key = (kind + " split" * split, value)
        if key not in numbers:
            used[kind] = numbers[key] = used.get(kind, 0) + 1
        return numbers[key]

    for s in merged:
        kind, value = s["entity_type"], text[s["start"] : s["end"]]
        parts = split_name(value, family_first) if kind == "PERSON" else []
        word = words.get(kind, kind)
        for name, low, high in parts:
            label = f"<{word}_{number(kind, value, True)}_{words[NAME_PARTS[name]]}>"
            mapping.setdefault(label, value[low:high])
            part_label.setdefault(value[low:high], label)
            pieces.append({"start": s["start"] + low, "end": s["start"] + high, "entity_type": kind, "value": value[low:high], "label": label})
        if not parts:
            label = part_label.get(value) if kind == "PERSON" else None
            if label is None:
                label = f"<{word}_{number(kind, value, False)}>"
                mapping[label] = value
            pieces.append({"start": s["start"], "end": s["end"], "entity_type": kind, "value": value, "label": label})
    return pieces, [{"label": k, "value": v} for k, v in mapping.items()]


def with_split_labels(df: DataFrame, text: str, merged: str, language: str, pieces: str = "pieces", mapping: str = "mapping") -> DataFrame:
    """``df`` with pieces and mapping by ``pieces_with_parts``, in an Arrow pass
    that leaves the other columns alone."""
    at = [df.columns.index(c) for c in (text, merged, language)]
    schema = T.StructType([*df.schema.fields, T.StructField(pieces, PIECES), T.StructField(mapping, ENTRIES)])
    entry = pa.struct([("label", pa.string()), ("value", pa.string())])
    piece = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity_type", pa.string()), ("value", pa.string()), ("label", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pieces_with_parts(*row) for row in zip(*[batch.column(i).to_pylist() for i in at], strict=True)]
            columns = [pa.array([m[k] for m in made], pa.list_(kind)) for k, kind in enumerate((piece, entry))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, pieces, mapping])

    return df.mapInArrow(run, schema)


def conversation_labels(df: DataFrame, conv: str, turn: str, pieces: str) -> DataFrame:
    """(conv, turn, start, end, label, value): pieces of all messages relabelled
    so that a value has one label in its conversation.

    Per conversation and label word, values (or, of names in parts, groups of
    parts) are numbered by first appearance: by turn, plain labels before
    groups, then position. Shuffled by conversation; a conversation's distinct
    values are ranked, never its text.
    """
    at = r"^<([^<>\s]{1,64})_(\d{1,6})(?:_([^<>\s]{1,32}))?>$"
    rows = df.select(F.col(conv), F.col(turn), F.posexplode(pieces).alias("_place", "_p")).select(
        conv, turn, "_place", "_p.*", F.regexp_extract("_p.label", at, 1).alias("_word"), F.regexp_extract("_p.label", at, 2).alias("_index"), F.regexp_extract("_p.label", at, 3).alias("_part")
    )
    group = Window.partitionBy(conv, turn, "_word", "_index", F.col("_part") != "")
    signed = rows.withColumn("_sign", F.when(F.col("_part") == "", F.col("value")).otherwise(F.array_join(F.array_sort(F.collect_set(F.concat("_part", F.lit("\x00"), "value")).over(group)), "\x00")))
    signed = signed.withColumn("_split", F.col("_part") != "")
    keys = [conv, "_word", "_split", "_sign"]
    seen = signed.groupBy(*keys).agg(F.min(F.struct(F.col(turn).alias("t"), F.col("_split").alias("s"), F.col("_place").alias("p"))).alias("_first"))
    ranked = seen.withColumn("_number", F.row_number().over(Window.partitionBy(conv, "_word").orderBy("_first", "_sign"))).drop("_first")
    label = F.concat(F.lit("<"), "_word", F.lit("_"), F.col("_number").cast("string"), F.when(F.col("_split"), F.concat(F.lit("_"), "_part")).otherwise(F.lit("")), F.lit(">"))
    return signed.join(ranked, keys).select(conv, turn, "start", "end", "entity_type", label.alias("label"), "value")


def mask_conversations(df: DataFrame, conv: str, turn: str, text: str, pieces: str) -> DataFrame:
    """(conv, turn, masked_text) of every message, labels consistent per conversation."""
    labelled = conversation_labels(df, conv, turn, pieces).groupBy(conv, turn).agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("_pieces"))
    return df.join(labelled, [conv, turn], "left").select(conv, turn, F.when(F.col("_pieces").isNull(), F.col(text)).otherwise(spliced(F.col(text), F.col("_pieces"))).alias("masked_text"))


assert set(NAME_PARTS.values()) < set(LABEL_KEYS)
