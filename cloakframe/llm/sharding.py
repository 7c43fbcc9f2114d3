"""Sharding by a two-pass external shuffle (operator 1), in DataFrame operations only.

Pass one scatters records: a seeded rendezvous hash of the id picks the shard,
a second seeded hash of the id and the row's place in the input picks one of
the shard's buckets, whose number is chosen so that a bucket fits in memory.
Pass two shuffles every bucket by Fisher-Yates (Spark's ``shuffle``) and writes
it; a row's slot is its place in the bucket after the rows of earlier buckets.

Law ``key``: id and number of shards alone decide the shard, and one more shard
takes rows only into itself. Buckets don't depend on the id alone, so that an
id that holds many rows is spread over the buckets of its shard.

Defined results: null text has size 1 and crc32 of no bytes (0); a null id is
hashed as such and gets a shard like others; repeated rows each get a slot of
their own; an empty table gives an empty table; extra columns are written with
the records.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import discard, materialize, shared_dir

#: Bytes of records that one bucket holds on average.
BUCKET_BYTES = 16 << 20


#: Low bits of a draw that hold the shard; the same for any number of shards,
#: so that an id's draws don't change when a shard is added.
SHARD_BITS = 16


def rendezvous(id_col: str, shards: int, seed: int) -> tuple[Column, Column]:
    """The id's shard among ``shards``, and among one more."""
    low, key = 1 << SHARD_BITS, F.col(id_col).cast("string")
    if not 0 < shards < low:
        raise ValueError(f"shards must be from 1 to {low - 1}")
    draws = [F.xxhash64(F.lit(seed), key, F.lit(s)).bitwiseAND(F.lit(-low)).bitwiseOR(F.lit(s).cast("long")) for s in range(shards + 1)]
    best = F.greatest(*draws[:shards]) if shards > 1 else draws[0]
    shard = best.bitwiseAND(F.lit(low - 1)).cast("int")
    return shard, F.when(draws[shards] > best, F.lit(shards)).otherwise(shard).cast("int")


def scatter(df: DataFrame, id_col: str, size: Column, shards: int, seed: int) -> DataFrame:
    """Pass one's draws: columns _shard, _grown, _draw (for the bucket), _size."""
    shard, grown = rendezvous(id_col, shards, seed)
    place = F.monotonically_increasing_id()
    return df.withColumns({"_shard": shard, "_grown": grown, "_draw": F.xxhash64(F.lit(seed + 1), F.col(id_col).cast("string"), place), "_size": size})


def shuffle_buckets(drawn: DataFrame, bucket_bytes: int, seed: int) -> DataFrame:
    """Pass two: every bucket in Fisher-Yates order, as rows with _slot.

    A shard has as many buckets as its own bytes take, so that one that holds
    most of the rows has more, not larger ones. The bucket is sorted by its
    draws first, so the same input in the same splits, with the same seed and
    number of shuffle partitions, gives the same order.
    """
    rest = [c for c in drawn.columns if c not in ("_shard", "_draw")]
    buckets = drawn.groupBy("_shard").agg(F.greatest(F.lit(1), F.ceil(F.sum("_size") / bucket_bytes)).alias("_buckets"))
    keyed = drawn.join(F.broadcast(buckets), "_shard").withColumn("_bucket", F.pmod("_draw", F.col("_buckets")).cast("int")).drop("_buckets")
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy("_shard", "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    held = (
        keyed.groupBy("_shard", "_bucket")
        .agg(F.sort_array(F.collect_list(F.struct("_draw", *rest))).alias("_rows"))
        .join(starts, ["_shard", "_bucket"])
        .sortWithinPartitions("_shard", "_bucket")
    )
    shuffled = held.select("_shard", "_start", F.posexplode(F.shuffle("_rows", seed)).alias("_at", "_row"))
    return shuffled.select("_shard", (F.col("_start") + F.col("_at")).alias("_slot"), *[F.col(f"_row.{c}").alias(c) for c in rest])


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    Whole records are written as shards in the shared folder; all columns are
    taken from what is read back from there.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/written-{uuid.uuid4().hex}"
    write_shards(df, path, id_col, text_col, shards, seed, bucket_bytes)
    fields = [f for f in df.schema.fields if f.name in (id_col, text_col)]
    slot, shard = unused("slot", df.columns), unused("shard", df.columns)
    back = spark.read.schema(StructType([*fields, StructField(slot, LongType()), StructField(shard, IntegerType())])).parquet(path)
    raw = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    return back.select(
        id_col,
        (F.octet_length(raw).cast("long") + F.lit(1)).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col(shard).alias("shard"),
        F.col(slot).alias("slot"),
        rendezvous(id_col, shards, seed)[1].alias("grown_shard"),
    )


def unused(name: str, taken: list[str]) -> str:
    """``name``, with underscores appended until no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write whole records as Parquet under ``path``/shard=N in shuffled order.

    Columns must be orderable (no maps). The record's slot is column ``slot``;
    where records have columns ``slot`` or ``shard``, they stay, and the new
    ones get underscores appended. Pass one is written out, so that both counts
    and records of pass two come from the same draws.
    """
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long") + F.lit(1)
    records = df.select(F.col(id_col).alias("_key"), size.alias("_bytes"), F.struct("*").alias("_record"))
    drawn = scatter(records, "_key", F.col("_bytes"), shards, seed).select("_shard", "_draw", "_size", "_record")
    drawn = materialize(df.sparkSession, drawn, "scattered", "zstd")
    out = shuffle_buckets(drawn, bucket_bytes, seed)
    slot, shard = unused("slot", df.columns), unused("shard", df.columns)
    out.select("_record.*", F.col("_slot").cast("long").alias(slot), F.col("_shard").alias(shard)).write.partitionBy(shard).parquet(path)
    discard(drawn)
