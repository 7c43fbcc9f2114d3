"""Shared plumbing of the training-data operators: durable hand-over tables,
Arrow batches seen as byte blocks, and 64-bit hashes of words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every word-based contract: space and U+0009 to U+000D.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Rows of one Arrow batch; a bound on what a Python worker holds at a time.
BATCH_ROWS = 256
#: Bytes of text that one vectorised pass looks at.
BLOCK_BYTES = 2 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)


def shared_dir(spark: SparkSession, default: str = "/tmp/cloakframe-checkpoints") -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs on this machine alone (local
    tests) is ``default`` set for it; on a cluster a missing setting is an error,
    for a folder of the driver's is not one of the executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context.getCheckpointDir()
        if not found:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(default)
            found = default
    return found.rstrip("/")


def materialize(spark: SparkSession, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage
    is cut, lost executors lose nothing, and nothing upstream runs twice."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` wrote, once no result reads them."""
    for df in tables:
        path = getattr(df, "_written_at", None) if df is not None else None
        if isinstance(path, str):
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``BATCH_ROWS`` rows, so that long texts fit."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: Rows of ids up to which they are broadcast.
BROADCAST_ROWS = 1_000_000


def sized(ids: DataFrame) -> DataFrame:
    """``ids`` (written out, narrow) with a hint to broadcast it if it is small."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def without(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose id isn't among ``ids`` (its column ``id``); a null
    id is like another value here."""
    gone = sized(materialize(df.sparkSession, ids.select(F.col("id").alias("_gone")).distinct(), "gone"))
    return df.join(gone, df[id_col].eqNullSafe(gone["_gone"]), "left_anti")


def spread(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_crc_mod(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null id: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def sampled(df: DataFrame, id_col: str, share: float, seed: int) -> DataFrame:
    """The rows whose seeded hash falls in the lowest ``share`` of its range."""
    if share >= 1:
        return df
    bound = int(share * 2**32)
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), F.lit(2**32)) < F.lit(bound))


class Texts:
    """The texts of some rows as one run of bytes: ``data`` and row ``offsets``.

    A null text is an empty run.
    """

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        n = len(column)
        _, raw_offsets, raw = column.buffers()
        offsets = np.frombuffer(raw_offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
        if column.null_count:
            sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
            whole = np.concatenate([[0], np.cumsum(sizes)])
            data = b"".join(x or b"" for x in column.to_pylist())
            self.offsets, self.data = whole, np.frombuffer(data, np.uint8)
        else:
            data = np.frombuffer(raw, np.uint8) if raw is not None and len(raw) else np.zeros(0, np.uint8)
            self.data = data[offsets[0] : offsets[-1]]
            self.offsets = offsets - offsets[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts come to about ``size`` bytes, one row at least."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    at, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > at and total + n > size:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield at, len(lengths)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 2**64))])
                self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 2**64))])
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def words(texts: Texts, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and each row's offsets into them.

    Words are runs of bytes outside ``SPACE_BYTES``; ``lower`` folds A-Z.
    """
    data, rows = texts.data, texts.offsets
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    space = _IS_SPACE[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    filled = np.flatnonzero(np.diff(rows))
    before[rows[:-1][filled]] = True
    after[rows[1:][filled] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return run_hashes(data, starts, ends, _LOWER if lower else _SAME), np.searchsorted(starts, rows)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = _SAME) -> np.ndarray:
    """64-bit hashes of runs of bytes (in order, disjoint), of any length."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):  # long rows go through in pieces of whole runs
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, "right")))
        low, high = int(starts[at]), int(ends[upto - 1])
        up, down = _POWERS.of(high - low)
        with np.errstate(over="ignore"):
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum((fold[data[low:high]].astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
            s, e = starts[at:upto] - low, ends[at:upto] - low
            out[at:upto] = (sums[e] - sums[s]) * down[s]
        at = upto
    return mix(out)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``values`` (along its first axis); empty runs: 0."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.add.reduceat(values, offsets[:-1][some], axis=0)
    return out
