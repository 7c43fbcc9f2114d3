"""Packing of token sequences (operator 2).

Bounded-space online packing: every partition keeps a fixed number of open
windows. A document's whole windows are emitted at once; what is left of it is
placed best-fit (in the open window with the least room that holds it). When
none fits, the fullest window is emitted, after its room, if it is worth a cut,
was filled with the head of what is being placed. At the end the leftovers of
groups of neighbouring partitions are merged, longest piece first.

The number of windows held, and of partitions merged in one task, are fixed, so
memory doesn't grow with the input.

Defined results: a null or empty text is the single end id; repeated rows are
packed each; a null id is carried as such; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BytePairCodec, vocabulary_path
from .common import Texts, bounded_batches, materialize

#: Open windows of one partition.
OPEN_WINDOWS = 32
#: Tokens of room from which a document is cut to fill a window.
LEAST_CUT = 8
#: Partitions whose leftovers one task merges.
MERGED_PARTITIONS = 32


class LibraryCodec(BytePairCodec):
    """The same ids, with unknown pre-tokens merged by the tiktoken library
    where the vocabulary's ids follow its ranks."""

    def __init__(self, path: str):
        super().__init__(path)
        self.library = None
        if self.made == sorted(self.made) and self.made and self.made[0] > max(self.first):
            import tiktoken

            ranks = {p: i for i, p in enumerate(self.pieces) if i not in self.special.values()}
            self.library = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def merge(self, piece: bytes) -> list[int]:
        if self.library is None or len(piece) < 2:
            return super().merge(piece)
        return self.library.encode_ordinary(piece.decode("utf-8"))


@functools.lru_cache(maxsize=2)
def library_codec(path: str) -> LibraryCodec:
    return LibraryCodec(path)


class Windows:
    """The open windows of one partition: lists of pieces and tokens used."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.used: list[int] = []
        self.held: list[list[tuple]] = []

    def best(self, need: int) -> int:
        """The fullest open window with room for ``need`` tokens, or -1."""
        best, most = -1, -1
        limit = self.capacity - need
        for i, used in enumerate(self.used):
            if most < used <= limit:
                best, most = i, used
        return best

    def fullest(self) -> int:
        return max(range(len(self.used)), key=self.used.__getitem__)

    def put(self, i: int, piece: tuple, length: int) -> list[tuple] | None:
        """Place a piece (in a new window if i is -1); a full window's pieces."""
        if i < 0:
            self.used.append(0)
            self.held.append([])
            i = len(self.used) - 1
        self.used[i] += length
        self.held[i].append(piece)
        return self.take(i) if self.used[i] == self.capacity else None

    def take(self, i: int) -> list[tuple]:
        self.used[i], self.used[-1] = self.used[-1], self.used[i]
        self.held[i], self.held[-1] = self.held[-1], self.held[i]
        self.used.pop()
        return self.held.pop()


def place(windows: Windows, length: int, piece, least_cut: int) -> Iterator[list[tuple]]:
    """Place ``length`` tokens; ``piece(start, length)`` makes a piece of them.
    Yields the pieces of each window that is emitted."""
    start = 0
    while start < length:
        need = length - start
        if need >= windows.capacity:
            yield [piece(start, windows.capacity)]
            start += windows.capacity
            continue
        i = windows.best(need)
        if i < 0 and len(windows.used) >= windows.most:
            i = windows.fullest()
            room = windows.capacity - windows.used[i]
            if room >= least_cut:
                yield windows.put(i, piece(start, room), room)
                start += room
            else:
                yield windows.take(i)
            continue
        if full := windows.put(i, piece(start, need), need):
            yield full
        start = length


def pack_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, path: str | None = None, end_id: int = 0,
    open_windows: int = OPEN_WINDOWS, least_cut: int = LEAST_CUT, with_ids: bool = False,
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of
    every piece; pieces of one sequence_id make a sequence of at most
    ``capacity`` tokens. ``with_ids`` adds the piece's ids as an array.

    Pieces carry their ids through the written table and the merge; ids_crc32
    is worked out at the end, from what came through."""
    path = path or vocabulary_path()
    spark = df.sparkSession
    picked = df.select(id_col, df[text_col].cast("string").alias("text"))
    id_type = dict(picked.dtypes)[id_col]
    names = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "closed", "_ids"]
    fields = f"`{id_col}` {id_type}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, closed boolean, _ids binary"
    end = end_id.to_bytes(4, "little")

    def rows(window: list[tuple], sequence: int, closed: bool) -> list[tuple]:
        out, at = [], 0
        for piece in window:
            out.append((*piece[:4], sequence, at, closed, piece[4]))
            at += piece[2]
        return out

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = library_codec(path)
        windows = Windows(capacity, open_windows)
        sequence = TaskContext.get().partitionId() << 32

        def batch_of(made: list[tuple], like: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*made, strict=True))
            types = [like, *[pa.int64()] * 5, pa.bool_(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        like = None
        for batch in batches:
            made: list[tuple] = []
            like = batch.column(0).type
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = own.encode(text.as_py()) + end
                total = len(ids) // 4

                def piece(start: int, length: int, one=one, ids=ids, total=total) -> tuple:
                    return (one, start, length, total, ids[4 * start : 4 * (start + length)])

                for window in place(windows, total, piece, least_cut):
                    made += rows(window, sequence, True)
                    sequence += 1
            if made:
                yield batch_of(made, like)
        made = []
        while windows.used:
            made += rows(windows.take(len(windows.used) - 1), sequence, False)
            sequence += 1
        if made:
            yield batch_of(made, like)

    def merge(table: pa.Table) -> pa.Table:
        """Best-fit, longest piece first; ties by sequence and offset. Ids and
        tokens are taken by index, so they stay what they were."""
        lengths, before, at = (table.column(c).to_numpy() for c in ("length", "sequence_id", "offset"))
        order = np.lexsort((at, before, -lengths))
        used: list[int] = []
        sequence, offset, room_of = [], [], {}
        low = table.column("_group")[0].as_py() << 32 | 1 << 62
        for length in lengths[order].tolist():
            best = -1
            for room in range(length, capacity + 1):  # least room that holds it
                if room_of.get(room):
                    best = room_of[room].pop()
                    break
            if best < 0:
                best = len(used)
                used.append(0)
            sequence.append(low + best)
            offset.append(used[best])
            used[best] += length
            if used[best] < capacity:
                room_of.setdefault(capacity - used[best], []).append(best)
        new = {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())}
        return pa.table({c: new[c] if c in new else table.column(at_of[c]).take(pa.array(order)) for c in kept})

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of ids as arrays."""
        for batch in batches:
            ids = Texts(batch.column(batch.num_columns - 1))
            lists = pa.ListArray.from_arrays(pa.array((ids.offsets // 4).astype(np.int32)), pa.array(np.frombuffer(ids.data.tobytes(), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*out, "ids"])

    bounded_batches(spark)
    packed = materialize(spark, picked.mapInArrow(pack, fields), "packed")
    kept = [c for c in names if c != "closed"]
    at_of = {c: i for i, c in enumerate(names)}
    left = packed.where(~F.col("closed")).withColumn("_group", F.floor(F.shiftright("sequence_id", 32) / F.lit(MERGED_PARTITIONS)))
    merged = left.groupBy("_group").applyInArrow(merge, fields.replace(", closed boolean", ""))
    both = packed.where("closed").select(*kept).unionByName(merged)
    out = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = both.withColumn("ids_crc32", F.crc32("_ids")).select(*out, "_ids")
    return whole.mapInArrow(listed, f"`{id_col}` {id_type}, " + ", ".join(f"{c} bigint" for c in out[1:]) + ", ids array<int>") if with_ids else whole.drop("_ids")
