"""Restoring chunked replies as they come in, with bounded state per stream."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import LONGEST_PLACEHOLDER, PLACEHOLDER
from ..operators.restore import restored

#: Fixed value: the start of what may still become a placeholder.
VIABLE = re.compile(r"<[^<>\s]{0,64}(?:_[0-9]{0,6})?(?:_[^<>\s]{0,32})?>?")
_WHOLE = re.compile(PLACEHOLDER.replace(r"\d", "[0-9]"))


def held_back(text: str) -> int:
    """Where the tail begins that may still become a placeholder."""
    low = max(0, len(text) - LONGEST_PLACEHOLDER)
    spots = [m.start() for m in re.finditer("<", text[low:])]
    for spot in reversed(spots):
        tail = text[low + spot :]
        if VIABLE.fullmatch(tail) and not _WHOLE.fullmatch(tail):
            return low + spot
    return len(text)


def replace_labels(text: str, mapping: list[tuple[str, str]]) -> str:
    for label, value in sorted(mapping, key=lambda m: -len(m[0])):
        text = text.replace(label, value)
    return text


class ChunkRestorer:
    """Restores chunks of one stream; holds back at most one placeholder."""

    def __init__(self, mapping: list[tuple[str, str]], pending: str = ""):
        self.mapping, self.pending = mapping, pending

    def push(self, chunk: str) -> str:
        text = self.pending + chunk
        cut = held_back(text)
        self.pending = text[cut:]
        return replace_labels(text[:cut], self.mapping)

    def flush(self) -> str:
        out, self.pending = replace_labels(self.pending, self.mapping), ""
        return out


OUTPUT = "stream_id string, choice int, seq bigint, text string, last boolean"
STATE = "next_seq bigint, pending string, early string, mapping string"
#: next_seq of a stream that has ended.
ENDED = -1
#: Milliseconds after which a stream that gets no more chunks is given up.
IDLE_MS = 3_600_000


def restore_stream(chunks: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """(stream_id, choice, seq, text, last) of a stream of (stream_id, seq, chunk,
    done, mapping[, choice]), where mapping is array(label, value), in all rows.

    Streams are restored by choice (0 where there is no such column). Chunks may
    come out of order: those that are early wait in the state, with the mapping,
    until the missing ones are there. The last row (done) flushes what is held
    back. An ended stream stays known for ``idle_ms``, so that late repeats
    don't open it again; one that gets no chunks for so long is flushed with
    all that waits, and forgotten. Beyond that a stream's state is at most one
    placeholder.
    """

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, pending, early, mapping = state.get if state.exists else (0, "", "{}", "[]")
        waiting = {int(k): v for k, v in json.loads(early).items()}
        pairs, out, ended = [tuple(m) for m in json.loads(mapping)], [], seq == ENDED
        if state.hasTimedOut:
            restorer = ChunkRestorer(pairs, pending)
            text = "".join(restorer.push(waiting[k][0]) for k in sorted(waiting)) + restorer.flush()
            state.remove()
            if text:
                yield pd.DataFrame([(*key, seq, text, True)], columns=_COLUMNS)
            return
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.mapping is not None and not pairs:
                    pairs = [(m["label"], m["value"]) for m in row.mapping]
                if not ended and row.seq >= seq:
                    waiting[int(row.seq)] = [row.chunk or "", bool(row.done)]
        restorer = ChunkRestorer(pairs, pending)
        while seq in waiting and not ended:
            chunk, ended = waiting.pop(seq)
            out.append((*key, seq, restorer.push(chunk) + (restorer.flush() if ended else ""), ended))
            seq += 1
        if ended:
            state.update((ENDED, "", "{}", "[]"))
        else:
            state.update((seq, restorer.pending, json.dumps(waiting), json.dumps(pairs if waiting or restorer.pending else [])))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    choice = F.col("choice").cast("int") if "choice" in chunks.columns else F.lit(0)
    rows = chunks.select(F.col("stream_id").cast("string").alias("stream_id"), F.coalesce(choice, F.lit(0)).alias("choice"), F.col("seq").cast("long").alias("seq"), "chunk", "done", "mapping")
    return rows.groupBy("stream_id", "choice").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


_COLUMNS = ["stream_id", "choice", "seq", "text", "last"]


def restore_batch(chunks: DataFrame) -> DataFrame:
    """The batch twin: (stream_id, text), chunks joined in order and restored."""
    whole = chunks.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("chunk", F.lit("")).alias("chunk")))).alias("_c"), F.first("mapping", ignorenulls=True).alias("_m"))
    text = F.array_join(F.transform("_c", lambda c: c["chunk"]), "")
    return whole.select("stream_id", F.when(F.col("_m").isNull(), text).otherwise(restored(text, F.col("_m"))).alias("text"))
