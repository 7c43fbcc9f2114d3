"""Byte-pair encoding and decoding (operator 3).

A text is cut into pre-tokens; each pre-token's bytes become a doubly linked
list of symbols, and a priority queue of merge ranks joins neighbours until no
merge is left. Queue entries whose symbols have changed meanwhile are stale and
are skipped. Decoding concatenates the vocabulary's byte strings.

Pre-tokens repeat a lot, so their ids are kept in a bounded table of each
worker; a full table is emptied and fills again.

Defined results: a null or empty text has 0 ids and decodes to ''. Rows are
independent, so repeated rows, ties of ids, nulls in other columns and extra
columns don't matter; an empty table gives an empty table. Texts are encoded
whole, whatever their length.
"""

from __future__ import annotations

import array
import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounded_batches

VOCABULARY = "byte_bpe_50k.json"
#: Entries of the table of known pre-tokens, for one worker.
KNOWN_PIECES = 700_000
#: Pre-tokens longer than this are not kept.
KNOWN_LENGTH = 64

#: The pre-tokenizer's pattern (fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same cuts for texts of printable ASCII, Latin letters, tabs and line
#: ends, in the standard library's engine, which is several times as fast.
_LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_LATIN_TOKEN = re.compile(rf" ?[{_LATIN}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+", re.ASCII)
_NOT_LATIN = re.compile(rf"[^{_LATIN}\x20-\x7e\t\n\r]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where a vocabulary file of the installed public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class BytePairCodec:
    """Encodes and decodes with the vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        of_symbol = {s: b for b, s in enumerate(symbols)}
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for piece, i in vocab.items():
            self.pieces[i] = piece.encode() if piece in self.special else bytes(of_symbol[c] for c in piece)
        for piece, i in self.special.items():
            self.pieces[i] = piece.encode()
        self.first = [vocab[s] for s in symbols]
        #: by rank: the pair's ids and the id that it becomes
        self.left: list[int] = []
        self.right: list[int] = []
        self.made: list[int] = []
        #: by left id: right id -> rank
        none: dict[int, int] = {}
        self.rank: list[dict[int, int]] = [none] * size
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            i, j = vocab[left], vocab[right]
            if self.rank[i] is none:
                self.rank[i] = {}
            self.rank[i][j] = rank
            self.left.append(i)
            self.right.append(j)
            self.made.append(vocab[left + right])
        self.pre_token = regex.compile(PRE_TOKEN)
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        first = self.first
        ids = [first[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        rank_of = self.rank
        #: an entry is rank * n + position of the left symbol
        queue = [found * n + i for i in range(n - 1) if (found := rank_of[ids[i]].get(ids[i + 1])) is not None]
        if not queue:
            return ids
        heapq.heapify(queue)
        pop, push, left, right, made = heapq.heappop, heapq.heappush, self.left, self.right, self.made
        ids.append(-1)  # beyond the end
        after = list(range(1, n + 1))
        before = list(range(-1, n))
        while queue:
            rank, i = divmod(pop(queue), n)
            j = after[i] if ids[i] == left[rank] else n
            if ids[j] != right[rank]:
                continue  # stale: one of the two was merged since
            ids[i] = one = made[rank]
            ids[j] = -1
            after[i] = k = after[j]
            before[k] = i
            if (found := rank_of[one].get(ids[k])) is not None:
                push(queue, found * n + i)
            h = before[i]
            if h >= 0 and (found := rank_of[ids[h]].get(one)) is not None:
                push(queue, found * n + h)
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> bytes:
        ids = self.merge(piece.encode("utf-8", "surrogatepass"))
        out = array.array("I", ids).tobytes()
        if len(piece) <= KNOWN_LENGTH:
            if len(self.known) >= KNOWN_PIECES:
                self.known.clear()
            self.known[piece] = out
        return out

    def _segment(self, text: str) -> bytes:
        """Text without special tokens."""
        cut = self.pre_token if _NOT_LATIN.search(text) else _LATIN_TOKEN
        known, one = self.known.get, self._piece
        return b"".join([known(p) or one(p) for p in cut.findall(text)])

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self.split_special is None or not any(s in text for s in self.special):
            return self._segment(text)
        return b"".join(
            self.special[part].to_bytes(4, "little") if part in self.special else self._segment(part)
            for part in self.split_special.split(text)
            if part
        )

    def decode(self, ids: bytes) -> str:
        """Text of such ids; bytes that aren't UTF-8 become U+FFFD."""
        pieces = self.pieces
        return b"".join([pieces[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> BytePairCodec:
    """The worker's codec of a vocabulary file."""
    return BytePairCodec(path)


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids, decoded): the ids of every text as an array and their text.

    Narrow: one Arrow pass, no shuffle. See the module for defined results.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([memoryview(x).cast("I").tolist() for x in ids], pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids], pa.string())],
                [id_col, "ids", "decoded"],
            )

    bounded_batches(df.sparkSession)
    picked = df.select(id_col, df[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, f"`{id_col}` {dict(picked.dtypes)[id_col]}, ids array<int>, decoded string")


def digest_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text, from the
    same codec as ``encode_documents`` without carrying the ids to the JVM."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        sha = hashlib.sha256
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column(1):
                ids = own.encode(text.as_py())
                counts.append(len(ids) // 4)
                of_ids.append(sha(ids).hexdigest())
                of_text.append(sha(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    bounded_batches(df.sparkSession)
    picked = df.select(id_col, df[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, f"`{id_col}` {dict(picked.dtypes)[id_col]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
