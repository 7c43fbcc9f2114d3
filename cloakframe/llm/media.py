"""Media columns: AVI with lossless motion-JPEG frames (operator 4).

A payload of whole 24 x 24 frames of 8-bit samples is stored as a RIFF AVI file
whose frames are intra-coded JPEG images of the lossless process (SOF3, one
component, predictor 1). The Huffman table gives difference category s a code
of 9 - s bits (nine codes, the all-ones word stays free), so each sample takes
nine bits with its extra bits, and frames are coded and decoded as arrays.

Reading parses the RIFF chunks and their idx1 index, decodes the frames (its own
as arrays, other lossless one-component images by their headers), and
detects shots: a cut is where the histogram difference of neighbouring frames
is above the mean plus a multiple of the deviation of the differences before.

Defined results: null or empty text is one frame of bytes 255; equal texts give
equal values; repeated rows, null ids and extra columns don't matter; an empty
table gives an empty table. Texts are stored whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches

SIDE = 24
FRAME = SIDE * SIDE
RATE = 24
#: Frames that are coded or decoded in one pass.
PASS_FRAMES = 4096
#: Histogram bins, frames looked back, deviations above the mean, least share of samples that move.
BINS, LOOK_BACK, DEVIATIONS, LEAST_MOVE = 16, 12, 3.0, 0.15


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Nine-bit word by difference + 255, and difference by word."""
    word, back = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = ((1 << (9 - s)) - 2) << s
        word[d + 255] = code | (d if d >= 0 else d + (1 << s) - 1)
        back[word[d + 255]] = d
    return word, back


_WORD, _BACK = _tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Everything of a frame's JPEG before its entropy-coded data.
JPEG_HEAD = (
    b"\xff\xd8"
    + _segment(0xC4, bytes([0x00, *[1] * 9, *[0] * 7, *range(8, -1, -1)]))
    + _segment(0xC3, struct.pack(">BHHB3B", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _segment(0xDA, bytes([1, 1, 0x00, 1, 0, 0]))
)
JPEG_TAIL = b"\xff\xd9"


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG images of frames (n, 24, 24) of 8-bit samples."""
    n = len(samples)
    x = samples.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    w = _WORD[d.reshape(-1, 8) + np.int16(255)]
    out = np.empty((len(w), 9), np.uint8)
    out[:, 0] = w[:, 0] >> 1
    for k in range(1, 8):
        out[:, k] = (w[:, k - 1] << (8 - k)) | (w[:, k] >> (k + 1))
    out[:, 8] = w[:, 7]
    data, size = out.tobytes(), FRAME * 9 // 8
    return [JPEG_HEAD + data[i * size : (i + 1) * size].replace(b"\xff", b"\xff\x00") + JPEG_TAIL for i in range(n)]


def _symbols(counts: bytes, values: bytes) -> np.ndarray:
    """For each 16 bits to come: length of the code there and its symbol, in one
    number (256 * length + symbol); 0 where no code is."""
    table, code, k = np.zeros(1 << 16, np.uint16), 0, 0
    for length, n in enumerate(counts, 1):
        for value in values[k : k + n]:
            if (code + 1) << (16 - length) > 1 << 16:
                raise ValueError("a Huffman table has too many codes")
            table[code << (16 - length) : (code + 1) << (16 - length)] = 256 * length + value
            code += 1
        code, k = code << 1, k + n
    return table


def decode_image(image: bytes) -> np.ndarray:
    """Samples (rows, columns) of a lossless JPEG image (SOF3) of one component
    of 2 to 8 bits, whatever its size, tables and predictor."""
    if image[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    at, tables, shape, precision = 2, {}, None, 8
    while True:
        if at + 4 > len(image) or image[at] != 0xFF:
            raise ValueError("a JPEG segment is cut short")
        marker, size = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
        body = image[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _symbols(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC3:
            precision, rows, columns, parts = struct.unpack(">BHHB", body[:6])
            if parts != 1 or not 2 <= precision <= 8 or not rows or not columns:
                raise ValueError("only one component of 2 to 8 bits is read")
            shape = rows, columns
        elif marker == 0xDD and any(body):
            raise ValueError("restart intervals aren't read")
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not the lossless process")
        elif marker == 0xDA:
            break
    if shape is None or body[0] != 1 or body[2] >> 4 not in tables or not 1 <= body[3] <= 7:
        raise ValueError("a scan without its frame, table or predictor")
    table, predictor, shift = tables[body[2] >> 4].tolist(), body[3], body[5] & 15
    data = image[at : image.rfind(b"\xff\xd9")].replace(b"\xff\x00", b"\xff")
    bits, spot, have, total = 0, 0, 0, 8 * len(data)
    rows, columns = shape
    out = [[0] * columns for _ in range(rows)]
    used = 0
    for y in range(rows):
        row, up = out[y], out[y - 1] if y else None
        for x in range(columns):
            while have < 32:
                bits = (bits << 8 | (data[spot] if spot < len(data) else 0)) & 0xFFFFFFFFFF
                spot, have = spot + 1, have + 8
            found = table[bits >> (have - 16) & 0xFFFF]
            length, s = found >> 8, found & 255
            if not length or s > 16 or used + length > total:
                raise ValueError("a frame's data is no code or is cut short")
            have -= length
            used += length + (s if s < 16 else 0)
            d = 32768 if s == 16 else 0
            if 0 < s < 16:
                have -= s
                d = bits >> have & ((1 << s) - 1)
                if not d >> (s - 1):
                    d -= (1 << s) - 1
            if up is None:
                guess = row[x - 1] if x else 1 << (precision - shift - 1)
            elif not x:
                guess = up[0]
            else:
                a, b, c = row[x - 1], up[x], up[x - 1]
                guess = (a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[predictor - 1]
            row[x] = (guess + d) & 0xFFFF
    if used > total:
        raise ValueError("a frame is cut short")
    return (np.array(out, np.int64) << shift).astype(np.uint8)


def decode_frames(images: list[bytes]) -> np.ndarray:
    """Frames (n, rows, columns) of intra-coded lossless images of one size.

    Images as ``encode_frames`` makes them are decoded together, as arrays;
    others one by one by their own headers. ValueError for what can't be read."""
    size, head, tail = FRAME * 9 // 8, len(JPEG_HEAD), len(JPEG_TAIL)
    if not all(x.startswith(JPEG_HEAD) and x.endswith(JPEG_TAIL) for x in images):
        frames = [decode_image(x) for x in images]
        if len({f.shape for f in frames}) > 1:
            raise ValueError("frames differ in size")
        return np.stack(frames)
    data = b"".join([x[head:-tail].replace(b"\xff\x00", b"\xff") for x in images])
    if len(data) != size * len(images):
        raise ValueError("a frame is cut short")
    b = np.frombuffer(data, np.uint8).reshape(-1, 9).astype(np.uint16)
    w = np.empty((len(b), 8), np.uint16)
    for k in range(8):
        w[:, k] = ((b[:, k] << (k + 1)) | (b[:, k + 1] >> (7 - k))) & 511
    d = _BACK[w].reshape(-1, SIDE, SIDE)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return np.cumsum(d, axis=2, dtype=np.int16).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """The payload (whole frames) as an AVI file with an idx1 index."""
    frames = len(payload) // FRAME
    movi, index, at = [b"movi"], [], 4
    samples = np.frombuffer(payload, np.uint8).reshape(-1, SIDE, SIDE)
    for i in range(0, frames, PASS_FRAMES):
        for image in encode_frames(samples[i : i + PASS_FRAMES]):
            index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(image)))
            movi.append(_chunk(b"00dc", image))
            at += len(movi[-1])
    main = struct.pack("<14I", 1_000_000 // RATE, 0, 0, 0x10, frames, 0, 1, 0, SIDE, SIDE, 0, 0, 0, 0)
    head = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, frames, 0, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    form = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    stream = b"strl" + _chunk(b"strh", head) + _chunk(b"strf", form)
    body = b"AVI " + _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", stream)) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def riff_chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks' bodies between two places."""
    while at + 8 <= end:
        name, size = bytes(data[at : at + 4]), int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > end:
            raise ValueError(f"chunk {name!r} runs over its end")
        yield name, at + 8, at + 8 + size
        at += 8 + size + (size & 1)


def read_avi(media: bytes) -> np.ndarray:
    """Frames (n, rows, columns) of an AVI file, found by its index."""
    data = memoryview(media)
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi = index = None
    for name, start, end in riff_chunks(data, 12, 8 + int.from_bytes(media[4:8], "little")):
        if name == b"LIST" and data[start : start + 4] == b"movi":
            movi = start
        elif name == b"idx1":
            index = np.frombuffer(data[start:end], np.dtype([("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    if movi is None or index is None:
        raise ValueError("no movi list or no idx1 index")
    out = []
    spots = [(movi + 8 + a, s) for a, s in zip(index["at"].tolist(), index["size"].tolist(), strict=True)]
    for i in range(0, len(spots), PASS_FRAMES):
        out.append(decode_frames([media[a : a + s] for a, s in spots[i : i + PASS_FRAMES]]))
    return np.concatenate(out) if out else np.zeros((0, SIDE, SIDE), np.uint8)


def shots(frames: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, frames) of each shot."""
    n = len(frames)
    if n < 3:
        return [(0, n)] if n else []
    moves = np.empty(n - 1)
    last = None
    for i in range(0, n, PASS_FRAMES):
        part = frames[i : i + PASS_FRAMES].reshape(-1, frames[0].size) // (256 // BINS)
        spot = part + (np.arange(len(part)) * BINS)[:, None]
        bars = np.bincount(spot.ravel(), minlength=len(part) * BINS).reshape(-1, BINS)
        if last is not None:
            bars = np.concatenate([last, bars])
        got = np.abs(np.diff(bars, axis=0)).sum(axis=1) / (2 * frames[0].size)
        low = i - (last is not None)
        moves[low : low + len(got)] = got
        last = bars[-1:]
    total = np.concatenate([[0], np.cumsum(moves)])
    square = np.concatenate([[0], np.cumsum(moves * moves)])
    k = np.arange(n - 1)
    low = np.maximum(k - LOOK_BACK, 0)
    seen = np.maximum(k - low, 1)
    mean = (total[k] - total[low]) / seen
    spread = np.sqrt(np.maximum((square[k] - square[low]) / seen - mean * mean, 0))
    cut = (moves > mean + DEVIATIONS * spread) & (moves >= LEAST_MOVE) & (k > 0)
    starts = [0, *(np.flatnonzero(cut) + 1).tolist()]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the text padded to whole frames."""
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(n, write_avi(p)) for n, p in map(payload_of, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made], pa.binary())], [id_col, "n_bytes", "media"])

    bounded_batches(df.sparkSession)
    picked = df.select(id_col, df[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, f"`{id_col}` {dict(picked.dtypes)[id_col]}, n_bytes bigint, media binary")


def media_clips(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, clip, first_frame, frames, start_s, end_s): timed clips of the media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, a, n) for i, media in enumerate(batch.column(1).to_pylist()) if media is not None for k, (a, n) in enumerate(shots(read_avi(media)))]
            at, k, a, n = (np.array([r[j] for r in rows], np.int64) for j in range(4))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(k), pa.array(a), pa.array(n), pa.array(a / RATE), pa.array((a + n) / RATE)], [id_col, "clip", "first_frame", "frames", "start_s", "end_s"])

    bounded_batches(df.sparkSession)
    picked = df.select(id_col, df[media_col].alias("media"))
    return picked.mapInArrow(run, f"`{id_col}` {dict(picked.dtypes)[id_col]}, clip bigint, first_frame bigint, frames bigint, start_s double, end_s double")


def digest_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text, read the stored bytes back, and return digests of both
    and the clips as ``feature``: first frame and frames of each, joined."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n, payload = payload_of(text.as_py())
                media = write_avi(payload)
                frames = read_avi(media)
                back = frames.tobytes()
                rows.append((n, len(back), sha(back).hexdigest(), zlib.crc32(back[-32:]), len(media), sha(media).hexdigest(), ",".join(f"{a}+{k}" for a, k in shots(frames))))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], [id_col, *names])

    bounded_batches(df.sparkSession)
    picked = df.select(id_col, df[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, f"`{id_col}` {dict(picked.dtypes)[id_col]}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
