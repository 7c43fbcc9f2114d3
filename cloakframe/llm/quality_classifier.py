"""Quality classifier (operator 6): random-indexing word vectors, pooled per
document, and a two-layer numpy network with temperature-calibrated scores.

A text's words are runs of bytes of one kind (small letters and those of two
bytes, capitals, digits, others); a character of three or four bytes, as of
scripts that don't put spaces between words, is a word of its own. Whole words
are hashed into a fixed number of rows, which are parameters of the model as
the width is. Each row has a sparse random index vector; a word's
vector is the sum of the index vectors of its neighbours in the training texts,
scaled to length 1. A document is the mean of its words' vectors, with the rates
of repeated neighbours, of distinct words and of each kind.

Vectors and network are fitted on a bounded sample of labelled rows (``sample``
rows at most, about; chosen by seeded hashes of their ids): vectors are summed
on the executors, and the network sees the sample's pooled documents only. One
tenth of them sets the temperature. Scoring is one narrow pass over whole texts.

Defined results: null and empty texts have a vector of zeros and are scored as
such. Without labels of both kinds every score is the share of label 1 (0.5
without any). Null labels are ignored; several labels of one id count as the
least. Repeated rows get equal scores; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Texts, blocks, bounded_batches, id_crc_mod, mix, run_hashes, sampled, sums

#: Labelled rows that the fit takes, about.
SAMPLE = 6000
ROWS, WIDTH, NONZERO, NEIGHBOURS = 1 << 13, 32, 4, 2
HIDDEN, STEPS, SEED = 24, 400, 6
KINDS, ALONE = 6, 5

_KIND = np.full(256, 4, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[0xE0:] = ALONE


def index_vectors() -> np.ndarray:
    """Sparse random vectors of +1 and -1, one for each row."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((ROWS, WIDTH), np.float32)
    for _ in range(NONZERO):
        out[np.arange(ROWS), rng.integers(0, WIDTH, ROWS)] += rng.choice(np.array([-1.0, 1.0], np.float32), ROWS)
    return out


def word_rows(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the vector table, kind) of all words in order, and offsets."""
    data, rows = texts.data, texts.offsets
    kind = _KIND[data]
    first = np.empty(len(data), bool)
    if len(data):
        if (data >= 0xE0).any():  # bytes inside a character are of its first byte's kind
            spots = np.where((data & 0xC0) != 0x80, np.arange(len(data)), 0)
            kind = kind[np.maximum.accumulate(spots)]
        first[0] = True
        first[1:] = (kind[1:] != kind[:-1]) | (data[1:] >= 0xE0)
        first[rows[:-1][np.diff(rows) > 0]] = True
    bounds = np.append(np.flatnonzero(first), len(data))
    some = kind[bounds[:-1]] > 0
    starts, ends = bounds[:-1][some], bounds[1:][some]
    own = kind[starts]
    code = mix(run_hashes(data, starts, ends) ^ own.astype(np.uint64), SEED)
    return (code >> np.uint64(64 - 13)).astype(np.int64), own, np.searchsorted(starts, rows)


def context_sums(rows: np.ndarray, at: np.ndarray, index: np.ndarray) -> np.ndarray:
    """For each table row, the sum of the index vectors around its words."""
    out = np.zeros((ROWS, WIDTH), np.float64)
    if not len(rows):
        return out
    document = np.repeat(np.arange(len(at) - 1), np.diff(at))
    around = np.zeros((len(rows), WIDTH), np.float32)
    for d in range(1, NEIGHBOURS + 1):
        same = (document[d:] == document[:-d])[:, None]
        around[d:] += index[rows[:-d]] * same
        around[:-d] += index[rows[d:]] * same
    for k in range(WIDTH):
        out[:, k] = np.bincount(rows, around[:, k], ROWS)
    return out


def pooled(texts: Texts, vectors: np.ndarray) -> np.ndarray:
    """One row of features for each text."""
    rows, kinds, at = word_rows(texts)
    n = np.diff(at)
    per = np.maximum(n, 1)[:, None]
    document = np.repeat(np.arange(len(n)), n)
    mean = sums(vectors[rows].astype(np.float32), at) / per
    again = np.zeros(len(rows))
    for d in (1, 2):
        if len(rows) > d:
            again[d:] = np.maximum(again[d:], (rows[d:] == rows[:-d]) & (document[d:] == document[:-d]))
    share = np.stack([sums((kinds == k).astype(np.float64), at) for k in range(1, KINDS)], axis=1) / per
    pairs = np.unique(document.astype(np.int64) * ROWS + rows)
    distinct = np.bincount(pairs // ROWS, minlength=len(n)) if len(pairs) else np.zeros(len(n))
    rest = np.stack([sums(again, at) / per[:, 0], distinct / np.sqrt(per[:, 0]) / 10, np.log1p(n) / 10], axis=1)
    return np.concatenate([mean, share, rest], axis=1).astype(np.float64)


@dataclass(frozen=True)
class Model:
    """Word vectors and network; ``share`` alone if there was nothing to fit."""

    share: float
    vectors: np.ndarray | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.vectors is None:
            return np.full(len(x), self.share)
        z = logits((x - self.centre) / self.scale, self.layers) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logits(x: np.ndarray, layers: tuple[np.ndarray, ...]) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.tanh(x @ w1 + b1) @ w2 + b2[0]


def fit_network(x: np.ndarray, y: np.ndarray, decay: float = 1e-3) -> tuple[np.ndarray, ...]:
    """Two layers by Adam on all rows, each of which weighs the same, so that
    scores follow the classes' shares."""
    rng = np.random.default_rng(SEED)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first = [np.zeros_like(p) for p in layers]
    second = [np.zeros_like(p) for p in layers]
    for t in range(1, STEPS + 1):
        w1, b1, w2, b2 = layers
        h = np.tanh(x @ w1 + b1)
        p = 1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -40, 40)))
        g = (p - y) / len(y)
        back = np.outer(g, w2) * (1 - h * h)
        slopes = [x.T @ back + decay * w1, back.sum(0), h.T @ g + decay * w2, np.array([g.sum()])]
        for i, s in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * s
            second[i] = 0.999 * second[i] + 0.001 * s * s
            layers[i] = layers[i] - 0.02 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return tuple(layers)


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, from a fixed grid."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, np.where(y > 0, -z, z) / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(df: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str, label_col: str, sample: int, seed: int) -> Model:
    """Fit on about ``sample`` labelled rows where ``usable`` (of the labels)."""
    spark = df.sparkSession
    known = labels.where(usable & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.min(label_col) > 0).cast("int").alias("_y"))
    total = known.count()
    if not total:
        return Model(0.5)
    picked = sampled(known, "_id", sample / total, seed)
    texts = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(picked), F.col("_doc") == F.col("_id")).select("_id", "_y", "text")
    shared_index = spark.sparkContext.broadcast(index_vectors())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros((ROWS, WIDTH)), False
        for batch in batches:
            for low, high in blocks(batch.column(0)):
                found, _, at = word_rows(Texts(batch.column(0).slice(low, high - low)))
                total += context_sums(found, at, shared_index.value)
                any_rows = True
        used = np.flatnonzero(np.abs(total).sum(1))
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(total[used]), pa.list_(pa.float64()))], ["spot", "v"])

    added = rows.select("text").mapInArrow(add, "spot bigint, v array<double>").groupBy("spot").agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(WIDTH)]).toArrow()
    vectors = np.zeros((ROWS, WIDTH))
    vectors[added["spot"].to_numpy()] = np.stack([added[f"v{k}"].to_numpy() for k in range(WIDTH)], axis=1)
    vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    shared = spark.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in blocks(batch.column(2)):
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(pooled(Texts(part.column(2)), shared.value)), pa.list_(pa.float64()))], ["_id", "_y", "x"])

    got = rows.mapInArrow(pool, f"_id {dict(rows.dtypes)['_id']}, _y int, x array<double>").toArrow()
    y = got["_y"].to_numpy().astype(np.float64)
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 20 or not 0 < y.sum() < len(y):
        return Model(share)
    x = np.array(got["x"].to_pylist())
    order = np.lexsort((x[:, 0], got["_id"].to_numpy(zero_copy_only=False)))  # the same model whatever the rows' order
    x, y = x[order], y[order]
    centre, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - centre) / scale
    held = np.arange(len(x)) % 10 == 0
    if not 0 < y[~held].sum() < (~held).sum():
        held[:] = False
    layers = fit_network(x[~held], y[~held])
    temperature = fit_temperature(logits(x[held], layers), y[held]) if held.any() else 1.0
    return Model(share, vectors, centre, scale, layers, temperature)


def score_quality(df: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(id, score, predicted) of every row: likelihood of label 1."""
    spark = df.sparkSession
    bounded_batches(spark)
    model = train(df, labels, F.lit(True) if usable is None else usable, id_col, text_col, label_col, sample, seed)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for low, high in blocks(batch.column(1)):
                part = batch.slice(low, high - low)
                x = pooled(Texts(part.column(1)), own.vectors) if own.vectors is not None else np.zeros((len(part), 1))
                score = own.score(x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    picked = df.select(id_col, df[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, f"`{id_col}` {dict(picked.dtypes)[id_col]}, score double, predicted int")


def score_held_out(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", folds: int = 3, fold: int = 1, **options) -> DataFrame:
    """``score_quality`` with column held_out: rows of one crc32 fold of the
    id, whose labels aren't learnt from."""
    found = score_quality(df, labels, id_crc_mod(id_col, folds) != fold, id_col=id_col, **options)
    return found.select(id_col, F.coalesce(id_crc_mod(id_col, folds) == fold, F.lit(False)).alias("held_out"), "score", "predicted")
