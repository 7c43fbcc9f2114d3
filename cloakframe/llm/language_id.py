"""Language identification by hierarchical discrimination (operator 9).

Texts become frequencies of hashed byte trigrams of their letters. One-versus-
one linear support vector machines tell language families apart first, and
others separate the languages of each family. The machines are fitted on the
driver with a bounded sample of documents per language (``sample``); prediction
is one narrow Arrow pass over whole texts.

Defined results: null text, or text without a letter, is ``und`` with score 0.
With one known language all other texts get it; with none all are ``und``. A
null id is never held out nor learnt from. Repeated rows get the same result;
an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Texts, blocks, bounded_batches, id_crc_mod, sums

#: Documents of each language that the machines are fitted on, about; documents
#: in all (with many languages each gets fewer), and languages learnt, the most
#: frequent ones.
SAMPLE, SAMPLE_TOTAL, MOST_LANGUAGES = 400, 12_000, 128
BINS = 1 << 13
UNKNOWN = "und"
#: Scores below which a prediction that differs from the given language is no
#: prediction, and from which it is taken against it, on so many bytes.
UNSURE, SURE, LETTERS = 0.35, 0.5, 200

#: Families of languages by code (fixed values); another code is its own family.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "semitic": ["ar", "he"],
    "uralic": ["fi", "et", "hu"],
}

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def family_of(language: str) -> str:
    return next((f for f, codes in FAMILIES.items() if language in codes), language)


def trigrams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all trigrams of letters (other bytes are a gap), and offsets."""
    letters = _LETTER[texts.data]
    n = len(letters)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    code = letters[:-2].astype(np.uint32) << 16 | letters[1:-1].astype(np.uint32) << 8 | letters[2:]
    inside = (letters[1:-1] != 32) | ((letters[:-2] != 32) & (letters[2:] != 32))
    for edge in texts.offsets[1:-1]:  # no trigram reaches over two rows
        inside[max(0, edge - 2) : edge] = False
    kept = np.flatnonzero(inside)
    bins = (code[kept] * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
    return bins.astype(np.int64), np.searchsorted(kept, texts.offsets)


@dataclass(frozen=True)
class Model:
    """Linear machines: columns of ``weights`` and ``bias``, by the pair that
    each separates; the positive side is the pair's first."""

    weights: np.ndarray
    bias: np.ndarray
    pairs: list[tuple[str, str]]
    members: dict[str, list[str]]

    def vote(self, margins: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner among ``names`` for each row, and its certainty."""
        votes = np.zeros((len(margins), len(names)))
        sure = np.full((len(margins), len(names)), np.inf)
        for i, j in combinations(range(len(names)), 2):
            m = margins[:, self.pairs.index((names[i], names[j]))]
            for k, s in ((i, m), (j, -m)):
                votes[:, k] += (s > 0) + 1e-3 * np.tanh(s)
                sure[:, k] = np.minimum(sure[:, k], s)
        best = votes.argmax(axis=1) if len(names) > 1 else np.zeros(len(margins), np.int64)
        least = np.clip(sure[np.arange(len(margins)), best], -30, 30)
        return best, 1 / (1 + np.exp(-2 * least))

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        families = list(self.members)
        top, score = self.vote(margins, families)
        out = np.empty(len(margins), object)
        for k, f in enumerate(families):
            rows = np.flatnonzero(top == k)
            best, sure = self.vote(margins[rows], self.members[f])
            out[rows] = np.array(self.members[f], object)[best]
            score[rows] *= sure
        return out, score


def fit_machine(x: np.ndarray, y: np.ndarray, strength: float = 1.0, steps: int = 120) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge, L2) by accelerated
    gradient steps; the classes weigh the same."""
    used = np.flatnonzero(x.any(axis=0))
    out = np.zeros(x.shape[1])
    x = np.ascontiguousarray(x[:, used], np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    y = y.astype(np.float32)
    probe = np.ones(x.shape[1] + 1, np.float32)
    for _ in range(20):  # largest curvature
        probe /= np.linalg.norm(probe)
        z = weight * (x @ probe[:-1] + probe[-1])
        probe = np.append(x.T @ z, z.sum())
    rate = 1 / (2 * np.linalg.norm(probe) * 1.05 + strength * 1e-3)
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    for t in range(steps):
        gap = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * weight * y
        slope = -2 * np.append(x.T @ gap, gap.sum()) + np.float32(strength * 1e-3) * np.append(v[:-1], np.float32(0))
        new = v - np.float32(rate) * slope
        v = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    out[used] = w[:-1]
    return out, float(w[-1])


def fit(languages: list[str], x: np.ndarray) -> Model:
    """Machines for families, and for the languages of each, from trigram
    frequencies ``x`` (rows of sums 1)."""
    known = sorted(set(languages))
    members: dict[str, list[str]] = {}
    for one in known:
        members.setdefault(family_of(one), []).append(one)
    own = np.array(languages)
    kin = np.array([family_of(v) for v in languages])
    scale = 30.0
    pairs, weights, bias = [], [], []
    for labels, names in [(kin, list(members)), *((own, m) for m in members.values())]:
        for a, b in combinations(names, 2):
            rows = (labels == a) | (labels == b)
            w, c = fit_machine(x[rows] * scale, np.where(labels[rows] == a, 1.0, -1.0))
            pairs.append((a, b))
            weights.append(w * scale)
            bias.append(c)
    return Model(np.array(weights).reshape(len(pairs), x.shape[1]), np.array(bias), pairs, members)


def frequencies(df: DataFrame, text: str, label: str) -> tuple[list[str], np.ndarray]:
    """Labels and trigram frequencies of (few) rows, made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, at = trigrams(Texts(batch.column(1)))
            rows = []
            for low, high in zip(at[:-1], at[1:], strict=True):
                spots, counts = np.unique(bins[low:high], return_counts=True)
                rows.append((spots.astype(np.int32).tobytes(), (counts / max(1, high - low)).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)]], ["label", "spots", "shares"])

    got = df.select(F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text")).mapInArrow(run, "label string, spots binary, shares binary").toArrow()
    x = np.zeros((got.num_rows, BINS), np.float32)
    for i, (spots, shares) in enumerate(zip(got["spots"].to_pylist(), got["shares"].to_pylist(), strict=True)):
        x[i, np.frombuffer(spots, np.int32)] = np.frombuffer(shares, np.float32)
    return got["label"].to_pylist(), x


def train(df: DataFrame, usable: Column, id_col: str, text_col: str, lang_col: str, sample: int, seed: int) -> Model | None:
    """A model from about ``sample`` usable documents per language, chosen by
    seeded hashes of their ids; None where there are none."""
    rows = df.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counted = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    sizes = {r[0]: r[1] for r in counted.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not sizes:
        return None
    sample = max(20, min(sample, SAMPLE_TOTAL // len(sizes)))
    share = F.lit(0.0)
    for one, n in sorted(sizes.items()):
        share = F.when(F.col(lang_col).cast("string") == one, F.lit(min(1.0, sample / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), F.lit(2**32)) / F.lit(float(2**32))
    labels, x = frequencies(rows.where(draw <= share), text_col, lang_col)
    order = np.lexsort((x @ np.arange(BINS), labels)) if labels else []  # the same model whatever the rows' order
    return fit([labels[i] for i in order], x[order]) if labels else None


class _Predictor:
    """Predictions for batches of texts; sent to the workers by broadcast."""

    def __init__(self, model: Model | None):
        self.model = model

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        names, score = np.full(len(column), UNKNOWN, object), np.zeros(len(column))
        if self.model is None:
            return names, score
        for low, high in blocks(column):
            part = column.slice(low, high - low)
            lettered = np.flatnonzero([t is not None and any(map(str.isalpha, t)) for t in part.to_pylist()])
            bins, at = trigrams(Texts(part))
            per = np.maximum(np.diff(at), 1)
            margins = np.zeros((len(part), len(self.model.pairs)))
            for k, (w, c) in enumerate(zip(self.model.weights, self.model.bias, strict=True)):
                margins[:, k] = sums(w[bins], at) / per + c
            got, sure = self.model.predict(margins)
            names[low + lettered], score[low + lettered] = got[lettered], sure[lettered]
        return names, score


def identify(df: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, seed: int = 9) -> DataFrame:
    """(id, lang_pred, score) of every row; learnt from rows where ``usable``."""
    spark = df.sparkSession
    bounded_batches(spark)
    model = train(df, F.lit(True) if usable is None else usable, id_col, text_col, lang_col, sample, seed)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _Predictor(shared.value)
        for batch in batches:
            names, score = predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], [id_col, "lang_pred", "score"])

    picked = df.select(id_col, df[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, f"`{id_col}` {dict(picked.dtypes)[id_col]}, lang_pred string, score double")


def identify_held_out(df: DataFrame, id_col: str = "doc_id", folds: int = 4, fold: int = 2, **options) -> DataFrame:
    """``identify`` with column held_out: rows of one crc32 fold of the id,
    from which nothing is learnt."""
    found = identify(df, id_crc_mod(id_col, folds) != fold, id_col=id_col, **options)
    return found.select(id_col, F.coalesce(id_crc_mod(id_col, folds) == fold, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, seed: int = 9, unsure: float = UNSURE, sure: float = SURE, letters: int = LETTERS) -> DataFrame:
    """``df`` without the rows whose language can't be told: ``und``, or a
    prediction of less than ``unsure`` that differs from ``lang_col`` (a string).
    ``lang_col`` becomes the predicted language where it is null, and where a
    prediction of at least ``sure`` contradicts it on ``letters`` or more bytes."""
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(train(df, F.lit(True), id_col, text_col, lang_col, sample, seed))
    text_at, lang_at = df.columns.index(text_col), df.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _Predictor(shared.value)
        for batch in batches:
            names, score = predict(batch.column(text_at))
            lang = batch.column(lang_at)
            own = np.array(lang.to_pylist(), object)
            long = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_at)), 0)) >= letters
            other = own != names
            taken = np.array([v is None for v in own], bool) | (other & (score >= sure) & long)
            filled = pa.array(np.where(taken, names, own), lang.type)
            kept = (names != UNKNOWN) & ~(other & (score < unsure))
            yield batch.set_column(lang_at, batch.schema.field(lang_at).with_nullable(True), filled).filter(pa.array(kept))

    return df.mapInArrow(run, df.schema)
