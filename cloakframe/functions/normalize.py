"""The detection view of a text, with the way back to its offsets.

NFC is applied to each base character with its combining marks; Japanese also
folds half-width katakana. The way back is a list of runs, in which offsets of
the view and of the original go up together: run k begins at ``view_at[k]``,
which is ``orig_at[k]`` in the original. Its size is that of the changes, not of
the text; both are null where the view equals the text.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VIEW = T.StructType([T.StructField("text", T.StringType()), T.StructField("view_at", T.ArrayType(T.IntegerType())), T.StructField("orig_at", T.ArrayType(T.IntegerType()))])
#: view_at and orig_at.
Runs = tuple[list[int], list[int]]
#: (start, end, new): what stands for a part of a text.
Edit = tuple[int, int, str]
#: NFC changes nothing in texts of characters below U+0300.
MAY_CHANGE = "[^\u0000-˿]"
HALFWIDTH = "[｡-ﾟ]"
_HALFWIDTH = re.compile(HALFWIDTH)
#: Where a chunk may be that isn't a character by itself; beyond U+FFFF this says too much.
_MARKED = re.compile("[" + "".join(c for c in map(chr, range(0x300, 0x10000)) if unicodedata.combining(c) or unicodedata.normalize("NFC", c) != c) + "\U00010000-\U0010ffff]")
#: Voiced and half-voiced marks, and how they stand alone.
VOICED, SEMI_VOICED = "ﾞ", "ﾟ"
_FOLDED = re.compile(f"{HALFWIDTH}[{VOICED}{SEMI_VOICED}]?")
ALONE = {VOICED: "゛", SEMI_VOICED: "゜"}


@functools.cache
def halfwidth_table() -> dict[str, str]:
    """Half-width string -> full-width character, from Unicode's own mappings.

    Voiced forms exist for ka to ho and u only.
    """
    table = {}
    for code in range(0xFF61, 0xFF9E):
        one = chr(code)
        full = table[one] = unicodedata.normalize("NFKC", one)
        for mark, combining in ((VOICED, "゙"), (SEMI_VOICED, "゚")):
            joint = unicodedata.normalize("NFC", full + combining)
            if len(joint) == 1 and full not in "ワヲ":
                table[one + mark] = joint
    return table | ALONE


def composed(text: str) -> Iterator[Edit]:
    """NFC by chunks of a base and its marks: those of several characters or that change."""
    i = 0
    while (m := _MARKED.search(text, i)) is not None:
        low, i = m.start(), m.end()
        if unicodedata.combining(text[low]):
            low = max(low - 1, 0)
        while i < len(text) and unicodedata.combining(text[i]):
            i += 1
        piece = unicodedata.normalize("NFC", text[low:i])
        if i - low > 1 or piece != text[low:i]:
            yield low, i, piece


def folded(text: str) -> Iterator[Edit]:
    """Half-width katakana and punctuation as full-width characters."""
    table = halfwidth_table()
    for m in _FOLDED.finditer(text):
        i, j = m.span()
        if m[0] in table:
            yield i, j, table[m[0]]
        else:
            yield i, i + 1, table[text[i]]
            yield i + 1, j, table[text[i + 1]]


def edited(text: str, edits: Iterator[Edit]) -> tuple[str, Runs]:
    """A text with edits (in order, disjoint) and the runs that lead back."""
    out, views, origs, done, size = [], [0], [0], 0, 0
    for i, j, new in edits:
        out += (text[done:i], new)
        size += i - done
        # offsets inside of what an edit made lead to its start
        for k in range(1, len(new)):
            views.append(size + k)
            origs.append(i)
        size, done = size + len(new), j
        if len(new) != 1 or j - i != 1:
            views.append(size)
            origs.append(j)
    return "".join((*out, text[done:])), (views, origs)


def followed(first: Runs, second: Runs) -> Runs:
    """Runs from the second's view to the first's original."""
    (mids, origs), (views, lows) = first, second
    out: Runs = ([], [])
    for k, (v, low) in enumerate(zip(views, lows, strict=True)):
        r = bisect_right(mids, low) - 1
        out[0].append(v)
        out[1].append(origs[r] + low - mids[r])
        r += 1
        while r < len(mids) and (k + 1 == len(views) or v + mids[r] - low < views[k + 1]):
            out[0].append(v + mids[r] - low)
            out[1].append(origs[r])
            r += 1
    return out


FOLDS = {"halfwidth_katakana": folded}
#: Fixed value: folds of each language.
LANGUAGE_FOLDS = {"ja": ("halfwidth_katakana",)}


def detect_view(text: str, folds: tuple[str, ...] = ()) -> tuple[str, Runs | None]:
    """View and runs (None: the text itself). Unknown folds raise KeyError."""
    own = [FOLDS[name] for name in folds]
    if unicodedata.is_normalized("NFC", text) and not (own and _HALFWIDTH.search(text)):
        return text, None
    view, runs = edited(text, composed(text))
    for fold in own:
        view, more = edited(view, fold(view))
        runs = followed(runs, more)
    return (text, None) if view == text else (view, runs)


#: Characters of views that one Arrow batch of results holds, one text at least.
BATCH_CHARS = 1 << 18


@F.arrow_udf(VIEW)
def _views(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    types = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))

    def made(rows: list[tuple]) -> pa.Array:
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], VIEW.names)

    for texts, languages in batches:
        rows: list[tuple] = []
        size = 0
        for i in range(len(texts)):
            text = texts[i].as_py()
            view, runs = (None, None) if text is None else detect_view(text, LANGUAGE_FOLDS.get(languages[i].as_py(), ()))
            rows.append((view, *(runs or (None, None))))
            size += len(view or "")
            if size >= BATCH_CHARS:
                yield made(rows)
                rows, size = [], 0
        if rows or not len(texts):
            yield made(rows)


#: So that the optimizer neither repeats the Arrow step nor moves it into an explode.
_views = _views.asNondeterministic()


def needs_view(text: Column, language: Column) -> Column:
    """Whether a row's view may differ from its text; only such rows go to Arrow."""
    return text.rlike(MAY_CHANGE)


def view_of(text: Column, language: Column) -> Column:
    """struct(text, view_at, orig_at); of a null text (one that doesn't need a view) nulls."""
    return _views(text, language)


def to_original(spans: Column, view: Column) -> Column:
    """Spans of the view as spans of the text."""
    views, origs = view["view_at"], view["orig_at"]
    halvings = F.sequence(F.lit(1), F.length(F.bin(F.size(views))))
    start = F.struct(F.lit(0).alias("low"), F.size(views).alias("high"))

    def original(offset: Column) -> Column:
        """By binary search for the last run that begins at or before the offset."""

        def halved(a: Column, _: Column) -> Column:
            middle = F.shiftright(a["low"] + a["high"], 1)
            left = F.get(views, middle) > offset
            return F.struct(F.when(left, a["low"]).otherwise(middle).alias("low"), F.when(left, middle).otherwise(a["high"]).alias("high"))

        return F.aggregate(halvings, start, halved, lambda a: F.get(origs, a["low"]) + offset - F.get(views, a["low"]))

    def back(s: Column) -> Column:
        return F.struct(original(s["start"]).alias("start"), original(s["end"]).alias("end"), s["entity_type"].alias("entity_type"), s["score"].alias("score"))

    return F.when(views.isNull(), spans).otherwise(F.transform(spans, back))
