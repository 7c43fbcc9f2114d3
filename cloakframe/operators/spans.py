"""Span algebra: overlap resolution and propagation of detected values."""

from __future__ import annotations

import re
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .detect import SPANS, overlaps, value_of

#: Characters trimmed from the edges of what overlaps leave.
EDGE = " \t\n\r　"


def _ranked(spans: Column) -> Column:
    """By score and length descending, then start, then input order."""
    keyed = F.transform(spans, lambda s, i: F.struct((-s["score"]).alias("a"), (s["start"] - s["end"]).alias("b"), s["start"].alias("c"), i.alias("d"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def _rest(s: Column, kept: Column, text: Column | None) -> Column:
    """What kept spans (disjoint) leave of a span: it whole if they leave it alone."""
    hits = F.array_sort(F.filter(kept, lambda k: overlaps(k, s)))
    lows = F.concat(F.array(s["start"]), F.transform(hits, lambda k: k["end"]))
    highs = F.concat(F.transform(hits, lambda k: k["start"]), F.array(s["end"]))
    cuts = F.zip_with(lows, highs, lambda a, b: F.struct(a.alias("start"), b.alias("end"), s["entity_type"].alias("entity_type"), s["score"].alias("score")))
    cuts = F.filter(cuts, lambda c: c["start"] < c["end"])
    if text is not None:

        def trim(c: Column) -> Column:
            own = value_of(text, c)
            low = c["start"] + F.length(own) - F.length(F.ltrim(own, F.lit(EDGE)))
            high = c["end"] - F.length(own) + F.length(F.rtrim(own, F.lit(EDGE)))
            return F.struct(low.alias("start"), high.alias("end"), c["entity_type"].alias("entity_type"), c["score"].alias("score"))

        cuts = F.filter(F.transform(cuts, trim), lambda c: c["start"] < c["end"])
    return F.when(F.size(hits) == 0, F.array(s)).otherwise(cuts)


def merge(spans: Column, text: Column | None = None) -> Column:
    """Disjoint spans by start: better spans keep their place, and what they
    leave uncovered of the others stays masked as well. With ``text``, white
    space at the edges of such rests is dropped."""
    folded = F.aggregate(_ranked(spans), F.array().cast(SPANS), lambda kept, s: F.concat(kept, _rest(s, kept, text)))
    return F.when(F.size(spans) <= 1, spans).otherwise(F.array_sort(folded))


_PROPAGATED = ("PERSON", "LOCATION")
_LATIN = re.compile("[0-9A-Za-zÀ-ɏḀ-ỿ]")


def repeats(text: str, spans: list[dict]) -> list[dict]:
    """Uncovered exact repeats of PERSON and LOCATION values, as more spans.

    A repeat doesn't count inside a longer Latin word.
    """
    taken = [(s["start"], s["end"]) for s in spans]
    best: dict[tuple[str, str], float] = {}
    for s in sorted(spans, key=lambda s: s["start"]):
        value = text[s["start"] : s["end"]]
        if s["entity_type"] in _PROPAGATED and len(value.strip()) >= 2:
            best[s["entity_type"], value] = max(s["score"], best.get((s["entity_type"], value), 0.0))
    made = []
    for (kind, value), score in best.items():
        glued = (_LATIN.match(value[0]) is not None, _LATIN.match(value[-1]) is not None)
        for m in re.finditer(re.escape(value), text):
            low, high = m.span()
            beside = (text[low - 1 : low], text[high : high + 1])
            inside_word = any(g and b and _LATIN.match(b) for g, b in zip(glued, beside, strict=True))
            if not inside_word and not any(low < e and s < high for s, e in taken):
                made.append({"start": low, "end": high, "entity_type": kind, "score": score})
                taken.append((low, high))
    return made


@F.pandas_udf(SPANS)
def _with_repeats(texts: pd.Series, spans: pd.Series) -> pd.Series:
    rows = [[dict(s) if isinstance(s, dict) else s.asDict() for s in own] for own in spans]
    return pd.Series([own + repeats(t, own) for t, own in zip(texts, rows, strict=True)])


#: So that the optimizer neither repeats the Arrow step nor moves it into an explode.
_with_repeats = _with_repeats.asNondeterministic()


def propagate(text: Column, spans: Column) -> Column:
    """Spans with the repeats of the names and places among them (Arrow)."""
    return _with_repeats(text, spans)
