"""Views of texts: the way back to their offsets, and what it costs."""

import random
import tracemalloc
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from cloakframe.functions import normalize as N
from cloakframe.plans.anonymizer import AnonymizerConfig, with_spans

JA = N.LANGUAGE_FOLDS["ja"]
PIECES = ["a", "e", "́", "̣", "ｶ", "ﾞ", "ﾟ", "ﾊ", "ｱ", "｡", " ", "Å", "豈", "ᄀ", "ᅡ", "\U0001d15e", "😀", "日", "か", "゙"]


def by_character(text):
    """View and the original's offset of each of its offsets, one by one."""
    chars, i = [], 0
    while i < len(text):
        j = i + 1
        while j < len(text) and unicodedata.combining(text[j]):
            j += 1
        chars += [(c, i) for c in unicodedata.normalize("NFC", text[i:j])]
        i = j
    table, out, i = N.halfwidth_table(), [], 0
    while i < len(chars):
        pair = "".join(c for c, _ in chars[i : i + 2])
        size = 2 if len(pair) == 2 and pair in table else 1
        out.append((table.get(pair[:size], pair[0]), chars[i][1]))
        i += size
    return "".join(c for c, _ in out), [*(at for _, at in out), len(text)]


def test_runs_equal_offsets_one_by_one():
    rnd = random.Random(4)
    for _ in range(20000):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 12)))
        view, runs = N.detect_view(text, JA)
        own, at = by_character(text)
        assert view == own and (runs is None) == (own == text)
        if runs is not None:
            last = [max(k for k, v in enumerate(runs[0]) if v <= i) for i in range(len(view) + 1)]
            assert [runs[1][k] + i - runs[0][k] for i, k in enumerate(last)] == at


def test_a_view_costs_its_changes_not_its_characters():
    text = "café ｶﾞ " + "lorem ipsum " * 80000
    tracemalloc.start()
    view, runs = N.detect_view(text, JA)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(view) == len(text) - 2 and len(runs[0]) < 5
    assert peak < 12 * len(text)


def test_views_leave_in_small_batches():
    texts = ["ｶﾞ" + "x" * 50000] * 60 + [None, ""]
    got = list(N._views.func(iter([(pa.array(texts), pa.array(["ja"] * len(texts)))])))
    assert [v for b in got for v in b.field("text").to_pylist()] == ["ガ" + "x" * 50000] * 60 + [None, ""]
    assert len(got) > 5 and all(b.nbytes < 2 * N.BATCH_CHARS for b in got)


def test_spans_between_many_changes(spark):
    rnd = random.Random(6)
    texts, expected = [], []
    for i in range(30):
        text, bounds = "", []
        for k in range(rnd.choice([0, 1, 40, 300])):
            text += "".join(rnd.choice(["é", "ｶﾞ", "ｱ", "日", " ", "が", "word"]) for _ in range(rnd.randint(0, 9))) + " "
            bounds.append((len(text), len(text) + len(f"u{k}@x.com")))
            text += f"u{k}@x.com "
        texts.append((i, text))
        expected.append((i, bounds))
    rows = spark.createDataFrame([*texts, (99, None)], "id int, text string")
    found = with_spans(rows, "text", AnonymizerConfig(language="ja", entities=("EMAIL_ADDRESS",)))
    got = found.select("id", F.transform("_spans", lambda s: F.struct(s["start"], s["end"])).alias("b")).collect()
    assert sorted((r.id, [tuple(b) for b in r.b]) for r in got) == [*expected, (99, [])]
