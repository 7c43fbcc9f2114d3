"""Every stage of the pipeline on odd, empty, tiny and clashing tables."""

import pytest
from pyspark.sql import functions as F

from cloakframe.llm import common

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = "A plain sentence of more than ten words that nobody would ever want to reject, surely not here number {}."
NAMES = ["id", "_id", "_row", "_text", "_draw", "_digest", "_node", "key", "block", "n", "kept", "component_id", "label", "quality", "stratum", "t", "w", "h", "v", "score", "lang_pred", "text_", "grp", "ids", "length", "start"]


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return corpus_pipeline.STAGES


def through(spark, stages, now, sf):
    counts = []
    for name, stage in stages:
        before, now = now, common.materialize(spark, stage(spark, now, sf), name)
        if name != "packing":
            assert now.columns == before.columns
        counts.append(now.count())
    return now, counts


def test_empty(spark, stages, sf):
    _, counts = through(spark, stages, spark.createDataFrame([], DOCS), sf)
    assert counts == [0] * 5


@pytest.mark.parametrize("text,left", [("hello world", [1, 0, 0, 0, 0]), ("one", [1, 0, 0, 0, 0]), (GOOD.format(1), [1, 1, 1, 1, 1])])
def test_one_row(spark, stages, sf, text, left):
    assert through(spark, stages, spark.createDataFrame([(2**60 + 1, text, "en", "s", len(text))], DOCS), sf)[1] == left


def test_each_stage_alone_on_short_texts(spark, stages, sf):
    rows = [(i, " ".join(["w"] * i), "en", "s", i) for i in range(1, 5)] + [(9, None, "en", None, None), (10, "", None, "s", 0)]
    for name, stage in stages:
        got = stage(spark, spark.createDataFrame(rows, DOCS), sf)
        assert got.count() <= len(rows) or name == "packing"


def test_odd_rows_and_clashing_columns(spark, stages, sf):
    big = 2**60
    rows = [(big + i, GOOD.format(i) + f" And some more of it {i}.", "en", "s", 1) for i in range(3)]
    rows += [(None, GOOD.format("null id"), "en", "s", 1), (None, None, "en", "s", 1), (big + 1, rows[1][1], "en", "s", 1), (5, "", "en", "s", 0), (6, "word " * 60_000, "en", "s", 1)]
    rows += [(7, GOOD.format(7) + " token = abcdef123456 ok", None, "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit(f"own {n}") for n in NAMES})
    now, counts = through(spark, stages[:-1], df, sf)
    got = now.collect()
    assert {r.doc_id for r in got} <= {big, big + 1, big + 2, None, 7} and all(r[n] == f"own {n}" for r in got for n in NAMES)
    assert sum(r.doc_id == big + 1 for r in got) <= 1 and all(r.n_chars == len(r.text) for r in got)
    assert "abcdef123456" not in " ".join(r.text for r in got)
    packed = stages[-1][1](spark, now, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in got}
