import io
import json

import pytest
from pyspark.sql import functions as F

import cloakframe
from cloakframe.cli import main
from cloakframe.functions import validators as V
from cloakframe.operators import detect as D
from cloakframe.operators import events, ner, restore
from cloakframe.operators.detect import SPANS, match_bounds, span
from cloakframe.plans.anonymizer import AnonymizerConfig, anonymize, anonymize_parts, patched, preview_then_upgrade


def test_exports():
    assert all(getattr(cloakframe, n) is not None for n in cloakframe.__all__) and "anonymize" in cloakframe.__all__
    with pytest.raises(AttributeError):
        cloakframe.nothing


def test_commands(spark, tmp_path, capsys, monkeypatch):
    mapping = str(tmp_path / "m.json")
    assert main(["anonymize", "-t", "mail a@b.com", "--mapping-file", mapping], spark) == 0
    assert capsys.readouterr().out == "mail <Email_1>\n" and json.load(open(mapping)) == {"<Email_1>": "a@b.com"}
    assert main(["deanonymize", "-t", "to <Email_1>", "--mapping-file", mapping], spark) == 0 and capsys.readouterr().out == "to a@b.com\n"
    assert main(["anonymize", "-t", "a@b.com 090-1234-5678", "--json", "--entities", "EMAIL_ADDRESS"], spark) == 0
    assert json.loads(capsys.readouterr().out)["text"] == "<Email_1> 090-1234-5678"
    (tmp_path / "one.txt").write_text("x\nmail a@b.com")
    (tmp_path / "two.txt").write_text("nothing")
    (tmp_path / "dir").mkdir()
    assert main(["scan", str(tmp_path / "one.txt"), str(tmp_path / "two.txt"), str(tmp_path / "dir")], spark) == 1
    out = capsys.readouterr()
    assert out.out.endswith("one.txt:2:6: EMAIL_ADDRESS (score 0.90)\n") and "a@b.com" not in out.out and "1 of 2 input" in out.err
    assert main(["scan", str(tmp_path / "two.txt")], spark) == 0 and main(["scan", "-t", "a@b.com", "--allow", "a@b.com"], spark) == 0
    assert main(["scan", "-t", "secret", "--deny", "secret", "--json"], spark) == 1
    (tmp_path / "bad").write_bytes(b"\xff\xfe")
    assert main(["scan", str(tmp_path / "bad")], spark) == 2 and main(["scan", "-t", "x", str(tmp_path / "two.txt")], spark) == 2
    assert main(["anonymize", "-l", "xx", "-t", "a"], spark) == 2 and main(["version"]) == 0 and main(["deanonymize", "-t", "a"], spark) == 2
    monkeypatch.setattr("sys.stdin", io.StringIO("from a@b.com"))
    capsys.readouterr()
    assert main(["anonymize"], spark) == 0 and capsys.readouterr().out == "from <Email_1>\n"
    monkeypatch.setattr("builtins.input", lambda prompt: "n")
    assert main(["anonymize", "-i", "-t", "a"], spark) == 2


def test_patches():
    one = patched(AnonymizerConfig(), {"language": "fr", "deny_list": ["x"], "normalize": False, "threshold": 0.6})
    assert (one.language, one.deny_list, one.normalize, one.threshold) == ("fr", ("x",), False, 0.6)
    for wrong in ({"language": 3}, {"language": "xx"}, {"deny_list": "x"}, {"deny_list": [1]}, {"normalize": "yes"}, {"threshold": True}, {"nothing": 1}, {"detector": None}, {"threshold": "a"}, []):
        with pytest.raises(ValueError):
            patched(AnonymizerConfig(), wrong)


def person(text, language):
    return F.transform(match_bounds(text, "John Smith"), lambda b: span(b["start"], b["end"], F.lit("PERSON"), F.lit(0.9)))


def test_preview_then_upgrade(spark):
    rows, seen = spark.createDataFrame([("John Smith, a@b.com",)], "text string"), []
    write = lambda df, stage: seen.append((stage, df.first().masked_text))
    assert preview_then_upgrade(rows, "text", AnonymizerConfig(language="en", detector=person), write) == "final"
    broken = lambda text, language: F.raise_error(F.lit("no model")).cast(SPANS)
    assert preview_then_upgrade(rows, "text", AnonymizerConfig(language="en", detector=broken), write) == "preview"
    assert seen == [("preview", "John Smith, <Email_1>"), ("final", "<Name_1>, <Email_1>"), ("preview", "John Smith, <Email_1>")]


def test_model_spans(spark):
    """With and without dropping the model's spans that overlap structured ones."""
    over = lambda text, language: F.array(span(F.lit(0), F.length(text), F.lit("LOCATION"), F.lit(0.95)))
    rows = spark.createDataFrame([("at a@b.com now",)], "text string")
    assert anonymize(rows, config=AnonymizerConfig(language="en", detector=over)).first().masked_text == "<Location_1>"
    assert anonymize(rows, config=AnonymizerConfig(language="en", detector=over, drop_model_overlaps=True)).first().masked_text == "at <Email_1> now"
    groups = [("John  Smith in Paris", [(["John", "Smith"], "PERSON", 0.9), (["Par", "##is"], "LOCATION", 0.8), (["no"], "PERSON", 0.1)])]
    got = spark.createDataFrame(groups, "text string, g array<struct<words:array<string>,entity_type:string,score:double>>").select(ner.aligned_spans("text", "g").alias("s")).first().s
    assert [(s.start, s.end, s.entity_type) for s in got] == [(15, 20, "LOCATION")] or [(s.start, s.end) for s in got] == [(0, 11), (15, 20)]
    tags = spark.createDataFrame([("PER",), ("GPE",), ("ORG",)], "t string").select(ner.entity_of_tag(F.col("t")).alias("e")).collect()
    assert [r.e for r in tags] == ["PERSON", "LOCATION", None]


def test_parts_of_messages(spark):
    parts = "array<struct<type:string,text:string>>"
    rows = spark.createDataFrame([(1, 0, [("text", "a@x.com"), ("image_url", "a@x.com"), ("text", "b@x.com")]), (1, 1, [("text", "b@x.com")]), (2, 0, [("text", "b@x.com"), ("text", None)])], f"c int, t int, parts {parts}")
    got = {(r.c, r.t): [tuple(p) for p in r.parts] for r in anonymize_parts(rows, "c", "t", "parts", AnonymizerConfig(language="en")).collect()}
    assert got == {(1, 0): [("text", "<Email_1>"), ("image_url", "a@x.com"), ("text", "<Email_2>")], (1, 1): [("text", "<Email_2>")], (2, 0): [("text", "<Email_1>"), ("text", None)]}


def test_restoring_tables_and_completions(spark):
    kind = "array<struct<label:string,value:string>>"
    store = spark.createDataFrame([("k", 1, [("<A_1>", "old")]), ("k", 2, [("<A_1>", "new")]), ("m", 1, [("<A_1>", "m")])], f"k string, at int, mapping {kind}")
    last = restore.latest_mappings(store, ["k"], "at")
    texts = spark.createDataFrame([("k", "x <A_1>"), ("z", "x <A_1>")], "k string, t string")
    assert {r.k: r.restored_text for r in restore.restore_table(texts, last, ["k"], "t").collect()} == {"k": "x new", "z": "x <A_1>"}
    assert restore.latest_mappings(store, ["k"], "at", keep=1).first().k == "k"
    rows = spark.createDataFrame([([("<A_1>",), ("b",)], [([("text", "<A_1>"), ("image", "<A_1>")],)], [("<A_1>", "v")])], f"c array<struct<content:string>>, p array<struct<parts:array<struct<type:string,text:string>>>>, m {kind}")
    r = rows.select(restore.restored_completion(F.col("c"), F.col("m")).alias("c"), restore.restored_completion_parts(F.col("p"), F.col("m")).alias("p")).first()
    assert [x.content for x in r.c] == ["v", "b"] and [tuple(x) for x in r.p[0].parts] == [("text", "v"), ("image", "<A_1>")]


def test_events(spark):
    assert [events.listing_limit(n) for n in (None, 0, 7, 1000)] == [50, 50, 7, 100]
    rows = spark.createDataFrame([(i, s, "m" if i % 2 else None) for i, s in enumerate(["anonymized", "anonymized", "passthrough", "error"])], "n int, status string, mapping string")
    assert tuple(events.counters(rows, "status").first()) == (4, 2, 1, 1)
    assert [(r.n, r.hasMapping) for r in events.latest(rows, "n", 2).collect()] == [(3, True), (2, False)] and "mapping" not in events.latest(rows, "n").columns


def test_account_lengths(spark):
    rows = [("DE89370400440532013000", True), ("GB82 WEST 1234 5698 7654 32", True), ("NO9386011117947", True), ("DE8937040044053201300", False), ("ZZ89370400440532013000", False), ("DE89370400440532013001", False)]
    got = spark.createDataFrame(rows, "v string, ok boolean").select("v", "ok", V.iban_valid(F.col("v")).alias("got")).collect()
    assert all(r.ok == r.got for r in got)
    same = D.same_bounds(F.col("a"), F.col("b"))
    assert spark.sql("select named_struct('start', 1, 'end', 2) a, named_struct('start', 1, 'end', 2) b").select(same.alias("s")).first().s
