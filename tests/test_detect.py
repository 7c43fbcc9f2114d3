import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakframe.functions.languages import LANGUAGES, LABEL_KEYS, UnsupportedLanguageError, check_language, label_words
from cloakframe.operators import detect as D
from cloakframe.operators.rules import RULES, rules_of
from cloakframe.plans.anonymizer import AnonymizerConfig, anonymize, deanonymize, scan

STRUCTURED = ("EMAIL_ADDRESS", "PHONE_NUMBER", "JP_POSTAL_CODE", "JP_MY_NUMBER", "CREDIT_CARD")


def test_native_offsets_equal_regex_engine(spark):
    """Spans by gaps and matches equal those of Python's engine, every rule."""
    glue = ["", " ", "a", "で", "😀", "\n", "1", "-", "。", "("]
    samples = ["taro@example.com", "090-1234-5678", "0120-123-456", "03-1234-5678", "(333) 333-3333", "+34 612 345 678", "91 234 56 78", "0912 345 678", "+84912345678", "138 0013 8000", "010-12345678", "010-1234-5678", "+82 10-1234-5678", "06 12 34 56 78", "+49 30 901820", "030 901820", "+351912345678", "912 345 678", "333 123 4567", "+39 3331234567", "06 698212", "〒100-0001", "100-0001", "1234-5678-9018", "4111 1111 1111 1111", "856-45-6780", "DE89 3704 0044 0532 0130 00"]
    import random

    rnd = random.Random(3)
    texts = ["".join(rnd.choice(glue) + rnd.choice(samples + glue) for _ in range(rnd.randint(0, 5))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").cache()
    for rule in RULES:
        got = {r.id: [(b.start, b.end) for b in r.b] for r in rows.select("id", D.match_bounds(F.col("text"), rule.pattern).alias("b")).collect()}
        own = re.compile(rule.pattern.replace(r"\x{a0}", "\xa0").replace(r"\x{feff}", "﻿"), re.ASCII)
        assert got == {i: [m.span() for m in own.finditer(t)] for i, t in enumerate(texts)}, rule.name
        assert all(re.search(rule.needs, m[0]) for t in texts for m in own.finditer(t)), rule.name


@given(st.data())
@settings(max_examples=400, deadline=None)
def test_every_match_holds_what_its_rule_needs(data):
    """Strings made from the rules' own patterns hold what gates them."""
    rule = data.draw(st.sampled_from(RULES))
    own = re.compile(rule.pattern.replace(r"\x{a0}", "\xa0").replace(r"\x{feff}", "\ufeff"), re.ASCII)
    match = own.search(data.draw(st.from_regex(own)))
    assert re.search(rule.needs, match[0])


MASKED = [
    ("ja", "メールはtaro@example.comです。", "taro@example.com"), ("ja", "連絡先は090(1234)5678です。", "090(1234)5678"), ("en", "Reach us at +1 333 333 3333 anytime.", "+1 333 333 3333"),
    ("ja", "宛先は〒1000001としてください。", "〒1000001"), ("ja", "マイナンバーは123456789018です。", "123456789018"), ("ja", "〒　100-0001", "〒　100-0001"),
]
KEPT = ["注文番号は1090-1234-5678です。", "整理コードは090-1234-56789です。", "郵便番号は100-0001です。", "整理番号は123456789019です。", "Logged at 1748503543012 by the collector."]


def test_cases(spark):
    rows = spark.createDataFrame([(t, v) for _, t, v in MASKED], "text string, value string")
    for r in anonymize(rows).collect():
        assert r.value not in r.masked_text and [m.value for m in r.mapping] == [r.value]
    for r in anonymize(spark.createDataFrame([(t,) for t in KEPT], "text string")).collect():
        assert r.masked_text == r.text


def test_deny_allow_repeat(spark):
    text = "プロジェクトXの資料は明日、プロジェクトX担当者に渡してください。窓口は taro@example.com、個人は hanako@example.org です。"
    config = AnonymizerConfig(deny_list=("プロジェクトX", ""), allow_list=("taro@example.com",))
    r = anonymize(spark.createDataFrame([(text,)], "text string"), config=config).first()
    assert r.masked_text == "<秘匿情報_1>の資料は明日、<秘匿情報_1>担当者に渡してください。窓口は taro@example.com、個人は <メールアドレス_1> です。"
    both = AnonymizerConfig(deny_list=("secret",), allow_list=("secret",))
    one = spark.createDataFrame([("a secret",)], "text string")
    assert anonymize(one, config=both).first().masked_text == "a secret"
    assert scan(one.withColumn("n", F.lit("f")), "n", config=AnonymizerConfig(deny_list=("secret",), allow_list=("secret",), profile="scan")).count() == 1


def test_normalized_view_and_plain_columns(spark):
    rows = spark.createDataFrame([("担当のﾔﾏﾀﾞです。090-1234-5678", 1), ("cafe\u0301 333-333-3333", 2), (None, 3), ("", 4)], "text string, spans int")
    config = AnonymizerConfig(deny_list=("ヤマダ",))
    got = {r.spans: r.masked_text for r in anonymize(rows, config=config).collect()}
    assert got == {1: "担当の<秘匿情報_1>です。<電話番号_1>", 2: "cafe\u0301 <Phone_1>", 3: None, 4: ""}


def test_pruning_and_guards():
    assert {r.name for r in rules_of(("EMAIL_ADDRESS",))} == {"email"}
    assert "postal_bare" not in {r.name for r in rules_of(None, None, 0.4)}
    assert {r.name: r.score for r in rules_of(profile="scan")}["my_number"] == 1.0
    with pytest.raises(UnsupportedLanguageError):
        check_language("xx")
    assert all(set(label_words(g)) == set(LABEL_KEYS) for g in LANGUAGES)


def test_scan_reports_no_text(spark):
    rows = spark.createDataFrame([("f1", "x\nmail a@b.com"), ("f2", "nothing")], "name string, text string")
    found = scan(rows, "name")
    assert [tuple(r) for r in found.collect()] == [("f1", 2, 6, 7, 14, "EMAIL_ADDRESS", 0.9)]
    assert "a@b.com" not in str(found.collect())


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab@.c1 2-3<_>\n", max_size=30), min_size=1, max_size=20))
def test_round_trip(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts if "<" not in t] or [("",)], "text string")
    config = AnonymizerConfig(entities=("EMAIL_ADDRESS", "CREDIT_CARD"), normalize=False)
    assert all(r.restored_text == r.text for r in deanonymize(anonymize(rows, config=config)).collect())


def test_one_scan_and_no_copies(spark, tmp_path):
    """The source is read once, patterns stand in the plan once, and nothing but
    the text is read for the masked text alone."""
    spark.createDataFrame([(1, "a@b.com", "x")], "k int, text string, other string").write.parquet(str(tmp_path / "t"))
    df = anonymize(spark.read.parquet(str(tmp_path / "t")))
    plan = df.select("masked_text", F.explode("mapping"))._jdf.queryExecution().optimizedPlan().toString()
    rules = len(rules_of(AnonymizerConfig().entities, AnonymizerConfig().languages, 0.4))
    assert plan.count("Relation [") == 1 and plan.count("regexp_extract_all") == 2 * rules
    assert "other" not in df.select("masked_text")._jdf.queryExecution().executedPlan().toString()


def test_all_columns_stay(spark):
    names = ["_text", "_lang", "_spans", "_view", "_found", "_ruled", "_denied", "_kept", "_model", "_valued", "pieces", "mapping", "entities", "masked_text", "lang", "spans"]
    df = spark.createDataFrame([("mail a@b.com",), (None,), ("",)], "text string").withColumns({n: F.lit(f"own {n}") for n in names})
    got = anonymize(df, config=AnonymizerConfig(language="en"))
    assert got.columns[: len(df.columns)] == df.columns
    assert [r.masked_text_ for r in got.collect()] == ["mail <Email_1>", None, ""] and all(r[n] == f"own {n}" for r in got.collect() for n in names)
    named = anonymize(df, config=AnonymizerConfig(language="en", split_names=True))
    assert [r.masked_text_ for r in named.collect()] == ["mail <Email_1>", None, ""]
    assert scan(df, "lang").count() == 1


def test_context_words(spark):
    texts = ["郵便番号は100-0001です。", "番号は100-0001です。", "zip 100-0001 です", "zipped 100-0001 です"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.masked_text for r in anonymize(rows, config=AnonymizerConfig(context=True)).collect()}
    assert [got[t] != t for t in texts] == [True, False, True, False]


def test_needles_from_a_table(spark):
    import random

    rnd = random.Random(2)
    words = ["".join(rnd.choice("abc日") for _ in range(rnd.randint(1, 5))) for _ in range(40)]
    texts = [(i, "".join(rnd.choice("abc日 ") for _ in range(60))) for i in range(20)] + [(99, None), (98, "")]
    needles = spark.createDataFrame([(w,) for w in [*words, None, ""]], "w string")
    got = {tuple(r)[:3] + (r.value,) for r in D.needle_spans(spark.createDataFrame(texts, "id int, text string"), "id", "text", needles, "w").collect()}
    assert got == {(i, k, k + len(w), w) for i, t in texts for w in words for k in range(len(t or "")) if (t or "").startswith(w, k)}


def test_languages_by_characters(spark):
    from cloakframe.functions.languages import LANGUAGE_CLASSES, guess_language

    texts = ["plain", "", "Straße", "naïve ñ", "日本語の", "한국 日", "中文", "Ơ ß", "😀", "é\n\x00", "ç and è"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", guess_language(F.col("t")).alias("g")).collect()
    assert all(r.g == next((c for c, p in LANGUAGE_CLASSES if re.search(p, r.t)), "en") for r in rows)
