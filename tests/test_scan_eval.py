"""Whole scans, generated cases and their evaluation against brute force."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from cloakframe import queries as Q
from cloakframe.functions.languages import LANGUAGES, NAME_PARTS
from cloakframe.operators import evals, generate
from cloakframe.operators.labels import split_name
from cloakframe.operators.rules import rules_of
from test_spans_labels import by_owner


def digits(v):
    return re.sub("[^0-9]", "", v)


def luhn(v):
    d = [int(c) for c in re.sub("[- ]", "", v)][::-1]
    return 12 <= len(d) <= 19 and sum(c if i % 2 == 0 else sum(divmod(2 * c, 10)) for i, c in enumerate(d)) % 10 == 0


def my_number(v):
    d = [int(c) for c in digits(v)]
    rest = sum(a * b for a, b in zip(d, [6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2])) % 11
    return d[11] == (0 if rest <= 1 else 11 - rest)


CHECKS = {"card": luhn, "my_number": my_number, "jp_landline": lambda v: len(digits(v)) in (10, 11)}


@pytest.fixture(scope="module")
def found(spark, sf):
    """doc_id -> merged findings of every document, in its own language."""
    out = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        spans = []
        for rule in rules_of(("EMAIL_ADDRESS", "PHONE_NUMBER", "JP_POSTAL_CODE", "JP_MY_NUMBER", "CREDIT_CARD"), None, 0.4, "scan"):
            if rule.languages and r.lang not in rule.languages:
                continue
            own = re.compile(rule.pattern.replace(r"\x{a0}", "\xa0").replace(r"\x{feff}", "﻿"), re.ASCII)
            spans += [(*m.span(), rule.entity_type, rule.score) for m in own.finditer(r.text) if CHECKS.get(rule.name, lambda v: True)(m[0])]
        out[r.doc_id] = (r, by_owner(spans, r.text))
    return out


def test_scan_queries(spark, sf, found):
    places = set()
    for i, (r, spans) in found.items():
        for a, b, kind, score in spans:
            places.add((i, r.text.count("\n", 0, a) + 1, a - (r.text.rfind("\n", 0, a) + 1) + 1, a, b, kind, score))
    assert places and {tuple(x) for x in Q.line_col_findings(spark, sf).collect()} == places
    lines = sorted(r.line for r in Q.report_lines(spark, sf).collect())
    assert lines == sorted(f"{i}:{line}:{column}: {kind} (score {score:.2f})" for i, line, column, _, _, kind, score in places)
    objects = [json.loads(r.finding) for r in Q.report_objects(spark, sf).collect()]
    assert {(o["file"], o["start"], o["entity_type"]) for o in objects} == {(p[0], p[3], p[5]) for p in places} and all("value" not in o for o in objects)
    summary = Q.scan_summary(spark, sf).first()
    assert (summary.findings, summary.files, summary.inputs) == (len(places), len({p[0] for p in places}), len(found))
    counts = {}
    for r, spans in found.values():
        for _, _, kind, _ in spans:
            counts[r.source, kind] = counts.get((r.source, kind), 0) + 1
    assert {(r.source, r.entity_type): r.n for r in Q.entity_counts_by_source(spark, sf).collect()} == counts


def test_cases_are_seeded_and_spans_hold(spark):
    cases = generate.generate_cases(spark, count=9).collect()
    assert len(cases) == 9 * len(LANGUAGES) and {c.genre for c in cases} == set(generate.GENRES)
    for c in cases:
        assert all(c.text[s.start : s.end] == s.value for s in c.spans)
        number = int(c.id.split("-")[1])
        assert generate.case_of(c.language, number, generate.SEED)[3] == c.text
    assert cases != generate.generate_cases(spark, count=9, seed=1).collect()
    assert sorted(generate.generate_cases(spark.newSession(), count=9).repartition(3).collect()) == sorted(cases)
    with pytest.raises(ValueError):
        generate.generate_cases(spark, ("xx",))
    assert generate.samples(spark).count() == len(LANGUAGES) and generate.generate_cases(spark, count=0).count() == 0


def test_values_pass_their_checks():
    rng = random.Random(1)
    for _ in range(300):
        body = generate.drawn(rng, "4" + "#" * 14)
        assert luhn(body + str(generate.check_digit(body))) and my_number(generate.my_number(rng))
        turned = re.sub(" ", "", generate.iban(rng))
        assert int("".join(str(int(c, 36)) for c in turned[4:] + turned[:4])) % 97 == 1


def test_name_parts_equal_brute_force(spark):
    """Names with wrong gold parts count as missed and as extra."""
    rnd, rows = random.Random(2), []
    for i in range(60):
        name = rnd.choice(["John Smith", "John Ronald Tolkien", "Vincent van Gogh", "Ann"])
        parts = split_name(name, False) if rnd.random() < 0.6 else [("first", 0, 2), ("last", 3, len(name))]
        spans = [(0, len(name), "PERSON", name)] + [(a, b, NAME_PARTS[p], name[a:b]) for p, a, b in parts if rnd.random() < 0.9]
        rows.append((i, "en", name, spans))
    counts = {}
    for _, _, name, spans in rows:
        gold = {(s[2], s[0], s[1]) for s in spans[1:]}
        got = {(NAME_PARTS[p], a, b) for p, a, b in split_name(name, False)} if gold else set()
        for k, some in enumerate((gold & got, got - gold, gold - got)):
            for s in some:
                counts.setdefault(s[0], [0, 0, 0])[k] += 1
    df = spark.createDataFrame(rows, "id int, language string, text string, spans array<struct<start:int,end:int,entity_type:string,value:string>>")
    assert {r.entity_type: [r.tp, r.fp, r.fn] for r in evals.evaluate_name_parts(df, ["language"]).collect()} == counts


def test_floors_and_drift(spark):
    counts = spark.createDataFrame([("PERSON", 6, 0, 4), ("CREDIT_CARD", 10, 0, 0)], "entity_type string, tp long, fp long, fn long")
    assert [r.entity_type for r in evals.below_floor(counts, {"PERSON": 0.7, "CREDIT_CARD": 1.0}).collect()] == ["PERSON"]
    rows = evals.table_rows(evals.markdown(counts).unionByName(spark.createDataFrame([("| Type | P | R | F | N |",), ("text",)], "row string")), "row")
    assert rows.count() == 2 and evals.drift(rows, rows).isEmpty() and evals.drift(rows, rows.where("support < 0")).count() == 2
    assert {r.support for r in rows.collect()} == {10} and float(rows.select(F.sum("recall")).first()[0]) == pytest.approx(1.6, abs=0.01)
