import random

from pyspark.sql import functions as F

from cloakframe.operators import evals, labels, ner, restore
from cloakframe.operators.spans import EDGE, merge, repeats
from cloakframe.plans.anonymizer import AnonymizerConfig, anonymize, anonymize_conversations

SPAN = "array<struct<start:int,end:int,entity_type:string,score:double>>"


def by_owner(spans, text):
    """Spans one by one, best first: each keeps the stretches that are free."""
    taken, out = [None] * len(text), []
    for s in sorted(spans, key=lambda s: (-s[3], s[0] - s[1], s[0])):
        free = [i for i in range(s[0], s[1]) if taken[i] is None]
        whole = len(free) == s[1] - s[0]
        runs, at = [], 0
        while at < len(free):
            end = at
            while end + 1 < len(free) and free[end + 1] == free[end] + 1:
                end += 1
            runs.append([free[at], free[end] + 1])
            at = end + 1
        for a, b in runs:
            while not whole and a < b and text[a] in EDGE:
                a += 1
            while not whole and b > a and text[b - 1] in EDGE:
                b -= 1
            if a < b:
                out.append((a, b, *s[2:]))
                taken[a:b] = [1] * (b - a)
    return sorted(out)


def test_merge_equals_brute_force(spark):
    rnd, rows = random.Random(5), []
    for i in range(400):
        text = "".join(rnd.choice("ab 😀　") for _ in range(24))
        spans = []
        for _ in range(rnd.randint(0, 6)):
            a = rnd.randint(0, 22)
            spans.append((a, rnd.randint(a + 1, 24), rnd.choice("PL"), rnd.choice([0.5, 0.7, 0.9])))
        rows.append((i, text, spans))
    got = spark.createDataFrame(rows, f"id int, text string, spans {SPAN}").select("id", merge(F.col("spans"), F.col("text")).alias("m")).collect()
    assert {r.id: [tuple(s) for s in r.m] for r in got} == {i: by_owner(s, t) for i, t, s in rows}


def test_repeats():
    seed = {"start": 0, "end": 4, "entity_type": "PERSON", "score": 0.9}
    assert [(s["start"], s["end"]) for s in repeats("John and Johnny, John.", [seed])] == [(17, 21)]
    assert repeats("x x", [{**seed, "end": 1}]) == []


def detector(*names):
    def find(text, language):
        out = F.array().cast(SPAN)
        from cloakframe.operators.detect import match_bounds, span

        for n in names:
            out = F.concat(out, F.transform(match_bounds(text, n), lambda b: span(b["start"], b["end"], F.lit("PERSON"), F.lit(0.95))))
        return out

    return find


def test_conversation_labels(spark):
    rows = spark.createDataFrame([(1, 0, "a@x.com"), (1, 1, "b@x.com then a@x.com"), (2, 0, "b@x.com"), (3, 0, "nothing"), (3, 1, None)], "c int, t int, text string")
    got = {(r.c, r.t): r.masked_text for r in anonymize_conversations(rows, "c", "t", "text", AnonymizerConfig(entities=("EMAIL_ADDRESS",), normalize=False)).collect()}
    assert got == {(1, 0): "<Email_1>", (1, 1): "<Email_2> then <Email_1>", (2, 0): "<Email_1>", (3, 0): "nothing", (3, 1): None}


def test_conversation_name_parts(spark):
    rows = spark.createDataFrame([(1, 0, "John Smith wrote."), (1, 1, "Jane Doe met John Smith.")], "c int, t int, text string")
    config = AnonymizerConfig(language="en", entities=("PERSON",), normalize=False, split_names=True, detector=detector("John Smith", "Jane Doe"))
    got = [r.masked_text for r in anonymize_conversations(rows, "c", "t", "text", config).orderBy("t").collect()]
    assert got == ["<Name_1_First_Name> <Name_1_Last_Name> wrote.", "<Name_2_First_Name> <Name_2_Last_Name> met <Name_1_First_Name> <Name_1_Last_Name>."]


def test_names_in_parts(spark):
    rows = spark.createDataFrame([("John Smith ... John and Jane",)], "text string")
    config = AnonymizerConfig(language="en", entities=("PERSON",), normalize=False, split_names=True, detector=detector("John Smith", "John(?= and)", "Jane"))
    r = anonymize(rows, config=config).first()
    assert r.masked_text == "<Name_1_First_Name> <Name_1_Last_Name> ... <Name_1_First_Name> and <Name_2>"
    assert labels.split_name("Vincent van Gogh", False) == [("first", 0, 7), ("last", 8, 16)]
    assert labels.split_name("  John  ", False) == []


def test_restore(spark):
    rows = spark.createDataFrame([("<A_1> <A_10> <B_1>", [("<A_1>", "<A_10>x"), ("<A_10>", "ten")])], "text string, m array<struct<label:string,value:string>>")
    r = rows.select(restore.restored_with_report(F.col("text"), F.col("m")).alias("r")).first().r
    assert (r.text, r.unresolved) == ("<A_10>x ten <B_1>", ["<B_1>"])
    assert [(x.label, x["count"]) for x in r.replacements] == [("<A_10>", 1), ("<A_1>", 1)]


def test_ner_alignment(spark):
    assert ner.find_words("New  York is", 0, ["New", "▁York"]) == (0, 9)
    assert ner.find_words("ab abc", 1, ["a", "##b"]) == (3, 5)
    assert ner.find_words("x", 0, [" "]) is None


def test_greedy_matching():
    g = {"start": 0, "end": 4, "entity_type": "PERSON"}
    assert evals.matched([g], [{**g, "end": 2}]) == {"PERSON": [1, 0, 0]}
    assert evals.matched([g], [g, g]) == {"PERSON": [1, 1, 0]}
    assert evals.matched([{**g, "entity_type": "PERSON_FIRST_NAME"}], []) == {}
