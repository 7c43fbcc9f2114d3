"""Queries of the PII operators on the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import languages as G
from .functions import normalize as N
from .functions import text as X
from .functions import validators as V
from .operators import detect as D
from .operators import evals as E
from .operators import events as EV
from .operators import generate as GEN
from .operators import labels as L
from .operators import ner as NER
from .operators import restore as R
from .operators import rules as RU
from .operators import scan as S
from .operators.spans import merge, propagate
from .plans import anonymizer as A
from .sources import readers as RD
from .sources import writers as WR
from .streaming import restore as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_RULES = {r.name: r for r in RU.RULES}
_DOC = ["email", "us_phone", "card"]
#: All rules that a scan with default options applies.
_ALL = [r.name for r in RU.rules_of(G.DEFAULT_ENTITIES, None, D.THRESHOLD)]
_NEEDLES = ("idiot", "trash", "moron")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(x: object) -> str:
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else f"'{x.replace(chr(39), chr(39) * 2)}'" if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else f"CAST({x} AS BIGINT)"


def values(names: list[str], rows: list[tuple]) -> str:
    """DuckDB SQL of literal rows."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS t({', '.join(chr(34) + n + chr(34) for n in names)})"


# ---- SQL of rules: DuckDB's expressions have no look-around, so candidates are
# taken at every place whose neighbours allow them, and overlapped ones go.


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


_LUHN = "list_sum(list_transform(range(1, length({d}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(substr({d}, CAST(length({d}) + 1 - k AS INT), 1) AS INT) ELSE (CAST(substr({d}, CAST(length({d}) + 1 - k AS INT), 1) AS INT) * 2) % 10 + (CAST(substr({d}, CAST(length({d}) + 1 - k AS INT), 1) AS INT) * 2) // 10 END)) % 10 = 0"
_CHECK_SQL = {
    "jp_landline": f"length({_digits('v')}) IN (10, 11)",
    "card": f"length({_digits('v')}) BETWEEN 12 AND 19 AND {_LUHN.format(d=_digits('v'))}",
    "ssn": "{d} NOT SIMILAR TO '(000|666|123456789|98765432|078051120).*' AND substr({d}, 4, 2) <> '00' AND substr({d}, 6, 4) <> '0000' AND length(replace({d}, substr({d}, 1, 1), '')) > 0 AND (v LIKE '___-__-____' OR v LIKE '___ __ ____' OR v LIKE '___.__.____')".format(d=_digits("v")),
    "iban": "list_reduce(list_transform(string_split(regexp_replace(concat(substr(replace(replace(v, ' ', ''), '-', ''), 5), substr(replace(replace(v, ' ', ''), '-', ''), 1, 4)), '(.)', '\\1,', 'g'), ','), lambda x: CASE WHEN x = '' THEN -1 WHEN x BETWEEN '0' AND '9' THEN CAST(x AS INT) ELSE ascii(x) - 55 END), lambda a, x: CASE WHEN x < 0 THEN a WHEN x > 9 THEN (a * 100 + x) % 97 ELSE (a * 10 + x) % 97 END) = 1",
    "my_number": "(WITH w AS (SELECT list_sum(list_transform(range(1, 12), lambda k: CAST(substr({d}, CAST(k AS INT), 1) AS INT) * [6,5,4,3,2,7,6,5,4,3,2][k])) % 11 AS r) SELECT CASE WHEN r <= 1 THEN 0 ELSE 11 - r END = CAST(substr({d}, 12, 1) AS INT) FROM w)".format(d=_digits("v")),
}


def rule_sql(name: str, source: str = "documents", key: str = "doc_id", text: str = "text", checked: bool = True) -> str:
    """(key, start, end, entity_type, score, value) of one rule's matches."""
    rule = _RULES[name]
    body = rule.pattern.replace(r"[\d", "[0-9").replace(r"\d", "[0-9]")
    before = re.match(r"\(\?<!(\[[^\]]*\])\)", body)
    after = re.search(r"\(\?!(\[[^\]]*\])\)$", body)
    core = body[before.end() if before else 0 : after.start() if after else len(body)]
    guard = ""
    if name == "card":
        core = core.replace("(?!1[0-9]{12}(?![0-9]))", "")
        guard = f" AND NOT regexp_matches(substr({text}, i, 14), '^1[0-9]{{12}}([^0-9]|$)')"
    ends = f"(?:{after[1].replace('[', '[^', 1)}|$)" if after else ""
    lead = f"(i = 1 OR NOT regexp_matches(substr({text}, i - 1, 1), '{before[1]}'))" if before else "TRUE"
    check = f" AND {_CHECK_SQL[name]}" if checked and name in _CHECK_SQL else ""
    return f"""
      SELECT {key}, s AS "start", s + length(v) AS "end", '{rule.entity_type}' AS entity_type, CAST({rule.score} AS DOUBLE) AS score, v AS value FROM (
        SELECT *, max(s + length(v)) OVER (PARTITION BY {key} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS taken FROM (
          SELECT {key}, CAST(i - 1 AS BIGINT) AS s, regexp_extract(substr({text}, i, 2000), '^({core}){ends}', 1) AS v FROM (
            SELECT {key}, {text}, unnest(range(1, length({text}) + 1)) AS i FROM {source} WHERE regexp_matches({text}, '{core}')) WHERE {lead}{guard}) WHERE v <> '')
      WHERE (taken IS NULL OR s >= taken){check}"""


def spans_sql(names: list[str] = _DOC, **options) -> str:
    return " UNION ALL ".join(f"({rule_sql(n, **options)})" for n in names)


def own_language_sql(names: list[str] = _ALL, table: str = "documents", key: str = "doc_id", language: str = "lang", text: str = "text") -> str:
    """Spans of the rules, each in texts of its languages."""
    parts = []
    for n in names:
        codes = _RULES[n].languages
        source = f"(SELECT * FROM {table} WHERE {language} IN ({', '.join(map(quoted, codes))}))" if codes else table
        parts.append(f"({rule_sql(n, source, key, text)})")
    return " UNION ALL ".join(parts)


def needle_sql(needles: tuple[str, ...], source: str, key: str, text: str) -> str:
    """Occurrences of needles (that don't overlap themselves)."""
    rows = ", ".join(f"({quoted(n)})" for n in needles)
    return f"""
      SELECT {key}, CAST(i - 1 AS BIGINT) AS "start", CAST(i - 1 + length(n) AS BIGINT) AS "end", 'CUSTOM' AS entity_type, CAST(1.0 AS DOUBLE) AS score, n AS value FROM (
        SELECT {key}, {text}, n, unnest(range(1, length({text}) + 1)) AS i FROM {source}, (VALUES {rows}) AS w(n) WHERE contains({text}, n)) WHERE substr({text}, i, length(n)) = n"""


def labelled_sql(spans: str, key: str = "doc_id", word: str = "CASE entity_type WHEN 'EMAIL_ADDRESS' THEN 'Email' WHEN 'PHONE_NUMBER' THEN 'Phone' WHEN 'CREDIT_CARD' THEN 'CreditCard' ELSE 'Custom' END") -> str:
    return f"""
      SELECT *, '<' || {word} || '_' || dense_rank() OVER (PARTITION BY {key}, entity_type ORDER BY f) || '>' AS label
      FROM (SELECT *, min("start") OVER (PARTITION BY {key}, entity_type, value) AS f FROM ({spans}))"""


def masked_sql(spans: str, source: str = "documents", keys: str = "doc_id", text: str = "text") -> str:
    """(keys, masked_text): gaps and labels joined in order."""
    one = keys.split(", ")[0]
    return f"""
      WITH l AS ({spans}),
      p AS (SELECT l.*, coalesce(lag("end") OVER (PARTITION BY {keys} ORDER BY "start"), 0) AS a FROM l),
      j AS (SELECT {keys}, string_agg(substr({text}, CAST(a + 1 AS INT), CAST("start" - a AS INT)) || label, '' ORDER BY "start") AS head, max("end") AS last FROM p JOIN {source} USING ({keys}) GROUP BY {keys})
      SELECT {keys}, CASE WHEN j.last IS NULL THEN {text} ELSE j.head || substr({text}, CAST(j.last + 1 AS INT)) END AS masked_text FROM {source} LEFT JOIN j USING ({keys}) WHERE {one} IS NOT NULL"""


# ---- detection on documents


def doc_spans(spark: SparkSession, sf_dir: str, names: list[str] = _DOC, merged: bool = True) -> DataFrame:
    """documents with spans of some rules."""
    docs = table(spark, sf_dir, "documents").withColumn("_raw", D.once(D.detect_rules(F.col("text"), F.lit("en"), [_RULES[n] for n in names])))
    return docs.withColumn("spans", D.once(merge(F.col("_raw"), F.col("text"))) if merged else F.col("_raw")).drop("_raw")


def own_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the unmerged spans of all rules of each text's language."""
    rules = [_RULES[n] for n in _ALL]
    return table(spark, sf_dir, "documents").withColumn("spans", D.once(D.detect_rules(F.col("text"), F.col("lang"), rules)))


#: A whole scan; each document in its own language.
_SCAN = A.AnonymizerConfig(profile="scan", language_col="lang")


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the findings of a whole scan, merged, in column spans."""
    docs = table(spark, sf_dir, "documents")
    return A.with_spans(docs, "text", _SCAN).withColumnRenamed("_spans", "spans")


def exploded(df: DataFrame, key: str = "doc_id", spans: str = "spans") -> DataFrame:
    rows = df.select(key, F.col("text").alias("_t"), F.explode(spans).alias("_s"))
    return rows.select(key, F.col("_s.start").cast("long").alias("start"), F.col("_s.end").cast("long").alias("end"), "_s.entity_type", "_s.score", D.value_of(F.col("_t"), F.col("_s")).alias("value"))


def _masked(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("EMAIL_ADDRESS", "PHONE_NUMBER")) -> DataFrame:
    rules = ["email", "us_phone"] if len(names) == 2 else _DOC
    found = doc_spans(spark, sf_dir, rules)
    valued = found.withColumn("_v", L.valued_spans(F.col("text"), F.col("spans")))
    return valued.withColumn("pieces", D.once(L.label_pieces(F.col("_v"), F.lit("en")))).withColumns({"mapping": L.mapping_of(F.col("pieces")), "masked_text": L.spliced(F.col("text"), F.col("pieces"))}).drop("_v")


@query(masked_sql(labelled_sql(spans_sql(["email", "us_phone"]))))
def mask_email_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir).select("doc_id", "masked_text")


def _add_rule_query(name: str, rule: str, checked: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        one = _RULES[rule]
        if not checked:
            one = RU.Rule(one.name, one.entity_type, one.pattern, one.score, one.languages, None, one.needs)
        docs = table(spark, sf_dir, "documents").withColumn("spans", D.detect_rules(F.col("text"), F.lit("en"), [one]))
        return exploded(docs)

    QUERIES[name], SQL[name] = run, rule_sql(rule, checked=checked)


for _name, _rule, _checked in (
    ("email_spans", "email", True), ("us_phone_spans", "us_phone", True), ("card_candidates", "card", False), ("card_luhn_valid", "card", True),
):
    _add_rule_query(_name, _rule, _checked)


@query(f"SELECT split_part(value, '@', 2) AS domain, count(*) AS n FROM ({spans_sql(['email'])}) GROUP BY 1")
def email_domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(doc_spans(spark, sf_dir, ["email"])).groupBy(F.substring_index("value", "@", -1).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, {G.guess_language_sql('text')} AS language FROM documents")
def guess_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", G.guess_language(F.col("text")).alias("language"))


@query(f"SELECT lang, {G.guess_language_sql('text')} AS guessed, count(*) AS n FROM documents GROUP BY 1, 2")
def language_vs_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", G.guess_language(F.col("text")).alias("guessed")).agg(F.count(F.lit(1)).alias("n"))


def _denied(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return table(spark, sf_dir, name).withColumn("spans", D.deny_spans(F.col("text"), _NEEDLES))


@query(needle_sql(_NEEDLES, "documents", "doc_id", "text"))
def deny_list_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(_denied(spark, sf_dir))


@query(f"SELECT * FROM ({needle_sql(_NEEDLES, 'documents', 'doc_id', 'text')}) WHERE value <> 'moron'")
def allow_filtered_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(_denied(spark, sf_dir).withColumn("spans", D.not_allowed(F.col("spans"), F.col("text"), ["moron"])))


@query(f"SELECT * FROM ({spans_sql()}) WHERE score >= 0.9")
def threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = doc_spans(spark, sf_dir, merged=False)
    return exploded(found.withColumn("spans", D.at_least(F.col("spans"), 0.9)))


@query(f"SELECT * FROM ({spans_sql()}) WHERE entity_type IN ('EMAIL_ADDRESS', 'CREDIT_CARD')")
def entity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = doc_spans(spark, sf_dir, merged=False)
    return exploded(found.withColumn("spans", D.of_types(F.col("spans"), ["EMAIL_ADDRESS", "CREDIT_CARD"])))


@query(f"SELECT entity_type, score, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({own_language_sql()}) GROUP BY 1, 2")
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(own_language_spans(spark, sf_dir)).groupBy("entity_type", "score").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(own_language_sql())
def spans_in_own_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(own_language_spans(spark, sf_dir))


@query()
def line_col_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of a whole scan; merged spans have no short form in SQL."""
    return A.scan(table(spark, sf_dir, "documents"), "doc_id", "text", _SCAN)


@query()
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.report_lines(line_col_findings(spark, sf_dir))


@query()
def report_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.report_json(line_col_findings(spark, sf_dir), table(spark, sf_dir, "documents").count())


@query()
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.summary(scanned(spark, sf_dir), "doc_id", "spans")


_WITH_PII = f"doc_id IN (SELECT doc_id FROM ({own_language_sql()}))"


@query(f"SELECT lang, count(*) AS docs, count(*) FILTER ({_WITH_PII}) AS with_pii FROM documents GROUP BY 1")
def docs_with_pii_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return own_language_spans(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.size("spans") > 0).alias("with_pii"))


@query()
def entity_counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = scanned(spark, sf_dir).select("source", F.explode(D.entity_counts(F.col("spans"))).alias("entity_type", "k"))
    return counted.groupBy("source", "entity_type").agg(F.sum("k").cast("long").alias("n"))


@query(f"SELECT doc_id, count(*) AS findings FROM ({own_language_sql()}) GROUP BY 1 ORDER BY findings DESC, doc_id LIMIT 20")
def top_docs_by_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return own_language_spans(spark, sf_dir).where(F.size("spans") > 0).select("doc_id", F.size("spans").cast("long").alias("findings")).orderBy(F.desc("findings"), "doc_id").limit(20)


@query(f"SELECT quality, toxic, count(*) AS docs, count(*) FILTER ({_WITH_PII}) AS with_pii FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def quality_vs_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = own_language_spans(spark, sf_dir).select("doc_id", (F.size("spans") > 0).alias("p"))
    return flagged.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("docs"), F.count_if("p").alias("with_pii"))


def _guessed(spark: SparkSession, sf_dir: str, name: str, key: str, text: str) -> DataFrame:
    rows = table(spark, sf_dir, name).select(key, F.col(text).alias("text"))
    return rows.withColumn("spans", D.once(D.detect_rules(F.col("text"), G.guess_language(F.col("text")), [_RULES[n] for n in _ALL])))


def _guessed_sql(name: str, key: str, text: str) -> str:
    return own_language_sql(_ALL, f"(SELECT {key}, {text} AS text, {G.guess_language_sql(text)} AS lang FROM {name})", key)


@query(f"SELECT count(*) AS items, count(*) FILTER (item_id IN (SELECT item_id FROM ({_guessed_sql('benchmark', 'item_id', 'text')}))) AS with_pii FROM benchmark")
def benchmark_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guessed(spark, sf_dir, "benchmark", "item_id", "text").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.size("spans") > 0).alias("with_pii"))


@query(f"SELECT entity_type, count(*) AS n FROM ({_guessed_sql('pages', 'page_id', 'html')}) GROUP BY 1")
def pages_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(_guessed(spark, sf_dir, "pages", "page_id", "html"), "page_id").groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


# ---- generated cases: made in each document's place, so that every rule has matches


#: Cases of each language that queries use.
_CASES = 30


def _cases(spark: SparkSession, count: int = GEN.COUNT) -> DataFrame:
    return GEN.generate_cases(spark, count=count)


def _case_list() -> list[tuple[int, str, str]]:
    return [(k * _CASES + i, code, GEN.case_of(code, i, GEN.SEED)[3]) for k, code in enumerate(G.LANGUAGES) for i in range(_CASES)]


#: documents, each with a case's text behind a line of its own.
_DOC_CASES = f"(SELECT doc_id, c.language, doc_id || chr(10) || c.text AS text FROM documents JOIN ({values(['n', 'language', 'text'], _case_list())}) c ON doc_id % {_CASES * len(G.LANGUAGES)} = c.n)"


def doc_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _cases(spark, _CASES)
    place = F.array_position(F.array(*map(F.lit, G.LANGUAGES)), F.col("language")) - 1
    numbered = cases.select((place * _CASES + F.substring_index("id", "-", -1).cast("long")).alias("n"), "language", F.col("text").alias("_case"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(f"doc_id % {_CASES * len(G.LANGUAGES)}").alias("n"))
    return docs.join(F.broadcast(numbered), "n").select("doc_id", "language", F.concat_ws("\n", F.col("doc_id").cast("string"), "_case").alias("text"))


def _add_case_query(name: str, rules: list[str], checked: bool = True) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ones = [r if checked else RU.Rule(r.name, r.entity_type, r.pattern, r.score, r.languages, None, r.needs) for r in (_RULES[n] for n in rules)]
        return exploded(doc_cases(spark, sf_dir).withColumn("spans", D.once(D.detect_rules(F.col("text"), F.col("language"), ones))))

    def source(n: str) -> str:
        codes = _RULES[n].languages
        return f"(SELECT * FROM {_DOC_CASES} WHERE language IN ({', '.join(map(quoted, codes))}))" if codes else _DOC_CASES

    QUERIES[name], SQL[name] = run, " UNION ALL ".join(f"({rule_sql(n, source(n), checked=checked)})" for n in rules)


for _name, _rules, _checked in (
    ("my_number_candidates", ["my_number"], False), ("my_number_valid", ["my_number"], True), ("jp_mobile_spans", ["jp_mobile"], True), ("jp_toll_free_spans", ["jp_toll_free"], True), ("jp_landline_spans", ["jp_landline"], True),
    ("postal_spans", ["postal_marked", "postal_bare"], True), ("ssn_spans", ["ssn"], True), ("iban_spans", ["iban"], True), *((f"{code}_phone_spans", [r.name for r in RU.RULES if r.languages == (code,) and r.entity_type == "PHONE_NUMBER"], True) for code in ("es", "vi", "zh", "ko", "fr", "de", "pt", "it")),
):
    _add_case_query(_name, _rules, _checked)


def _support() -> list[tuple[str, str, int]]:
    """Structured values of each language and type by the texts' slots."""
    out: dict[tuple[str, str], int] = {}
    for code in G.LANGUAGES:
        for i in range(GEN.COUNT):
            for slot in re.findall(r"\{(\w+)\}", GEN.TEXTS[code][i % len(GEN.GENRES)]):
                if GEN.ENTITY.get(slot) in E.TABLE_TYPES:
                    out[code, GEN.ENTITY[slot]] = out.get((code, GEN.ENTITY[slot]), 0) + 1
    return [(*k, n) for k, n in out.items()]


_TABLE = [(code, kind, n, 0, 0, 1.0, 1.0, 1.0) for code, kind, n in _support()]


@query(values(["language", "entity_type", "tp", "fp", "fn", "precision", "recall", "f1"], _TABLE))
def eval_structured_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.with_rates(E.rules_table(_cases(spark), ["language"]))


@query(values(["language", "entity_type", "tp", "fp", "fn"], [r[:5] for r in _TABLE]))
def eval_masked_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan, in each case's language, on the types with rules."""
    config = A.AnonymizerConfig(language_col="language", entities=(*G.DEFAULT_ENTITIES, *G.OPTIONAL_ENTITIES))
    gold = F.filter("spans", lambda s: s["entity_type"].isin(*E.TABLE_TYPES))
    found = A.anonymize(_cases(spark), "text", config).select("language", gold.alias("gold"), "entities")
    return E.evaluate(found, "gold", "entities", ["language"])


_PARTS_SQL = values(["language", "entity_type", "n"], [(code, kind, n) for code in G.LANGUAGES for kind, n in sorted(Counter(s["entity_type"] for i in range(GEN.COUNT) for s in GEN.case_of(code, i, GEN.SEED)[4] if s["entity_type"] in G.NAME_PARTS.values()).items())])


@query(f"SELECT language, entity_type, n AS tp, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn FROM ({_PARTS_SQL})")
def eval_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.evaluate_name_parts(_cases(spark), ["language"])


#: Recall floors of the types with rules.
_FLOORS = {kind: 0.95 for kind in E.TABLE_TYPES}


@query("SELECT 'x' AS entity_type, CAST(0 AS DOUBLE) AS recall, CAST(0 AS DOUBLE) AS floor, CAST(0 AS BIGINT) AS support, TRUE AS ok WHERE FALSE UNION ALL " + " UNION ALL ".join(f"SELECT '{k}', CAST(1.0 AS DOUBLE), CAST(0.95 AS DOUBLE), CAST({sum(n for _, kind, n in _support() if kind == k)} AS BIGINT), TRUE" for k in E.TABLE_TYPES))
def recall_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = E.with_rates(E.rules_table(_cases(spark).withColumn("all", F.lit("all")), ["all"]))
    limits = spark.createDataFrame(list(_FLOORS.items()), "entity_type string, floor double")
    return counts.join(F.broadcast(limits), "entity_type").select("entity_type", "recall", "floor", (F.col("tp") + F.col("fn")).alias("support"), (F.col("recall") >= F.col("floor")).alias("ok"))


@query(values(["row"], [(f"| {k} | 1.00 | 1.00 | 1.00 | {sum(n for _, kind, n in _support() if kind == k)} |",) for k in E.TABLE_TYPES]))
def eval_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.markdown(E.rules_table(_cases(spark).withColumn("all", F.lit("all")), ["all"]))


@query(values(["side", "entity_type", "support"], [("documented", "US_SSN", 1), ("now", "US_SSN", 67)]))
def table_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of today against a documented one in which one row is old."""
    lines = eval_markdown(spark, sf_dir)
    old = lines.select(F.when(F.col("row").startswith("| US_SSN"), F.lit("| US_SSN | 1.00 | 1.00 | 1.00 | 1 |")).otherwise(F.col("row")).alias("row"))
    return E.drift(E.table_rows(lines, "row"), E.table_rows(old, "row")).select("side", "entity_type", "support")


# ---- labels and restoring


@query(f"SELECT DISTINCT doc_id, label, value FROM ({labelled_sql(spans_sql())})")
def label_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir, ("EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD")).select("doc_id", F.inline("mapping"))


@query(f"SELECT doc_id, entity_type, value, dense_rank() OVER (PARTITION BY doc_id, entity_type ORDER BY f) AS rank FROM (SELECT doc_id, entity_type, value, min(\"start\") AS f FROM ({spans_sql()}) GROUP BY 1, 2, 3)")
def first_appearance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    seen = exploded(doc_spans(spark, sf_dir)).groupBy("doc_id", "entity_type", "value").agg(F.min("start").alias("f"))
    return seen.select("doc_id", "entity_type", "value", F.dense_rank().over(Window.partitionBy("doc_id", "entity_type").orderBy("f")).cast("long").alias("rank"))


@query("SELECT doc_id, TRUE AS ok FROM documents")
def restore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    restored = A.deanonymize(A.anonymize(table(spark, sf_dir, "documents"), "text"))
    return restored.select("doc_id", (F.col("restored_text") == F.col("text")).alias("ok"))


@query(f"SELECT DISTINCT doc_id, label AS placeholder FROM ({labelled_sql(spans_sql())})")
def placeholders_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = _masked(spark, sf_dir, ("EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD"))
    return masked.where(F.col("masked_text").contains("<")).select("doc_id", F.explode(X.placeholders(F.col("masked_text"))).alias("placeholder"))


@query(f"SELECT DISTINCT doc_id, label FROM ({labelled_sql(spans_sql())}) WHERE entity_type <> 'EMAIL_ADDRESS'")
def unresolved_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = _masked(spark, sf_dir, ("EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD")).where(F.size("pieces") > 0)
    mails = F.filter("mapping", lambda m: m["label"].startswith("<Email"))
    return masked.select("doc_id", F.explode(R.restored_with_report(F.col("masked_text"), mails)["unresolved"]).alias("label"))


@query(f"SELECT doc_id, label, count(*) AS n FROM ({labelled_sql(spans_sql())}) GROUP BY 1, 2")
def replacement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = _masked(spark, sf_dir, ("EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD")).where(F.size("pieces") > 0)
    rows = masked.select("doc_id", F.inline(R.restored_with_report(F.col("masked_text"), F.col("mapping"))["replacements"]))
    return rows.select("doc_id", "label", F.col("count").cast("long").alias("n"))


_CONV = "(SELECT *, conv_id * 1000000000 + turn AS m FROM conversations)"


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@query("""SELECT conv_id, CASE """ + " ".join(f"WHEN bool_or(regexp_matches(text, '{c}')) THEN '{code}'" for code, c in G.LANGUAGE_CLASSES) + """ ELSE 'en' END AS language FROM conversations GROUP BY 1""")
def conversation_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = [F.max(F.col("text").rlike(c)).alias(f"m{i}") for i, (_, c) in enumerate(G.LANGUAGE_CLASSES)]
    out: Column = F.lit("en")
    for i, (code, _) in reversed(list(enumerate(G.LANGUAGE_CLASSES))):
        out = F.when(F.col(f"m{i}"), F.lit(code)).otherwise(out)
    return _conversations(spark, sf_dir).groupBy("conv_id").agg(*marks).select("conv_id", out.alias("language"))


_TERMS = ("and", "of", "is")
_CONV_LABELS = f"""
  WITH s AS (SELECT m // 1000000000 AS conv_id, m % 1000000000 AS turn, "start", "end", entity_type, value FROM ({needle_sql(_TERMS, _CONV, 'm', 'text')})),
  f AS (SELECT conv_id, value, min(turn * 1000000000 + "start") AS f FROM s GROUP BY 1, 2),
  r AS (SELECT conv_id, value, row_number() OVER (PARTITION BY conv_id ORDER BY f) AS k FROM f)
  SELECT s.*, '<Custom_' || k || '>' AS label FROM s JOIN r USING (conv_id, value)"""


def _conv_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    denied = _conversations(spark, sf_dir).withColumn("_d", D.once(D.deny_spans(F.col("text"), _TERMS)))
    found = denied.withColumn("_s", D.once(merge(F.col("_d"), F.col("text"))))
    return found.withColumn("_v", L.valued_spans(F.col("text"), F.col("_s"))).withColumn("pieces", D.once(L.label_pieces(F.col("_v"), F.lit("en")))).drop("_d", "_s", "_v")


@query(f"SELECT conv_id, turn, CAST(\"start\" AS BIGINT) AS \"start\", CAST(\"end\" AS BIGINT) AS \"end\", label, value FROM ({_CONV_LABELS})")
def conversation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.conversation_labels(_conv_pieces(spark, sf_dir), "conv_id", "turn", "pieces")
    return out.select("conv_id", "turn", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "label", "value")


@query(masked_sql(_CONV_LABELS, "conversations", "conv_id, turn"))
def conversation_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.mask_conversations(_conv_pieces(spark, sf_dir), "conv_id", "turn", "text", "pieces")


@query("SELECT CAST(doc_id AS VARCHAR) AS stream_id, text FROM documents")
def stream_restore_batch_twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = _masked(spark, sf_dir, ("EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD"))
    places = F.sequence(F.lit(0), F.floor(F.length("masked_text") / 97).cast("int"))
    chunks = masked.select(F.col("doc_id").cast("string").alias("stream_id"), "masked_text", "mapping", F.explode(places).alias("seq"))
    return ST.restore_batch(chunks.select("stream_id", "seq", F.substring(F.col("masked_text"), F.col("seq") * 97 + 1, F.lit(97)).alias("chunk"), "mapping"))


# ---- events


@query("SELECT event_id, event_type, user_id FROM events ORDER BY event_id DESC LIMIT 50")
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.latest(table(spark, sf_dir, "events"), "event_id").select("event_id", "event_type", "user_id")


# ---- literal cases: rows in, expected rows as SQL


def rows_query(names: list[str], schema: str, rows: list[tuple], columns: Callable[[], list[Column]], expected: list[tuple], out: list[str]) -> tuple[Query, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame(rows, schema).select(*names, *columns())

    return run, values([*names, *out], expected)


def _literal(name: str, *args) -> None:
    QUERIES[name], SQL[name] = rows_query(*args)


_CHECKED = [
    ("card", "4111111111111111", True), ("card", "4111-1111-1111-1111", True), ("card", "4111111111111112", False),
    ("my_number", "123456789018", True), ("my_number", "9876-5432-1093", True), ("my_number", "5555 5555 5557", True), ("my_number", "123456789019", False), ("my_number", "1234-5678-9012", False),
    ("ssn", "856-45-6780", True), ("ssn", "000-12-3456", False), ("ssn", "123-45-6789", False), ("ssn", "123.45-6789", False), ("ssn", "111-11-1111", False), ("ssn", "856-00-6780", False),
    ("iban", "DE89 3704 0044 0532 0130 00", True), ("iban", "DE89370400440532013000", True), ("iban", "DE89370400440532013001", False),
    ("ja_phone", "03-1234-5678", True), ("ja_phone", "021-14-3596", False),
]
_BY_KIND = {"card": V.luhn_valid, "my_number": V.my_number_valid, "ssn": V.ssn_valid, "iban": V.iban_valid, "ja_phone": V.ja_phone_valid}


def _valid() -> list[Column]:
    out: Column = F.lit(False)
    for kind, check in _BY_KIND.items():
        out = F.when(F.col("kind") == kind, check(F.col("value"))).otherwise(out)
    return [out.alias("valid")]


_literal("validators", ["kind", "value"], "kind string, value string", [r[:2] for r in _CHECKED], _valid, _CHECKED, ["valid"])

_PHONES = [
    ("en", "090-1234-5678", True), ("en", "0120-123-456", True), ("en", "03-1234-5678", True), ("en", "1090-1234-5678", False), ("en", "021-14-3596", False),
    ("en", "(333) 333-3333", True), ("en", "+1 333 333 3333", True), ("en", "333.333.3333", True), ("en", "1333-333-3333", False),
    ("es", "+34 612 345 678", True), ("es", "612-345-678", True), ("es", "91 234 56 78", True), ("es", "612345678", False),
    ("vi", "0912 345 678", True), ("vi", "+84912345678", True), ("en", "0912 345 678", False), ("zh", "138 0013 8000", True), ("zh", "010-12345678", True), ("zh", "213800138000", False),
    ("ko", "010-1234-5678", True), ("ko", "+82 10-1234-5678", True), ("ko", "02-312-3456", True), ("fr", "06 12 34 56 78", True), ("fr", "06 12 34 56 789", False),
    ("de", "030 901820", True), ("de", "+49 30 901820", True), ("de", "0711/123456", True), ("de", "030901820", False),
    ("pt", "912 345 678", True), ("pt", "+351912345678", True), ("pt", "912345678", False), ("it", "333 123 4567", True), ("it", "06 698212", True), ("it", "333123456789", False),
]
_literal(
    "phone_rules_by_language", ["language", "sample"], "language string, sample string", [r[:2] for r in _PHONES],
    lambda: [(F.size(D.detect_rules(F.col("sample"), F.col("language"), RU.rules_of(("PHONE_NUMBER",)))) > 0).alias("found")], _PHONES, ["found"],
)

_GUESSES = [
    ("山田さんに連絡", "ja"), ("ｶﾀｶﾅﾉﾐ", "ja"), ("山田さんは北京にいる", "ja"), ("请给我打电话", "zh"), ("전화해 주세요", "ko"), ("서울 kontakt", "ko"), ("Gọi cho tôi nhé", "vi"), ("Số điện thoại, ¿vale?", "vi"),
    ("¿Cómo estás?", "es"), ("größere Straße", "de"), ("informação não recebida", "pt"), ("ça marche très bien", "fr"), ("la città è però lontana", "it"), ("Call me maybe", "en"), ("", "en"),
]
_literal("guess_language_samples", ["text"], "text string", [r[:1] for r in _GUESSES], lambda: [G.guess_language(F.col("text")).alias("language")], _GUESSES, ["language"])

_TAGS = [("ja-JP", "ja"), ("EN-us", "en"), ("fr", "fr"), ("xx-YY", None), ("", None)]
_literal("language_from_tag", ["tag"], "tag string", [r[:1] for r in _TAGS], lambda: [G.language_from_tag(F.col("tag")).alias("language")], _TAGS, ["language"])

_LABELS = [
    ("<Email_1>", "Email", 1, None, "EMAIL_ADDRESS"), ("<Name_1_First_Name>", "Name", 1, "First_Name", "PERSON"), ("<A_1_2>", "A_1", 2, None, None), ("<Phone_12>", "Phone", 12, None, "PHONE_NUMBER"), ("Email_1", None, None, None, None), ("<Email>", None, None, None, None),
]
_literal(
    "parsed_labels", ["label"], "label string", [r[:1] for r in _LABELS],
    lambda: [X.parsed_label(F.col("label"))["prefix"].alias("prefix"), X.parsed_label(F.col("label"))["index"].cast("long").alias("index"), X.parsed_label(F.col("label"))["part"].alias("part"), X.classified_label(F.col("label"), "en").alias("entity_type")],
    _LABELS, ["prefix", "index", "part", "entity_type"],
)

_REPLIES = [("<Location_1> <Phone_1> <Email_1> <Name_1> <Name_2>", "Dear <Name_1>, <Name_2>, <Email_1>, <Phone_1>!"), ("<Email_2>", "Dear <Email_2>!")]
_literal("simulated_replies", ["text"], "text string", [r[:1] for r in _REPLIES], lambda: [X.simulated_reply(X.placeholders(F.col("text")), "en", "Dear {labels}!").alias("reply")], _REPLIES, ["reply"])

_SPAN_TYPE = "array<struct<start:int,end:int,entity_type:string,score:double>>"
_MERGES = [
    (1, "x" * 30, [(0, 10, "PERSON", 0.5), (5, 15, "LOCATION", 0.9)], [(0, 5, "PERSON", 0.5), (5, 15, "LOCATION", 0.9)]),
    (2, "x" * 30, [(0, 10, "LOCATION", 0.9), (2, 8, "PERSON", 0.5)], [(0, 10, "LOCATION", 0.9)]),
    (3, "x" * 30, [(0, 20, "LOCATION", 0.5), (8, 12, "JP_POSTAL_CODE", 1.0)], [(0, 8, "LOCATION", 0.5), (8, 12, "JP_POSTAL_CODE", 1.0), (12, 20, "LOCATION", 0.5)]),
    (4, "〒539-6608 福井県鴨川市", [(0, 15, "LOCATION", 0.85), (0, 9, "JP_POSTAL_CODE", 1.0)], [(0, 9, "JP_POSTAL_CODE", 1.0), (10, 15, "LOCATION", 0.85)]),
    (5, "no spans", [], []),
]


@query(values(["id", "start", "end", "entity_type", "score"], [(i, *s) for i, _, _, out in _MERGES for s in out]))
def merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([m[:3] for m in _MERGES], f"id long, text string, spans {_SPAN_TYPE}")
    out = rows.select("id", F.inline(merge(F.col("spans"), F.col("text"))))
    return out.select("id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "entity_type", "score")


_NAMES = [
    ("John Smith", False, [("first", 0, 4), ("last", 5, 10)]), ("John Michael Smith", False, [("first", 0, 4), ("middle", 5, 12), ("last", 13, 18)]), ("John Ronald Reuel Tolkien", False, [("first", 0, 4), ("middle", 5, 17), ("last", 18, 25)]),
    ("Vincent van Gogh", False, [("first", 0, 7), ("last", 8, 16)]), ("山田 太郎", True, [("last", 0, 2), ("first", 3, 5)]), ("Nguyễn Văn An", True, [("last", 0, 6), ("middle", 7, 10), ("first", 11, 13)]), ("John", False, []), ("  John  ", True, []), ("山田太郎", True, []),
]


@query(values(["source", "part", "start", "end"], [(n, *p) for n, _, out in _NAMES for p in out]))
def split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([n[:2] for n in _NAMES], "source string, family_first boolean")
    out = rows.select("source", F.inline(L.split_name_columns(F.col("source"), F.col("family_first"))))
    return out.select("source", "part", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


_VIEWS = [(1, "ﾔﾏﾀﾞ ﾀﾛｳ", "ja", "ヤマダ タロウ"), (2, "ｶﾀｶﾅ", "en", "ｶﾀｶﾅ"), (3, "cafe\u0301 090-1234-5678", "en", "caf\u00e9 090-1234-5678"), (4, "plain", "ja", "plain")]


@query(values(["id", "view"], [(v[0], v[3]) for v in _VIEWS]))
def normalized_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([v[:3] for v in _VIEWS], "id long, text string, language string")
    return rows.withColumn("_v", N.view_of(F.col("text"), F.col("language"))).select("id", F.col("_v.text").alias("view"))


@query(values(["id", "start", "end", "entity_type"], [(1, 0, 10, "PERSON"), (1, 25, 35, "PERSON"), (2, 0, 2, "PERSON")]))
def propagated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = [(1, "John Smith wrote to Ann. John Smith left.", [(0, 10, "PERSON", 0.9)]), (2, "An Anna Annex", [(0, 2, "PERSON", 0.8)])]
    rows = spark.createDataFrame(texts, f"id long, text string, spans {_SPAN_TYPE}")
    out = rows.select("id", F.inline(propagate(F.col("text"), F.col("spans"))))
    return out.select("id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "entity_type")


@query(values(["doc", "tag", "word", "score"], [(1, "PER", "JohnSmith", 0.75), (1, "LOC", "Paris", 0.5), (1, "PER", "Ann", 1.0), (1, "PER", "Bob", 0.5)]))
def grouped_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = [(1, 0, "B-PER", "John", 1.0), (1, 1, "I-PER", "Smith", 0.5), (1, 2, "O", "in", 1.0), (1, 3, "I-LOC", "Paris", 0.5), (1, 5, "I-PER", "Ann", 1.0), (1, 6, "B-PER", "Bob", 0.5)]
    rows = spark.createDataFrame(tokens, "doc long, index long, entity string, word string, score double")
    return NER.group_tokens(rows, "doc").select("doc", "tag", F.array_join("words", "").alias("word"), "score")


@query(values(["entity_type", "tp", "fp", "fn", "precision", "recall", "f1"], [("PERSON", 2, 0, 2, 1.0, 0.5, 2 / 3), ("LOCATION", 0, 1, 0, 0.0, 0.0, 0.0)]))
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = [(0, 4, "PERSON", 1.0)]
    cases = [(1, gold, [(0, 4, "PERSON", 1.0)]), (2, gold, [(0, 2, "PERSON", 1.0)]), (3, gold, [(0, 4, "LOCATION", 1.0)]), (4, gold, [])]
    rows = spark.createDataFrame([("ja", *c) for c in cases], f"language string, id long, gold {_SPAN_TYPE}, found {_SPAN_TYPE}")
    return E.with_rates(E.evaluate(rows, "gold", "found", ["language"])).drop("language")


@query(values(["stream", "seq", "data", "done"], [("a", 0, '{"x":1}', False), ("a", 1, "one\ntwo", False), ("a", 2, "[DONE]", True)]))
def sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("a", 'data: {"x":1}\n\ndata: one\ndata: two\n\ndata: [DONE]\n\n')], "stream string, body string")
    return RD.sse_frames(rows, "stream", "body").withColumn("seq", F.col("seq").cast("long"))


@query(values(["id", "turn", "role", "text", "corrupt"], [(1, 0, "user", "hello", False), (1, 1, "assistant", "one\ntwo", False), (2, None, None, None, True)]))
def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = '{"model":"m","messages":[{"role":"user","content":"hello"},{"role":"assistant","content":[{"type":"text","text":"one"},{"type":"image_url"},{"type":"text","text":"two"}]}]}'
    rows = RD.chat_requests(spark.createDataFrame([(1, body), (2, "{not json")], "id long, body string"), "id", "body")
    return rows.select("id", F.col("turn").cast("long").alias("turn"), "role", F.when(~F.col("corrupt"), RD.text_of_parts(F.col("parts"))).alias("text"), "corrupt")


@query(values(["id", "restored"], [(1, "John met John Smith"), (2, "value with <Other_1>")]))
def mapping_json_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "<Name_1_First_Name> met <Name_1>", '{"<Name_1>":"John Smith","<Name_1_First_Name>":"John"}'), (2, "<Email_1> with <Other_1>", '{"<Email_1>":"value"}')], "id long, text string, mapping string")
    return rows.select("id", R.restored(F.col("text"), RD.mapping_from_json(F.col("mapping"))).alias("restored"))


@query(values(["id", "result"], [(1, '{"text":"Mail <Email_1>","mapping":{"<Email_1>":"a@x.com"},"entities":[{"start":5,"end":12,"entity_type":"EMAIL_ADDRESS","score":0.9}]}')]))
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "Mail a@x.com")], "id long, text string")
    return WR.result_json(A.anonymize(rows, "text", A.AnonymizerConfig(entities=("EMAIL_ADDRESS",)))).select("id", "result")


# ---- the plan's other parts, on whole tables


_MIXED = "'cafe' || chr(769) || ' ' || chr(65398) || chr(65438) || ' u' || doc_id || '@x.com ' || text"


@query(rule_sql("email", f"(SELECT doc_id, {_MIXED} AS text FROM documents)"))
def offsets_of_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds found in the normalised view, which is shorter, in the original's offsets."""
    mixed = F.concat(F.lit("café ｶﾞ u"), F.col("doc_id").cast("string"), F.lit("@x.com "), F.col("text"))
    config = A.AnonymizerConfig(language="ja", entities=("EMAIL_ADDRESS",))
    return exploded(A.with_spans(table(spark, sf_dir, "documents").select("doc_id", mixed.alias("text")), "text", config), "doc_id", "_spans")


_LETTER = "Ann Lee wrote to u"


def _letter_model(text: Column, language: Column) -> Column:
    """A model's findings in a letter: a name, and a place that runs into an address."""
    return F.array(D.span(F.lit(0), F.lit(7), F.lit("PERSON"), F.lit(0.9)), D.span(F.lit(14), F.lit(18), F.lit("LOCATION"), F.lit(0.6)))


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.concat(F.lit(_LETTER), F.col("doc_id").cast("string"), F.lit("@x.com on day "), F.col("doc_id").cast("string"), F.lit(". Ann Lee left."))
    return table(spark, sf_dir, "documents").select("doc_id", letter.alias("text"))


@query("SELECT doc_id, d AS dropped, '<Name_1> wrote ' || CASE WHEN d THEN 'to' ELSE '<Location_1>' END || ' <Email_1> on day ' || doc_id || '. <Name_1> left.' AS masked_text FROM documents, (VALUES (TRUE), (FALSE)) AS v(d)")
def model_findings_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's spans beside the rules': those that overlap an address are
    dropped or keep their rest, and names are masked wherever they recur."""
    out = [
        A.anonymize(_letters(spark, sf_dir), "text", A.AnonymizerConfig(language="en", detector=_letter_model, drop_model_overlaps=drop)).select("doc_id", F.lit(drop).alias("dropped"), "masked_text")
        for drop in (True, False)
    ]
    return out[0].unionByName(out[1])


_GROUPS = 3
_WORD = "[A-Za-z]{2,}"


@query(f"""
  WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS w FROM documents),
  a AS (SELECT *, strpos(text, w[1]) - 1 AS s1 FROM w WHERE len(w) >= {_GROUPS}),
  b AS (SELECT *, s1 + length(w[1]) + strpos(substr(text, s1 + length(w[1]) + 1), w[2]) - 1 AS s2 FROM a),
  c AS (SELECT *, s2 + length(w[2]) + strpos(substr(text, s2 + length(w[2]) + 1), w[3]) - 1 AS s3 FROM b)
  SELECT doc_id, CAST(unnest([s1, s2, s3]) AS BIGINT) AS "start", unnest(w[1:3]) AS value, unnest(['PERSON', 'LOCATION', 'PERSON']) AS entity_type FROM c""")
def model_groups_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups of a model, found again in each text in their order."""
    words = F.regexp_extract_all(F.col("text"), F.lit(_WORD), F.lit(0))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", words.alias("_w")).where(F.size("_w") >= _GROUPS)

    def group(i: int, tag: str) -> Column:
        word = F.col("_w")[i]
        cut = F.array(F.substring(word, 1, 1), F.concat(F.lit("##"), F.substr(word, F.lit(2))))
        return F.struct(cut.alias("words"), NER.entity_of_tag(F.lit(tag)).alias("entity_type"), F.lit(0.9).alias("score"))

    found = docs.withColumn("spans", NER.aligned_spans(F.col("text"), F.array(group(0, "PER"), group(1, "GPE"), group(2, "PERSON"))))
    return exploded(found).select("doc_id", "start", "value", "entity_type")


@query("""SELECT doc_id, '<Name_1_First_Name> <Name_1_Middle_Name> <Name_1_Last_Name> met <Name_1_Last_Name> ' || doc_id AS masked_text, 3 AS labels, 'Ann Mary Lee met Lee ' || doc_id AS restored_text FROM documents""")
def name_parts_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names labelled by part; a later single word takes its part's label."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Ann Mary Lee met Lee "), F.col("doc_id").cast("string")).alias("text"))

    def model(text: Column, language: Column) -> Column:
        return F.array(*[D.span(F.lit(low), F.lit(high), F.lit("PERSON"), F.lit(0.9)) for low, high in ((0, 12), (17, 20))])

    masked = A.deanonymize(A.anonymize(texts, "text", A.AnonymizerConfig(language="en", split_names=True, detector=model)))
    return masked.select("doc_id", "masked_text", F.size("mapping").alias("labels"), "restored_text")


@query(f"""
  SELECT doc_id, CAST(s AS BIGINT) AS "start", CAST(s + 8 AS BIGINT) AS "end", CAST(0.7 AS DOUBLE) AS score FROM (
    SELECT doc_id, 5 AS s FROM documents WHERE doc_id % 2 = 0)""")
def context_raised_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes whose score passes the threshold only behind a word of their type."""
    word = F.when(F.col("doc_id") % 2 == 0, F.lit("宛先は、")).otherwise(F.lit("番号は、"))
    code = F.format_string("%s %03d-%04d。", word, F.col("doc_id") % 1000, F.col("doc_id") % 10000)
    texts = table(spark, sf_dir, "documents").select("doc_id", code.alias("text"))
    config = A.AnonymizerConfig(language="ja", entities=("JP_POSTAL_CODE",), context=True)
    return exploded(A.with_spans(texts, "text", config), "doc_id", "_spans").select("doc_id", "start", "end", F.round("score", 6).alias("score")).where("score >= 0.4")


_TYPES = "(SELECT DISTINCT event_type FROM events UNION SELECT DISTINCT role FROM conversations UNION SELECT 'the' UNION SELECT 'de')"


@query(f"""
  SELECT doc_id, CAST(i - 1 AS BIGINT) AS "start", CAST(i - 1 + length(n) AS BIGINT) AS "end", 'CUSTOM' AS entity_type, CAST(1.0 AS DOUBLE) AS score, n AS value FROM (
    SELECT doc_id, text, n, unnest(range(1, length(text) + 1)) AS i FROM documents, {_TYPES} AS w(n) WHERE contains(text, n)) WHERE substr(text, i, length(n)) = n""")
def needle_table_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a table of strings."""
    listed = table(spark, sf_dir, "events").select(F.col("event_type").alias("n")).union(table(spark, sf_dir, "conversations").select("role")).union(spark.createDataFrame([("the",), ("de",)], "n string"))
    found = D.needle_spans(table(spark, sf_dir, "documents"), "doc_id", "text", listed, "n")
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "entity_type", "score", "value")


_ALL_TYPES = ("EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD")


@query("SELECT doc_id, text AS restored_text FROM documents")
def restored_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings saved twice under each document; the last one restores its text."""
    masked = _masked(spark, sf_dir, _ALL_TYPES)
    old = F.transform("mapping", lambda m: F.struct(m["label"].alias("label"), F.lit("old").alias("value")))
    saves = masked.select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("at"), F.col("mapping").alias("mapping")), F.struct(F.lit(0).alias("at"), old.alias("mapping")))).alias("s")).select("doc_id", "s.*")
    return R.restore_table(masked.select("doc_id", "masked_text"), R.latest_mappings(saves, ["doc_id"], "at"), ["doc_id"], "masked_text").select("doc_id", "restored_text")


@query("SELECT doc_id, c AS choice, text AS content, 'http://<Email_1>' AS url FROM documents, (VALUES (0), (1)) AS v(c)")
def completions_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of several choices restored, as strings and as lists of parts, of
    which only text parts change."""
    masked = _masked(spark, sf_dir, _ALL_TYPES)

    def part(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.alias("text"))

    plain = R.restored_completion(F.array(F.struct(F.col("masked_text").alias("content"))), F.col("mapping"))
    parts = R.restored_completion_parts(F.array(F.struct(F.array(part("text", F.col("masked_text")), part("image_url", F.lit("http://<Email_1>"))).alias("parts"))), F.col("mapping"))
    both = masked.select("doc_id", D.once(plain)[0].alias("_a"), D.once(parts)[0]["parts"].alias("_b"))
    rows = F.array(F.struct(F.lit(0).alias("choice"), F.col("_a.content").alias("content")), F.struct(F.lit(1).alias("choice"), F.col("_b")[0]["text"].alias("content")))
    return both.select("doc_id", F.col("_b")[1]["text"].alias("url"), F.inline(rows))


_HEAD = 10


@query(f"""
  SELECT conv_id, turn, choice, seq, chunk, done FROM (
    SELECT conv_id, turn, 0 AS choice, 0 AS seq, substr(text, 1, {_HEAD}) AS chunk, FALSE AS done FROM conversations
    UNION ALL SELECT conv_id, turn, 0, 1, substr(text, {_HEAD + 1}), TRUE FROM conversations
    UNION ALL SELECT conv_id, turn, 1, 0, text, TRUE FROM conversations)""")
def delta_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion frames of event streams: written, joined to bodies, parsed
    again, and their chunks numbered for each choice."""
    text = F.col("text")
    chunks = F.array(*[F.struct(F.lit(c).alias("choice"), F.lit(s).cast("long").alias("seq"), x.alias("text"), F.lit(last).alias("last")) for c, s, x, last in ((0, 0, F.substring(text, 1, _HEAD), False), (1, 1, text, False), (0, 2, F.substr(text, F.lit(_HEAD + 1)), True))])
    rows = _conversations(spark, sf_dir).select(F.struct("conv_id", "turn").alias("stream_id"), F.inline(chunks))
    bodies = WR.sse_body(WR.delta_frames(rows), "stream_id")
    found = RD.deltas(RD.sse_frames(bodies, "stream_id", "body"), "stream_id")
    return found.select("stream_id.*", F.col("choice").cast("int").alias("choice"), F.col("seq").cast("int").alias("seq"), "chunk", "done")


_STATUS = {"click": "anonymized", "view": "passthrough"}


@query("SELECT count(*) AS total, count(*) FILTER (event_type = 'click') AS anonymized, count(*) FILTER (event_type = 'view') AS passthrough, count(*) FILTER (event_type = 'error') AS errors FROM events")
def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv])[F.col("event_type")]
    return EV.counters(table(spark, sf_dir, "events").select(F.coalesce(status, "event_type").alias("status")), "status")


@query('SELECT event_id, value > 5 AS "hasMapping" FROM events ORDER BY event_id DESC LIMIT 100')
def event_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More rows are asked for than a listing may have; mappings show as a flag only."""
    events = table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") > 5, F.col("props")).alias("mapping"))
    return EV.latest(events, "event_id", 500)
