"""Command line: anonymize, scan, deanonymize, version.

Exit codes: 0 done or clean, 1 personal data found (scan) or a failed run, 2 a
wrong call. A scan prints places and types, never the matched text.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions.languages import AUTO, DEFAULT_ENTITIES, LANGUAGES, UnsupportedLanguageError
from .operators import scan as S
from .plans import anonymizer as A
from .sources import readers as RD

DONE, FOUND, WRONG = 0, 1, 2


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="cloakframe", description="Mask, find and restore personal data.")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, *, files: bool) -> argparse.ArgumentParser:
        one = commands.add_parser(name)
        one.add_argument("--text", "-t")
        if files:
            one.add_argument("files", nargs="*")
        else:
            one.add_argument("--file", "-f")
        return one

    mask = command("anonymize", files=False)
    mask.add_argument("--language", "-l", default="en", choices=[*LANGUAGES, AUTO])
    mask.add_argument("--entities", help="types, separated by commas")
    mask.add_argument("--json", action="store_true")
    mask.add_argument("--split-names", action="store_true")
    mask.add_argument("--mapping-file", help="write the mapping, which holds the originals, to this file")
    mask.add_argument("--interactive", "-i", action="store_true", help="review the result before it is printed")
    find = command("scan", files=True)
    find.add_argument("--language", "-l", default=AUTO, choices=[*LANGUAGES, AUTO])
    find.add_argument("--deny", action="append", default=[])
    find.add_argument("--allow", action="append", default=[])
    find.add_argument("--json", action="store_true")
    back = command("deanonymize", files=False)
    back.add_argument("--mapping-file", required=True)
    commands.add_parser("version")
    return out


def _input(spark: SparkSession, text: str | None, paths: list[str]) -> DataFrame:
    """One text or files; neither: standard input."""
    if text is None and not paths:
        text = sys.stdin.read()
        return RD.literal_text(spark, text, "<stdin>")
    paths = [os.path.abspath(p) for p in paths if not os.path.isdir(p)]  # directories are skipped
    if text is None and not paths:
        return RD.literal_text(spark, "", "").limit(0)
    return RD.one_input(spark, text, paths)


def _session() -> SparkSession:
    return SparkSession.builder.master(os.environ.get("SPARK_MASTER", "local[*]")).config("spark.ui.enabled", "false").getOrCreate()


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; returns the exit code."""
    try:
        given = parser().parse_args(argv)
    except SystemExit as e:
        return DONE if not e.code else WRONG
    if given.command == "version":
        print(__version__)
        return DONE
    try:
        return {"anonymize": _anonymize, "scan": _scan, "deanonymize": _deanonymize}[given.command](given, spark or _session())
    except (UnsupportedLanguageError, ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return WRONG


def _anonymize(given: argparse.Namespace, spark: SparkSession) -> int:
    entities = tuple(e.strip() for e in given.entities.split(",") if e.strip()) if given.entities else DEFAULT_ENTITIES
    config = A.AnonymizerConfig(language=given.language, entities=entities, split_names=given.split_names)
    row = A.anonymize(_input(spark, given.text, [given.file] if given.file else []), "text", config).first()
    mapping = {m["label"]: m["value"] for m in row["mapping"]}
    if given.interactive:
        print(f"== Original ==\n{row['text']}\n\n== Anonymized ==\n{row['masked_text']}\n\n== Mapping ==")
        for label, value in mapping.items():
            print(f"  {label} -> {value}")
        if input("Use this result? Detection isn't perfect. (Y)es, (n)o > ").strip() != "Y":
            print("aborted", file=sys.stderr)
            return WRONG
    if given.mapping_file:
        with open(given.mapping_file, "w", encoding="utf-8") as f:
            json.dump(mapping, f, ensure_ascii=False, indent=2)
    if given.json:
        print(json.dumps({"text": row["masked_text"], "mapping": mapping, "entities": [e.asDict() for e in row["entities"]]}, ensure_ascii=False, indent=2))
    else:
        print(row["masked_text"])
    return DONE


def _scan(given: argparse.Namespace, spark: SparkSession) -> int:
    config = A.AnonymizerConfig(language=given.language, profile="scan", deny_list=tuple(given.deny), allow_list=tuple(given.allow))
    inputs = _input(spark, given.text, given.files)
    if not inputs.where(F.col("text").isNull()).isEmpty():
        raise ValueError("an input isn't UTF-8 text")
    found, count = A.scan(inputs, "name", "text", config), inputs.count()
    rows = found.orderBy("file", "start").collect()
    if given.json:
        print(json.dumps({"findings": [r.asDict() for r in rows], "inputs": count}, ensure_ascii=False))
    else:
        for r in S.report_lines(found.orderBy("file", "start")).collect():
            print(r["line"])
    print(f"{len(rows)} finding(s) in {len({r['file'] for r in rows})} of {count} input(s)", file=sys.stderr)
    return FOUND if rows else DONE


def _deanonymize(given: argparse.Namespace, spark: SparkSession) -> int:
    with open(given.mapping_file, encoding="utf-8") as f:
        mapping = json.load(f)
    if not isinstance(mapping, dict):
        raise ValueError("the mapping must be an object of labels and values")
    rows = _input(spark, given.text, [given.file] if given.file else [])
    pairs = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).alias("value")) for k, v in mapping.items()]).cast("array<struct<label:string,value:string>>")
    print(A.deanonymize(rows.select(F.col("text").alias("masked_text"), pairs.alias("mapping"))).first()["restored_text"])
    return DONE


if __name__ == "__main__":
    raise SystemExit(main())
