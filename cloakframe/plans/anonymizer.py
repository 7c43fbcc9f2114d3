"""The whole plan: detect, resolve overlaps, label, and back again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.languages import AUTO, DEFAULT_ENTITIES, DEFAULT_LANGUAGES, LANGUAGE_CLASSES, LANGUAGES, OPTIONAL_ENTITIES, STRUCTURED_ENTITIES, UnsupportedLanguageError, check_language, guess_language
from ..functions.normalize import detect_view, needs_view, to_original, view_of
from ..operators import detect as D
from ..operators import labels as L
from ..operators import restore as R
from ..operators import scan as S
from ..operators.rules import rules_of
from ..operators.spans import merge, propagate

#: A model as a Column: text and language to an array of spans.
Detector = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class AnonymizerConfig:
    """Options of a plan.

    ``language`` is a code or ``auto``; ``language_col`` names a column instead.
    ``profile`` is ``rules`` or ``scan`` (model-free scores, and deny-listed
    values are masked even if allowed). ``drop_model_overlaps`` drops a model's
    spans that overlap structured ones; otherwise their rests stay masked.
    ``context`` raises the scores of spans that have a word of their type nearby.
    ``normalize`` looks for values in the detection view of texts that need one.
    """

    languages: tuple[str, ...] = LANGUAGES
    language: str = AUTO
    language_col: str | None = None
    entities: tuple[str, ...] = DEFAULT_ENTITIES
    deny_list: tuple[str, ...] = ()
    allow_list: tuple[str, ...] = ()
    threshold: float = D.THRESHOLD
    split_names: bool = False
    profile: str = "rules"
    detector: Detector | None = None
    context: bool = False
    drop_model_overlaps: bool = False
    normalize: bool = True

    def __post_init__(self) -> None:
        check_language(self.language)
        for code in self.languages:
            check_language(code)
        if self.language != AUTO and self.language not in self.languages:
            raise UnsupportedLanguageError(f"language {self.language!r} is not loaded")

    def language_of(self, text: Column) -> Column:
        if self.language_col is not None:
            return F.coalesce(F.col(self.language_col), guess_language(text))
        return guess_language(text) if self.language == AUTO else F.lit(self.language)


def unused(name: str, taken: list[str]) -> str:
    """``name``, with underscores appended until no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


_STEPS = ("_text", "_lang", "_view", "_ruled", "_denied", "_found", "_model", "_kept", "_spans", "_valued")


def with_spans(df: DataFrame, text: str, config: AnonymizerConfig = AnonymizerConfig(), names: dict[str, str] | None = None) -> DataFrame:
    """``df`` with _text (null as empty), _lang and _spans (merged, in the
    original's offsets); ``names`` are other names for them.

    Narrow and one scan. Of rows whose view may differ the text goes through
    Arrow, of others a null; of all rows if there is a model, whose values are
    propagated to their repeats.
    """
    n = names or {c: unused(c, df.columns) for c in _STEPS}
    entities = tuple(e for e in config.entities if e in STRUCTURED_ENTITIES + OPTIONAL_ENTITIES) if config.profile == "scan" else config.entities
    rules = rules_of(entities, config.languages, 0.0 if config.context else config.threshold, config.profile)
    base = df.withColumn(n["_text"], F.coalesce(F.col(text).cast("string"), F.lit("")))
    base = base.withColumn(n["_lang"], D.once(config.language_of(F.col(n["_text"]))))
    raw, language = F.col(n["_text"]), F.col(n["_lang"])
    allow = tuple({v for a in config.allow_list for v in (a, detect_view(a)[0])})

    view, back, needles = raw, None, config.deny_list
    if config.normalize:
        base = base.withColumn(n["_view"], view_of(F.when(needs_view(raw, language), raw), language))
        view, back, needles = F.coalesce(F.col(n["_view"])["text"], raw), F.col(n["_view"]), tuple(detect_view(x)[0] for x in config.deny_list)
    ruled, denied = D.detect_rules(view, language, rules), D.deny_spans(view, needles)
    if config.context:
        ruled = D.boosted(ruled, view)
    found = base.withColumns({n["_ruled"]: D.once(ruled), n["_denied"]: D.once(denied)})
    own, listed = F.col(n["_ruled"]), F.col(n["_denied"])
    if back is not None:
        own, listed = to_original(own, back), to_original(listed, back)
    if config.profile == "scan":
        own = D.not_allowed(own, raw, allow)
    plain = found.withColumn(n["_found"], D.once(F.concat(own, listed)))
    hits = F.col(n["_found"])
    if config.detector is not None:
        with_model = plain.withColumn(n["_model"], D.once(D.of_types(config.detector(raw, language), config.entities)))
        kept = D.outside_of(F.col(n["_model"]), hits) if config.drop_model_overlaps else F.col(n["_model"])
        plain = with_model.withColumn(n["_found"], D.once(F.concat(hits, kept))).withColumn(n["_found"], propagate(raw, hits))
    final = D.at_least(hits, config.threshold)
    if config.profile != "scan":
        final = D.not_allowed(final, raw, allow)
    kept = plain.withColumn(n["_kept"], D.once(final))
    out = kept.withColumn(n["_spans"], D.once(merge(F.col(n["_kept"]), raw)))
    return out.drop(*[n[c] for c in ("_view", "_ruled", "_denied", "_found", "_model", "_kept")])


def anonymize(df: DataFrame, text: str = "text", config: AnonymizerConfig = AnonymizerConfig()) -> DataFrame:
    """``df`` with masked_text, mapping (ordered array(label, value)), entities
    (spans) and pieces. Labels are per row; no shuffle.

    A null text stays null and has no entities. All columns of ``df`` stay as
    they are; where it has columns of these names, the new ones get underscores
    appended. Filters on other columns belong before this step.
    """
    n = {c: unused(c, df.columns) for c in _STEPS}
    out = {c: unused(c, df.columns) for c in ("masked_text", "mapping", "entities", "pieces")}
    found = with_spans(df, text, config, n)
    if config.split_names:
        labelled = L.with_split_labels(found, n["_text"], n["_spans"], n["_lang"], out["pieces"], out["mapping"])
    else:
        valued = found.withColumn(n["_valued"], L.valued_spans(F.col(n["_text"]), F.col(n["_spans"])))
        labelled = valued.withColumn(out["pieces"], D.once(L.label_pieces(F.col(n["_valued"]), F.col(n["_lang"]))))
        labelled = labelled.withColumn(out["mapping"], L.mapping_of(F.col(out["pieces"])))
    masked = F.when(F.col(text).isNotNull(), L.spliced(F.col(n["_text"]), F.col(out["pieces"])))
    done = labelled.withColumns({out["masked_text"]: masked, out["entities"]: F.col(n["_spans"])})
    return done.drop(*[n[c] for c in ("_text", "_lang", "_spans", "_valued")])


def deanonymize(df: DataFrame, text: str = "masked_text", mapping: str = "mapping") -> DataFrame:
    """``df`` with restored_text."""
    return df.withColumn("restored_text", R.restored(F.col(text), F.col(mapping)))


def scan(df: DataFrame, name: str, text: str = "text", config: AnonymizerConfig = AnonymizerConfig(profile="scan")) -> DataFrame:
    """Findings of all texts: places, types and scores, never the values."""
    rows = df.select(F.col(name).alias("file"), F.col(text).alias("text"), *([config.language_col] if config.language_col else []))
    return S.findings(with_spans(rows, "text", config), "file", "text", "_spans")


def anonymize_conversations(df: DataFrame, conv: str, turn: str, text: str, config: AnonymizerConfig = AnonymizerConfig()) -> DataFrame:
    """(conv, turn, masked_text): one label for a value in a whole conversation.

    With language ``auto`` a conversation has one language, that of its texts
    together; it follows from the classes that its messages hold, so that
    messages needn't be gathered.
    """
    texts = df.select(F.col(conv), F.col(turn), F.col(text))
    if config.language_col is not None:
        texts = df.select(F.col(conv), F.col(turn), F.col(text), F.col(config.language_col))
    elif config.language == AUTO:
        spoken = unused("_spoken", df.columns)
        marks = [F.max(F.coalesce(F.col(text).rlike(c), F.lit(False))).alias(f"_m{i}") for i, (_, c) in enumerate(LANGUAGE_CLASSES)]
        language = F.lit("en")
        for i, (code, _) in reversed(list(enumerate(LANGUAGE_CLASSES))):
            language = F.when(F.col(f"_m{i}"), F.lit(code)).otherwise(language)
        texts = texts.join(df.groupBy(conv).agg(*marks).select(conv, language.alias(spoken)), conv)
        config = replace(config, language_col=spoken)
    masked = anonymize(texts, text, config)
    return L.mask_conversations(masked, conv, turn, text, "pieces")


def anonymize_parts(df: DataFrame, conv: str, turn: str, parts: str, config: AnonymizerConfig = AnonymizerConfig()) -> DataFrame:
    """(conv, turn, parts) of messages whose content is array(struct(type, text)):
    each text part is masked by itself, with one label for a value in a whole
    conversation; parts are numbered in order, and others stay as they are."""
    at, one = unused("_at", df.columns), unused("_part", df.columns)
    rows = df.select(F.col(conv), F.col(turn), F.posexplode(parts).alias(at, one))
    rows = rows.withColumn("_message_part", F.struct(F.col(turn).alias("t"), F.col(at).alias("p")))
    texts = rows.select(F.col(conv), "_message_part", F.when(F.col(one)["type"] == "text", F.col(one)["text"]).alias("_text_of"))
    masked = anonymize_conversations(texts, conv, "_message_part", "_text_of", config)
    joined = rows.join(masked, [conv, "_message_part"], "left").withColumn("_new", F.when(F.col(one)["type"] == "text", F.col(one).withField("text", F.col("masked_text"))).otherwise(F.col(one)))
    return joined.groupBy(conv, turn).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("i"), F.col("_new").alias("p")))).alias("_all")).select(conv, turn, F.transform("_all", lambda x: x["p"]).alias(parts))


def patched(config: AnonymizerConfig, patch: dict[str, object]) -> AnonymizerConfig:
    """``config`` with some options changed; ValueError names the first that is
    unknown or of the wrong type."""
    if not isinstance(patch, dict):
        raise ValueError("a patch must be an object")
    known, made = {f.name: f for f in fields(AnonymizerConfig)}, {}
    for name, value in patch.items():
        if name not in known or name == "detector":
            raise ValueError(f"{name!r} is no option that can be changed")
        old = known[name].default
        if isinstance(old, tuple):
            if not isinstance(value, (list, tuple)) or any(not isinstance(v, str) for v in value):
                raise ValueError(f"{name} must be a list of strings")
            value = tuple(value)
        elif isinstance(old, bool) != isinstance(value, bool) or not isinstance(value, (bool, str, float, int) if old is not None else (str, type(None))):
            raise ValueError(f"{name} must be {'a boolean' if isinstance(old, bool) else 'a string' if old is None or isinstance(old, str) else 'a number'}")
        elif isinstance(old, str) != isinstance(value, str) and old is not None:
            raise ValueError(f"{name} must be {'a string' if isinstance(old, str) else 'a number'}")
        made[name] = value
    return replace(config, **made)


def preview_then_upgrade(df: DataFrame, text: str, config: AnonymizerConfig, write: Callable[[DataFrame, str], None]) -> str:
    """Write the result of the rules alone as "preview" first, then that with
    the model as "final"; if the model fails, the preview stands. Returns which
    of the two was written last."""
    write(anonymize(df, text, replace(config, detector=None)), "preview")
    if config.detector is None:
        return "preview"
    try:
        write(anonymize(df, text, config), "final")
    except PySparkException:
        return "preview"
    return "final"


__all__ = ["DEFAULT_LANGUAGES", "AnonymizerConfig", "anonymize", "anonymize_conversations", "anonymize_parts", "deanonymize", "patched", "preview_then_upgrade", "scan", "unused", "with_spans"]
