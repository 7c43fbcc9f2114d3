"""The catalogue of detection rules: pattern, score, languages and check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from ..functions import validators as V


#: What every match of a rule on numbers holds: seven digits close together.
SEVEN_DIGITS = r"[0-9](?:[ ./()-]{0,2}[0-9]){6}"


@dataclass(frozen=True)
class Rule:
    """``needs`` is a character or pattern that every match holds; it gates the
    rule. ``languages`` empty: all. ``check`` says which matches stand."""

    name: str
    entity_type: str
    pattern: str
    score: float
    languages: tuple[str, ...] = ()
    check: Callable[[Column], Column] | None = None
    needs: str = SEVEN_DIGITS


#: Patterns, scores, languages, in the order that breaks ties.
RULES: tuple[Rule, ...] = (
    Rule("email", "EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0.9, needs="@"),
    Rule("jp_mobile", "PHONE_NUMBER", r"(?<!\d)0[789]0[-( ]?\d{4}[-) ]?\d{4}(?!\d)", 0.7),
    Rule("jp_toll_free", "PHONE_NUMBER", r"(?<!\d)0120[- ]?\d{3}[- ]?\d{3}(?!\d)", 0.7),
    Rule("jp_landline", "PHONE_NUMBER", r"(?<!\d)0\d{1,4}[-(]\d{1,4}[-)]\d{4}(?!\d)", 0.6, check=V.ja_phone_valid),
    Rule("us_phone", "PHONE_NUMBER", r"(?<!\d)(?:\+1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)", 0.6),
    Rule("es_prefixed", "PHONE_NUMBER", r"(?<!\d)\+34[ .-]?[6789]\d{2}[ .-]?\d{3}[ .-]?\d{3}(?!\d)", 0.6, ("es",)),
    Rule("es_grouped", "PHONE_NUMBER", r"(?<!\d)[6789]\d{2}[ .-]\d{3}[ .-]\d{3}(?!\d)", 0.6, ("es",)),
    Rule("es_landline", "PHONE_NUMBER", r"(?<!\d)[89]\d[ .-]\d{3}[ .-]\d{2}[ .-]\d{2}(?!\d)", 0.5, ("es",)),
    Rule("vi_domestic", "PHONE_NUMBER", r"(?<!\d)0(?:\d{2}[ .-]?\d{3}[ .-]?\d{4}|\d{3}[ .-]?\d{3}[ .-]?\d{3}|\d{2}[ .-]?\d{4}[ .-]?\d{4})(?!\d)", 0.6, ("vi",)),
    Rule("vi_prefixed", "PHONE_NUMBER", r"(?<!\d)\+84[ .-]?(?:\d{2}[ .-]?\d{3}[ .-]?\d{4}|\d{3}[ .-]?\d{3}[ .-]?\d{3}|\d{2}[ .-]?\d{4}[ .-]?\d{4})(?!\d)", 0.6, ("vi",)),
    Rule("zh_mobile", "PHONE_NUMBER", r"(?<!\d)(?:\+86[ .-]?)?1[3-9]\d[ .-]?\d{4}[ .-]?\d{4}(?!\d)", 0.6, ("zh",)),
    Rule("zh_landline", "PHONE_NUMBER", r"(?<!\d)(?:\+86[ .-]?)?0\d{2,3}[ .-]\d{7,8}(?!\d)", 0.5, ("zh",)),
    Rule("ko_mobile", "PHONE_NUMBER", r"(?<!\d)01[016789][ .-]?\d{3,4}[ .-]?\d{4}(?!\d)", 0.6, ("ko",)),
    Rule("ko_prefixed", "PHONE_NUMBER", r"(?<!\d)\+82[ .-]?1[016789][ .-]?\d{3,4}[ .-]?\d{4}(?!\d)", 0.6, ("ko",)),
    Rule("ko_landline", "PHONE_NUMBER", r"(?<!\d)0(?:2|[3-6]\d)[ .-]\d{3,4}[ .-]\d{4}(?!\d)", 0.5, ("ko",)),
    Rule("fr_phone", "PHONE_NUMBER", r"(?<!\d)(?:\+33[ .-]?[1-9]|0[1-9])(?:[ .-]?\d{2}){4}(?!\d)", 0.6, ("fr",)),
    Rule("de_prefixed", "PHONE_NUMBER", r"(?<!\d)\+49[ .-]?\d{2,4}[ /.-]?\d{4,8}(?!\d)", 0.6, ("de",)),
    Rule("de_domestic", "PHONE_NUMBER", r"(?<!\d)0\d{2,4}[ /.-]\d{4,8}(?!\d)", 0.5, ("de",)),
    Rule("pt_prefixed", "PHONE_NUMBER", r"(?<!\d)\+351[ .-]?(?:9[1236]\d|2\d{2})[ .-]?\d{3}[ .-]?\d{3}(?!\d)", 0.6, ("pt",)),
    Rule("pt_grouped", "PHONE_NUMBER", r"(?<!\d)(?:9[1236]\d|2\d{2})[ .-]\d{3}[ .-]\d{3}(?!\d)", 0.6, ("pt",)),
    Rule("it_mobile", "PHONE_NUMBER", r"(?<!\d)(?:\+39[ .-]?)?3\d{2}[ .-]\d{3}[ .-]\d{3,4}(?!\d)", 0.6, ("it",)),
    Rule("it_prefixed", "PHONE_NUMBER", r"(?<!\d)\+39[ .-]?3\d{2}[ .-]?\d{6,7}(?!\d)", 0.6, ("it",)),
    Rule("it_landline", "PHONE_NUMBER", r"(?<!\d)0\d{1,3}[ .-]\d{5,8}(?!\d)", 0.5, ("it",)),
    Rule("postal_marked", "JP_POSTAL_CODE", r"〒[\s　\x{a0}\x{feff}]?\d{3}-?\d{4}", 0.9, needs="〒"),
    Rule("postal_bare", "JP_POSTAL_CODE", r"(?<![\d-])\d{3}-\d{4}(?![\d-])", 0.35, ("ja",)),
    Rule("my_number", "JP_MY_NUMBER", r"(?<![\d-])\d{4}[- ]?\d{4}[- ]?\d{4}(?![\d-])", 0.7, check=V.my_number_valid),
    Rule("card", "CREDIT_CARD", r"(?<![\d-])(?!1\d{12}(?!\d))(?:4\d{3}|5[0-5]\d{2}|6\d{3}|1\d{3}|3\d{3})[- ]?\d{3,4}[- ]?\d{3,4}[- ]?\d{3,5}(?![\d-])", 1.0, check=V.luhn_valid),
    Rule("ssn", "US_SSN", r"(?<![\d.-])\d{3}[- .]\d{2}[- .]\d{4}(?![\d.-])", 0.5, check=V.ssn_valid),
    Rule("iban", "IBAN_CODE", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 1.0, check=V.iban_valid, needs="[A-Z]{2}[0-9]{2}"),
)

#: Scores of the model-free scan profile where they differ; the
#: checked types score as after their check.
SCAN_SCORES = {"jp_mobile": 0.6, "jp_toll_free": 0.6, "jp_landline": 0.5, "postal_bare": 0.3, "my_number": 1.0}

#: Words near a value that speak for its type.
CONTEXT_WORDS: dict[str, list[str]] = {
    "PHONE_NUMBER": ["電話", "電話番号", "携帯", "TEL", "Tel", "連絡先", "phone", "mobile"],
    "JP_POSTAL_CODE": ["郵便番号", "郵便", "住所", "宛先", "所在地", "〒", "postal", "zip"],
    "JP_MY_NUMBER": ["マイナンバー", "個人番号", "my number", "individual number"],
    "CREDIT_CARD": ["クレジットカード", "カード番号", "カード", "クレカ", "支払い"],
}


def rules_of(entities: tuple[str, ...] | None = None, languages: tuple[str, ...] | None = None, least: float = 0.0, profile: str = "rules") -> tuple[Rule, ...]:
    """Rules that can still yield something; the rest never reaches the plan.

    ``profile`` is ``rules`` or ``scan`` (the other table of scores).
    """
    if profile not in ("rules", "scan"):
        raise ValueError(f"profile {profile!r} is neither rules nor scan")
    out = []
    for r in RULES:
        score = SCAN_SCORES.get(r.name, r.score) if profile == "scan" else r.score
        if (entities is None or r.entity_type in entities) and (languages is None or not r.languages or set(r.languages) & set(languages)) and score >= least:
            out.append(Rule(r.name, r.entity_type, r.pattern, score, r.languages, r.check, r.needs))
    return tuple(out)
