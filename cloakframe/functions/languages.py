"""Languages, their label words and their detection classes: data only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language codes in display order, and those loaded by default.
LANGUAGES = ("ja", "en", "es", "vi", "zh", "ko", "fr", "de", "pt", "it")
DEFAULT_LANGUAGES = ("en", "ja")
#: Languages that put the family name first.
FAMILY_NAME_FIRST = ("ja", "vi", "zh", "ko")
AUTO = "auto"

#: Entity types by default, on request, and without a model.
DEFAULT_ENTITIES = ("PERSON", "EMAIL_ADDRESS", "LOCATION", "PHONE_NUMBER", "JP_POSTAL_CODE", "JP_MY_NUMBER", "CREDIT_CARD")
OPTIONAL_ENTITIES = ("US_SSN", "IBAN_CODE")
STRUCTURED_ENTITIES = ("EMAIL_ADDRESS", "PHONE_NUMBER", "JP_POSTAL_CODE", "JP_MY_NUMBER", "CREDIT_CARD")
CUSTOM = "CUSTOM"
NAME_PARTS = {"first": "PERSON_FIRST_NAME", "middle": "PERSON_MIDDLE_NAME", "last": "PERSON_LAST_NAME"}
LABEL_KEYS = (
    "PERSON", "PERSON_FIRST_NAME", "PERSON_MIDDLE_NAME", "PERSON_LAST_NAME", "EMAIL_ADDRESS", "LOCATION", "PHONE_NUMBER",
    "JP_POSTAL_CODE", "JP_MY_NUMBER", "CREDIT_CARD", "US_SSN", "IBAN_CODE", "CUSTOM",
)

#: The word of each label key.
LABEL_WORDS: dict[str, dict[str, str]] = {
    "ja": {
        "PERSON": "人名", "PERSON_FIRST_NAME": "名", "PERSON_MIDDLE_NAME": "ミドルネーム", "PERSON_LAST_NAME": "姓",
        "EMAIL_ADDRESS": "メールアドレス", "LOCATION": "住所", "PHONE_NUMBER": "電話番号", "JP_POSTAL_CODE": "郵便番号",
        "JP_MY_NUMBER": "マイナンバー", "CREDIT_CARD": "クレジットカード", "US_SSN": "社会保障番号", "IBAN_CODE": "IBAN",
        "CUSTOM": "秘匿情報",
    },
    "en": {
        "PERSON": "Name", "PERSON_FIRST_NAME": "First_Name", "PERSON_MIDDLE_NAME": "Middle_Name", "PERSON_LAST_NAME": "Last_Name",
        "EMAIL_ADDRESS": "Email", "LOCATION": "Location", "PHONE_NUMBER": "Phone", "JP_POSTAL_CODE": "PostalCode",
        "JP_MY_NUMBER": "MyNumber", "CREDIT_CARD": "CreditCard", "US_SSN": "SSN", "IBAN_CODE": "IBAN",
        "CUSTOM": "Custom",
    },
    "es": {
        "PERSON": "Nombre", "PERSON_FIRST_NAME": "Nombre", "PERSON_MIDDLE_NAME": "SegundoNombre", "PERSON_LAST_NAME": "Apellido",
        "EMAIL_ADDRESS": "Correo", "LOCATION": "Dirección", "PHONE_NUMBER": "Teléfono", "JP_POSTAL_CODE": "CódigoPostal",
        "JP_MY_NUMBER": "MyNumber", "CREDIT_CARD": "Tarjeta", "US_SSN": "SSN", "IBAN_CODE": "IBAN",
        "CUSTOM": "Personalizado",
    },
    "vi": {
        "PERSON": "Tên", "PERSON_FIRST_NAME": "Tên", "PERSON_MIDDLE_NAME": "TênĐệm", "PERSON_LAST_NAME": "Họ",
        "EMAIL_ADDRESS": "Email", "LOCATION": "ĐịaChỉ", "PHONE_NUMBER": "SốĐiệnThoại", "JP_POSTAL_CODE": "MãBưuĐiện",
        "JP_MY_NUMBER": "MyNumber", "CREDIT_CARD": "ThẻTínDụng", "US_SSN": "SSN", "IBAN_CODE": "IBAN",
        "CUSTOM": "TùyChỉnh",
    },
    "zh": {
        "PERSON": "姓名", "PERSON_FIRST_NAME": "名", "PERSON_MIDDLE_NAME": "中间名", "PERSON_LAST_NAME": "姓",
        "EMAIL_ADDRESS": "电子邮箱", "LOCATION": "地址", "PHONE_NUMBER": "电话号码", "JP_POSTAL_CODE": "邮政编码",
        "JP_MY_NUMBER": "MyNumber", "CREDIT_CARD": "信用卡", "US_SSN": "SSN", "IBAN_CODE": "IBAN",
        "CUSTOM": "自定义",
    },
    "ko": {
        "PERSON": "이름", "PERSON_FIRST_NAME": "이름", "PERSON_MIDDLE_NAME": "중간이름", "PERSON_LAST_NAME": "성",
        "EMAIL_ADDRESS": "이메일", "LOCATION": "주소", "PHONE_NUMBER": "전화번호", "JP_POSTAL_CODE": "우편번호",
        "JP_MY_NUMBER": "MyNumber", "CREDIT_CARD": "신용카드", "US_SSN": "SSN", "IBAN_CODE": "IBAN",
        "CUSTOM": "사용자지정",
    },
    "fr": {
        "PERSON": "Nom", "PERSON_FIRST_NAME": "Prénom", "PERSON_MIDDLE_NAME": "DeuxièmePrénom", "PERSON_LAST_NAME": "NomDeFamille",
        "EMAIL_ADDRESS": "Email", "LOCATION": "Adresse", "PHONE_NUMBER": "Téléphone", "JP_POSTAL_CODE": "CodePostal",
        "JP_MY_NUMBER": "MyNumber", "CREDIT_CARD": "CarteBancaire", "US_SSN": "SSN", "IBAN_CODE": "IBAN",
        "CUSTOM": "Personnalisé",
    },
    "de": {
        "PERSON": "Name", "PERSON_FIRST_NAME": "Vorname", "PERSON_MIDDLE_NAME": "Zweitname", "PERSON_LAST_NAME": "Nachname",
        "EMAIL_ADDRESS": "EMail", "LOCATION": "Adresse", "PHONE_NUMBER": "Telefon", "JP_POSTAL_CODE": "Postleitzahl",
        "JP_MY_NUMBER": "MyNumber", "CREDIT_CARD": "Kreditkarte", "US_SSN": "SSN", "IBAN_CODE": "IBAN",
        "CUSTOM": "Benutzerdefiniert",
    },
    "pt": {
        "PERSON": "Nome", "PERSON_FIRST_NAME": "PrimeiroNome", "PERSON_MIDDLE_NAME": "NomeDoMeio", "PERSON_LAST_NAME": "Sobrenome",
        "EMAIL_ADDRESS": "Email", "LOCATION": "Endereço", "PHONE_NUMBER": "Telefone", "JP_POSTAL_CODE": "CódigoPostal",
        "JP_MY_NUMBER": "MyNumber", "CREDIT_CARD": "CartãoDeCrédito", "US_SSN": "SSN", "IBAN_CODE": "IBAN",
        "CUSTOM": "Personalizado",
    },
    "it": {
        "PERSON": "Nome", "PERSON_FIRST_NAME": "Nome", "PERSON_MIDDLE_NAME": "SecondoNome", "PERSON_LAST_NAME": "Cognome",
        "EMAIL_ADDRESS": "Email", "LOCATION": "Indirizzo", "PHONE_NUMBER": "Telefono", "JP_POSTAL_CODE": "CodicePostale",
        "JP_MY_NUMBER": "MyNumber", "CREDIT_CARD": "CartaDiCredito", "US_SSN": "SSN", "IBAN_CODE": "IBAN",
        "CUSTOM": "Personalizzato",
    },
}

#: Character classes that tell a language, first match wins.
LANGUAGE_CLASSES = (
    ("ja", "[぀-ヿ｡-ﾟ]"),
    ("ko", "[가-힣ᄀ-ᇿ]"),
    ("zh", "[一-鿿]"),
    ("vi", "[ăâđơưĂÂĐƠƯẠ-ỹ]"),
    ("de", "[ßäöÄÖẞ]"),
    ("pt", "[ãõÃÕ]"),
    ("es", "[¿¡ñÑ]"),
    ("fr", "[œŒêîûëïçÇÊÎÛËÏ]"),
    ("it", "[èòìàùÈÒÌÀÙ]"),
    ("es", "[áéíóúüÁÉÍÓÚÜ]"),
)


class UnsupportedLanguageError(ValueError):
    """A language code outside ``LANGUAGES``."""


def check_language(code: str) -> str:
    if code not in LANGUAGES and code != AUTO:
        raise UnsupportedLanguageError(f"language {code!r} is not one of {', '.join(LANGUAGES)}")
    return code


def label_words(language: str) -> dict[str, str]:
    """Label key -> word."""
    check_language(language)
    return LABEL_WORDS[language]


def guess_language(text: Column) -> Column:
    """The first language whose characters occur in the raw text, else en.

    All of them lie beyond ASCII, so plain texts are looked at once, and others
    by their few characters beyond it."""

    def told(rest: Column) -> Column:
        out = F.lit("en")
        for code, characters in reversed(LANGUAGE_CLASSES):
            out = F.when(rest.rlike(characters), F.lit(code)).otherwise(out)
        return out

    rest = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.get(F.transform(F.array(rest), told), F.lit(0))).otherwise(F.lit("en"))


def guess_language_sql(text: str) -> str:
    """The same in DuckDB SQL."""
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{c}') THEN '{code}'" for code, c in LANGUAGE_CLASSES) + " ELSE 'en' END"


def language_from_tag(tag: Column) -> Column:
    """The supported language of a BCP 47 tag, else null."""
    code = F.substring_index(F.lower(tag), "-", 1)
    return F.when(code.isin(*LANGUAGES), code)


def per_language(language: Column, key: Column) -> Column:
    """Word of a label key in a row's language; a key without a word stays."""
    words = F.create_map(*[F.lit(x) for lang in LANGUAGES for k, w in label_words(lang).items() for x in (f"{lang} {k}", w)])
    return F.coalesce(words[F.concat(language, F.lit(" "), key)], key)


def family_first(language: Column) -> Column:
    return language.isin(*FAMILY_NAME_FIRST)
