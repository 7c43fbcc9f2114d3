"""Checks of matched values as Columns: check digits, shapes, invalid ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_of(value: Column, drop: str = "- ") -> Column:
    return F.translate(value, drop, "")


def _digit(text: Column, place: int) -> Column:
    return F.substring(text, place, 1).cast("int")


def luhn_valid(value: Column) -> Column:
    """12 to 19 digits with a valid Luhn check digit."""
    d = digits_of(value)
    return d.rlike("^[0-9]{12,19}$") & F.call_function("luhn_check", d)


def my_number_check_digit(body: Column) -> Column:
    """Check digit of an 11-digit body; null for anything else."""
    # Weights from the left.
    weights = [6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2]
    rest = sum((_digit(body, i + 1) * w for i, w in enumerate(weights)), F.lit(0)) % 11
    return F.when(body.rlike("^[0-9]{11}$"), F.when(rest <= 1, F.lit(0)).otherwise(11 - rest))


def my_number_valid(value: Column) -> Column:
    d = digits_of(value)
    shaped = F.when(d.rlike("^[0-9]{12}$"), d)
    return F.coalesce(my_number_check_digit(F.substring(shaped, 1, 11)) == _digit(shaped, 12), F.lit(False))


def ssn_valid(value: Column) -> Column:
    """Nine digits, one kind of delimiter, and no number that is never issued."""
    marks = F.regexp_replace(value, "[0-9]", "")
    d = F.regexp_replace(value, "[^0-9]", "")
    alike = F.length(F.replace(marks, F.substring(marks, 1, 1), F.lit(""))) == 0
    # Prefixes that are never issued.
    never = ["000", "666", "123456789", "98765432", "078051120"]
    prefixed = F.lit(False)
    for p in never:
        prefixed = prefixed | d.startswith(p)
    same = F.length(F.replace(d, F.substring(d, 1, 1), F.lit(""))) == 0
    return (F.length(d) == 9) & ((F.length(marks) == 0) | alike) & ~same & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000") & ~prefixed


#: Total lengths by country, as registered.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def iban_valid(value: Column) -> Column:
    """A registered country with its length; remainder 1 modulo 97."""
    v = digits_of(value)
    turned = F.concat(F.substr(v, F.lit(5)), F.substring(v, 1, 4))
    codes = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(codes, F.lit(0), lambda a, c: F.when(c > 9, a * 100 + c).otherwise(a * 10 + c) % 97)
    sizes: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        sizes.setdefault(n, []).append(country)
    shape = "|".join(f"(?:{'|'.join(c)})[0-9]{{2}}[A-Z0-9]{{{n - 4}}}" for n, c in sorted(sizes.items()))
    return F.when(v.rlike(f"^(?:{shape})$"), rest == 1).otherwise(F.lit(False))


def ja_phone_valid(value: Column) -> Column:
    """10 or 11 digits."""
    return F.length(F.regexp_replace(value, "[^0-9]", "")).isin(10, 11)
