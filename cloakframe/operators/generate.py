"""Seeded evaluation cases with known spans: any number, made on the executors.

A case is a text in one of three genres (in turn) with invented personal data;
its spans and, of names, the spans of their parts are known by construction. A
case follows from (seed, language, number) alone, whatever the partitions. Every
value with check digits is valid.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.languages import FAMILY_NAME_FIRST, LANGUAGES, NAME_PARTS, check_language

#: The genres, in turn, and the default seed and number of cases.
GENRES = ("request", "minutes", "support")
SEED, COUNT = 20260705, 200

#: Given names, family names and places, of our own choice.
NAMES: dict[str, tuple[list[str], list[str], list[str]]] = {
    "ja": (["花子", "健太", "美咲", "大輔"], ["佐藤", "鈴木", "高橋", "渡辺"], ["東京都港区", "大阪府堺市", "札幌市", "那覇市"]),
    "en": (["Olivia", "Henry", "Grace", "Walter"], ["Parker", "Hughes", "Bennett", "Fletcher"], ["Boston", "Leeds", "Denver", "Perth"]),
    "es": (["Lucía", "Mateo", "Carmen", "Diego"], ["García", "Romero", "Navarro", "Ortega"], ["Sevilla", "Bilbao", "Lima", "Murcia"]),
    "vi": (["An", "Linh", "Minh", "Hoa"], ["Nguyễn", "Trần", "Phạm", "Đặng"], ["Hà Nội", "Huế", "Đà Nẵng", "Cần Thơ"]),
    "zh": (["伟", "芳", "小明", "静"], ["王", "李", "陈", "赵"], ["北京市", "成都市", "杭州市", "广州市"]),
    "ko": (["민준", "서연", "지우", "하은"], ["김", "이", "박", "최"], ["서울", "부산", "대전", "제주"]),
    "fr": (["Camille", "Hugo", "Élise", "Louis"], ["Moreau", "Lefèvre", "Garnier", "Roux"], ["Lyon", "Lille", "Nantes", "Genève"]),
    "de": (["Jürgen", "Anna", "Felix", "Katrin"], ["Schäfer", "Becker", "Krüger", "Vogel"], ["Köln", "Bremen", "Graz", "Leipzig"]),
    "pt": (["João", "Beatriz", "Tiago", "Inês"], ["Carvalho", "Teixeira", "Moura", "Simões"], ["Porto", "Coimbra", "Braga", "Recife"]),
    "it": (["Giulia", "Marco", "Chiara", "Paolo"], ["Ricci", "Esposito", "Colombo", "Ferrari"], ["Torino", "Bari", "Pisa", "Verona"]),
}

#: Phone numbers by language: # is a digit, [..] one of some, ^ a digit from 1.
PHONES: dict[str, list[str]] = {
    "ja": ["0[789]0-^###-^###", "0120-^##-^##", "03-^###-^###"],
    "en": ["([23456789]0^) [23456789]##-^###", "+1 [23456789]0^ [23456789]## ^###"],
    "es": ["[67]^# ^## ^##", "+34 [67]^# ^## ^##", "9[12345678] ^## ^# ^#"],
    "vi": ["0[35789]^# ^## ^##", "+84 [35789]^# ^## ^##", "0[35789]^ ^## ^###"],
    "zh": ["1[3456789]# #### ####", "+86 1[3456789]#-####-####"],
    "ko": ["010-^###-^###", "+82 10-^###-^###"],
    "fr": ["0[167] ## ## ## ##", "+33 [167] ## ## ## ##"],
    "de": ["01[567]# ^######", "+49 ^## ^######"],
    "pt": ["9[1236]# ^## ^##", "+351 9[1236]# ^## ^##", "2^# ^## ^##"],
    "it": ["3^# ^## ^###", "+39 3^# ^## ^###", "0[23456789] ^#####"],
}

#: Texts by genre, of our own wording; {..} are slots.
TEXTS: dict[str, tuple[str, str, str]] = {
    "ja": ("こんにちは、{person}です。{city}でお会いしましょう。電話は {phone} 、メールは {email} です。", "出席: {person}、{person}。送付先は {postal} {city}。資料は {email} へ、直通 {phone} 。口座 {iban} 。", "{person} 様の登録は {city} です。折り返し {phone} 、カード {card} 、番号 {my_number} 、控え {email} 。"),
    "en": ("Hello, this is {person}. Let us meet in {city}. Call {phone} or write to {email} today.", "Present: {person}, {person}. Place: {city}. Slides to {email} please, direct line {phone} only. SSN {ssn} and account {iban} are on file.", "Customer {person} lives in {city}. Their phone is {phone} and the card is {card} with mail {email} too."),
    "es": ("Hola, soy {person}. ¿Nos vemos en {city}? Mi teléfono es {phone} y mi correo {email} siempre.", "Asisten {person} y {person}. Lugar: {city}. Enviar a {email} o llamar al {phone} mañana. Cuenta {iban} ¡gracias!", "El cliente {person} vive en {city}. Su número es {phone} y la tarjeta {card} con correo {email} ¿correcto?"),
    "vi": ("Chào bạn, tôi là {person}. Hẹn gặp ở {city}. Số điện thoại {phone} và thư {email} nhé.", "Có mặt: {person}, {person}. Địa điểm {city}. Gửi tới {email} hoặc gọi {phone} nhé. Tài khoản {iban} đây.", "Khách hàng {person} ở {city}. Điện thoại {phone} và thẻ {card} với thư {email} nhé."),
    "zh": ("您好,我是 {person} 。我们在 {city} 见面。电话 {phone} ,邮箱 {email} 。", "出席: {person} 、 {person} 。地点 {city} 。资料发到 {email} ,电话 {phone} ,账户 {iban} 。", "客户 {person} 住在 {city} 。电话 {phone} ,卡号 {card} ,邮箱 {email} 。"),
    "ko": ("안녕하세요, {person} 입니다. {city} 에서 만나요. 전화 {phone} 메일 {email} 입니다.", "참석: {person} , {person} . 장소 {city} . 자료는 {email} 로, 전화 {phone} , 계좌 {iban} 입니다.", "고객 {person} 님은 {city} 에 삽니다. 전화 {phone} , 카드 {card} , 메일 {email} 입니다."),
    "fr": ("Bonjour, ici {person}. Ça vous dit de se voir à {city} ? Appelez le {phone} ou écrivez à {email} svp.", "Présents : {person} et {person}. Réunion à {city}, ça va. Envoyer à {email} ou appeler le {phone} demain. Compte {iban} reçu.", "Le client {person} habite à {city}. Reçu : téléphone {phone} et carte {card} avec adresse {email} ça."),
    "de": ("Grüß Gott, hier ist {person}. Treffen wir uns in {city}? Telefon {phone} oder Mail {email} bitte.", "Anwesend: {person} und {person}. Nächstes Mal in {city}. Unterlagen an {email} und Rückruf {phone} bitte. Konto {iban} prüfen.", "Kundin {person} wohnt in {city}. Für Rückfragen {phone} und Karte {card} mit Mail {email} bitte."),
    "pt": ("Olá, sou {person}. A reunião é em {city}. O meu número é {phone} e o correio {email} então.", "Presentes: {person} e {person}. Reunião em {city}. Enviar para {email} ou ligar {phone} amanhã. Conta {iban} então.", "O cliente {person} mora em {city}. Não esquecer {phone} e o cartão {card} com correio {email} então."),
    "it": ("Salve, sono {person}. Ci vediamo a {city}, è bello. Il telefono è {phone} e la posta {email} sempre.", "Presenti: {person} e {person}. La riunione è a {city}. Inviare a {email} o chiamare {phone} però. Conto {iban} è noto.", "Il cliente {person} abita a {city}. Il numero è {phone} e la carta {card} con posta {email} però."),
}

ENTITY = {"city": "LOCATION", "phone": "PHONE_NUMBER", "email": "EMAIL_ADDRESS", "postal": "JP_POSTAL_CODE", "card": "CREDIT_CARD", "my_number": "JP_MY_NUMBER", "ssn": "US_SSN", "iban": "IBAN_CODE"}


def drawn(rng: random.Random, shape: str) -> str:
    """A string of a shape as in ``PHONES``."""
    spots = re.findall(r"\[([^\]]+)\]|(.)", shape)
    return "".join(rng.choice(some) if some else rng.choice("0123456789") if c == "#" else rng.choice("123456789") if c == "^" else c for some, c in spots)


def _grouped(rng: random.Random, value: str, mark: str) -> str:
    return mark.join(value[i : i + 4] for i in range(0, len(value), 4)) if rng.random() < 0.5 else value


def check_digit(body: str) -> int:
    """Luhn check digit of a body of digits."""
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body)))
    return -total % 10


def my_number(rng: random.Random) -> str:
    """Twelve digits of which the last follows from the others by weights."""
    body = drawn(rng, "#" * 11)
    rest = sum(int(c) * w for c, w in zip(reversed(body), [2, 3, 4, 5, 6, 7, 2, 3, 4, 5, 6], strict=True)) % 11
    return _grouped(rng, body + str(0 if rest < 2 else 11 - rest), "-")


def iban(rng: random.Random) -> str:
    """A German account number whose check digits make the remainder 1."""
    body = drawn(rng, "#" * 18)
    return _grouped(rng, f"DE{98 - int(body + '131400') % 97:02d}{body}", " ")


def ssn(rng: random.Random) -> str:
    """A number that may be issued: no 000, 666 or 9xx, no 00, no 0000."""
    while True:
        value = drawn(rng, "[12345678]##-#^-^###")
        if not value.startswith(("666", "123-45-6789", "987-65-432", "078-05-1120")):
            return value


def person(rng: random.Random, language: str) -> list[tuple[str, str]]:
    """Parts of a name of words, in the language's order; some have a middle one."""
    given, family, _ = NAMES[language]
    first, last = rng.choice(given), rng.choice(family)
    middle = [("middle", rng.choice(given))] if rng.random() < 0.2 else []
    return [("last", last), *middle, ("first", first)] if language in FAMILY_NAME_FIRST else [("first", first), *middle, ("last", last)]


def case_of(language: str, number: int, seed: int) -> tuple[str, str, str, str, list[dict]]:
    """(id, language, genre, text, spans) of one case."""
    rng = random.Random(f"{seed} {language} {number}")
    genre = number % len(GENRES)
    out, at, spans = [], 0, []

    def put(text: str, entity: str | None = None) -> None:
        nonlocal at
        if entity is not None:
            spans.append({"start": at, "end": at + len(text), "entity_type": entity, "value": text})
        out.append(text)
        at += len(text)

    for plain, slot in re.findall(r"([^{]+)|\{(\w+)\}", TEXTS[language][genre]):
        if plain:
            put(plain)
        elif slot == "person":
            parts = person(rng, language)
            name = " ".join(v for _, v in parts)
            spans.append({"start": at, "end": at + len(name), "entity_type": "PERSON", "value": name})
            for i, (part, value) in enumerate(parts):
                put(" " * (i > 0))
                put(value, NAME_PARTS[part])
        else:
            card = drawn(rng, "4" + "#" * 14)
            made = {
                "city": lambda: rng.choice(NAMES[language][2]), "phone": lambda: drawn(rng, rng.choice(PHONES[language])), "email": lambda: f"{drawn(rng, '[abcdefgh][aeiou][klmnprst]')}{rng.randint(1, 99)}@example.{rng.choice(['com', 'org', 'net'])}",
                "postal": lambda: "〒" + drawn(rng, "^##-####"), "card": lambda: _grouped(rng, card + str(check_digit(card)), "-"), "my_number": lambda: my_number(rng), "ssn": lambda: ssn(rng), "iban": lambda: iban(rng),
            }
            put(made[slot](), ENTITY[slot])
    return f"{language}-{number:05d}", language, GENRES[genre], "".join(out), spans


CASES = "id string, language string, genre string, text string, spans array<struct<start:int,end:int,entity_type:string,value:string>>"


def generate_cases(spark: SparkSession, languages: tuple[str, ...] = LANGUAGES, count: int = COUNT, seed: int = SEED) -> DataFrame:
    """(id, language, genre, text, spans): ``count`` cases of each language."""
    for code in languages:
        check_language(code)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity_type", pa.string()), ("value", pa.string())])
    codes = tuple(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [case_of(codes[i // count], i % count, seed) for i in batch.column(0).to_pylist()]
            columns = list(zip(*made, strict=True)) or [()] * 5
            types = [pa.string()] * 4 + [pa.list_(span)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "language", "genre", "text", "spans"])

    return spark.range(len(codes) * count).mapInArrow(run, CASES)


def samples(spark: SparkSession, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """(language, text): one paragraph with personal data for each language."""
    return generate_cases(spark, languages, 1).select("language", "text")
