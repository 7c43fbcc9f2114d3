"""Secret scans by a linear-chain conditional random field (operator 8).

Base patterns find assignments, access keys and long hexadecimal runs. A
conditional random field then tags every token (run of bytes outside space and
U+0009 to U+000D) as begin of a secret, inside one, or outside, from its shape,
its neighbours' shapes and features of the whole file, decoded by Viterbi. Its
spans come on top where they overlap no base span.

What it is fitted on: about ``sample`` documents, chosen by seeded hashes of
their ids. Windows of their tokens get planted secrets of many forms (random
values of several alphabets, bare, quoted, behind key words, behind prefixes,
in connection strings, in armoured blocks) or planted harmless strings that
look alike (links, dates, paths, names in code, numbers, rules of dashes);
others stay as they are. Matches of the base patterns count as secrets (at most
``PER_DOCUMENT`` windows of a document), and in half of all windows the features
that tell those patterns (hexadecimal run, key word) are masked. So the field
learns what random values look like rather than the patterns. The texts may hold
secrets that nobody marked: windows in which a first fit takes an unmarked token
for one are left out of the second.

Decoding is exact: a secret in the best sequence scores more than the same
tokens outside. Tokens over which no stretch can do so, by a bound of its
transitions, are outside in every best sequence, and Viterbi runs between them.

Defined results: null and empty texts have no spans; null ids are scanned but
not learnt from; without a document of some tokens the field adds nothing. Repeated rows
get equal results; an empty table gives an empty table; extra columns are
ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, sampled

#: The base patterns, their least lengths, and their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
KINDS = ["assign", "access", "hex", "crf"]
#: What stands in every assignment, in small letters.
MARKS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Documents that the field is fitted on, about.
SAMPLE = 500
#: Tokens of a training window, base windows of one document, least windows in
#: all (few documents give more each), and steps of the fit.
WINDOW, PER_DOCUMENT, LEAST_WINDOWS, STEPS = 24, 4, 1200, 100
#: Probability of outside below which the first fit doubts an unmarked token.
DOUBT = 0.95
FEATURES, FILE_FEATURES = 1 << 11, 8
OUT, BEGIN, INSIDE = 0, 1, 2
KNOWN_TOKENS = 400_000
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, in order."""
    found = []
    folded = text.lower()
    if any(m in folded for m in MARKS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _slot(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % FEATURES


_SLOTS: dict[str, int] = {}


#: A byte's kind: small letter (and beyond ASCII), capital, digit, or itself.
_KINDS = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 57 if 48 <= c <= 57 else c for c in range(256))
_HEX_TOKEN = re.compile(rb"[^0-9a-zA-Z]*[0-9a-fA-F]{8,}[^0-9a-zA-Z]*")
_MARKED = re.compile("|".join(MARKS).encode(), re.IGNORECASE)


_LOWER_RUN = re.compile(rb"[a-z\x80-\xff]+")
_LETTERS = re.compile(rb"[A-Za-z]")
_VOWELS = bytes(c for c in range(256) if chr(c) not in "aeiouyAEIOUY")
_CREDENTIAL = re.compile(rb"[a-z0-9+]+://[^/@:\s]*:[^/@\s]+@")
#: Tokens from this length on are looked at for how random they are.
LOOKED_AT = 8

Shape = tuple[bytes, bool, bytes, tuple[int, ...]]


def randomness(token: bytes) -> tuple[int, ...]:
    """How random a token looks: shares of distinct bytes and of vowels among
    letters, its longest run of small letters, kinds of characters, and
    whether it is a link, or one with a password."""
    if len(token) < LOOKED_AT:
        return ()
    letters = len(_LETTERS.findall(token))
    vowels = len(token.translate(None, _VOWELS))
    run = max(map(len, _LOWER_RUN.findall(token)), default=0)
    kinds = token.translate(_KINDS)
    groups = (b"a" in kinds) + 2 * (b"A" in kinds) + 4 * (b"9" in kinds)
    link = 2 if _CREDENTIAL.search(token) else 1 if b"://" in token or b"www." in token else 0
    return len(set(token)) * 8 // len(token), vowels * 8 // max(1, letters) if letters > 3 else 9, min(7, run // 2), groups, link, min(3, token.count(b"/")), min(5, token.count(b"-")), min(3, token.count(b"."))


def shape_of(token: bytes) -> Shape:
    """All that a token's features depend on: kinds of its bytes, whether it is
    a hexadecimal run, which word of an assignment stands in it, and how random
    it looks."""
    mark = _MARKED.search(token)
    return token.translate(_KINDS), _HEX_TOKEN.fullmatch(token) is not None, mark[0].lower() if mark else b"", randomness(token)


#: Places of the features that tell the base patterns.
BASE_NAMES = (0, 1)


def shape_features(shape: Shape) -> list[int]:
    """Feature slots of a token's shape."""
    kinds, is_hex, mark, odd = shape
    core = kinds.strip(b"\"'`,;()[]{}")
    n = max(1, len(core))
    changes = sum(a != b for a, b in zip(core, core[1:], strict=False)) / n
    squeezed = bytes(k for i, k in enumerate(core) if not i or k != core[i - 1])[:6].decode("latin1")
    size = min(12, len(core) // 4)
    names = [
        f"hex {is_hex}", f"key {mark.decode()}",
        f"length {min(9, len(core).bit_length())}", f"long {size}", f"digits {int(core.count(b'9') / n * 6)}", f"capitals {int(core.count(b'A') / n * 6)}", f"changes {int(changes * 6)} {min(3, size // 2)}",
        f"shape {squeezed}", f"quoted {kinds[:1] in (b'"', b"'")}", f"equals {b'=' in core}", f"ends {kinds[-1:] in (b':', b'=')}", f"fence {kinds[:4] == b'----'} {kinds[-4:] == b'----'}",
        f"mark {kinds.decode('latin1') if len(kinds) < 3 and not kinds.isalnum() else ''}",
        *([f"distinct {odd[0]} {min(3, size // 2)}", f"vowels {odd[1]} {min(3, size // 2)}", f"run {odd[2]}", f"groups {odd[3]} {min(3, size // 2)}", f"link {odd[4]}", f"marks {odd[5]} {odd[6]} {odd[7]}"] if odd else [f"plain {i}" for i in range(6)]),
    ]
    out = []
    for name in names:
        slot = _SLOTS.get(name)
        if slot is None:
            slot = _SLOTS[name] = _slot(name)
        out.append(slot)
    return out


N_NAMES = len(shape_features((b"a", False, b"", ())))


def file_features(text: bytes, n_tokens: int) -> np.ndarray:
    """Features of the whole text."""
    lines = text.count(b"\n") + 1
    marks = text.count(b"=") + text.count(b"{") + text.count(b";")
    return np.array([1.0, np.log1p(n_tokens) / 10, min(1.0, marks / lines), b"=" in text, b'"' in text, b"#" in text, n_tokens < 50, n_tokens > 1000], float)


@dataclass(frozen=True)
class Field:
    """Weights: of a token's own, the one before and the one after (slots x 3
    tags each), of the file (features x 3) and of transitions (3 x 3)."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    file: np.ndarray
    moves: np.ndarray


def _forbid(moves: np.ndarray) -> np.ndarray:
    """Inside never follows outside: such a token begins a secret."""
    moves = moves.copy()
    moves[OUT, INSIDE] = -30.0
    return moves


def fit_field(slots: np.ndarray, files: np.ndarray, tags: np.ndarray, steps: int = STEPS, decay: float = 1e-5) -> tuple[Field, np.ndarray]:
    """Maximum likelihood by Adam over windows: ``slots`` (n, w, names), -1
    beyond a document's edge; ``files`` (n, features); ``tags`` (n, w), -1 there.
    Returns the field, and each tag's probability at each place."""
    n, w, _ = slots.shape
    inside = tags >= 0
    # most tokens share their slots with others: weights are summed once for each kind
    rows, row_of = np.unique(np.where(slots < 0, FEATURES, slots).reshape(n * w, -1), axis=0, return_inverse=True)
    rows, row_of = np.concatenate([rows, np.full((1, rows.shape[1]), FEATURES)]), row_of.reshape(n, w)
    edge = np.full((n, 1), len(rows) - 1)
    views = [row_of, np.concatenate([edge, row_of[:, :-1]], 1), np.concatenate([row_of[:, 1:], edge], 1)]
    weights = [np.zeros((FEATURES + 1, 3)) for _ in views] + [np.zeros((files.shape[1], 3)), np.zeros((3, 3))]
    first = [np.zeros_like(p) for p in weights]
    second = [np.zeros_like(p) for p in weights]
    gold = np.zeros((n, w, 3))
    at = np.nonzero(inside)
    gold[(*at, tags[at])] = 1
    both = inside[:, 1:] & inside[:, :-1]
    pairs = np.zeros((3, 3))
    np.add.at(pairs, (tags[:, :-1][both], tags[:, 1:][both]), 1)
    for t in range(1, steps + 1):
        moves = _forbid(weights[4])
        emit = sum(weights[k][rows].sum(1)[views[k]] for k in range(3)) + (files @ weights[3])[:, None, :]
        emit = np.where(inside[..., None], emit, 0.0)
        alpha = np.zeros((n, w, 3))
        beta = np.zeros((n, w, 3))
        alpha[:, 0] = emit[:, 0]
        alpha[:, 0, INSIDE] -= 30.0
        for i in range(1, w):
            step = np.logaddexp.reduce(alpha[:, i - 1, :, None] + moves, axis=1) + emit[:, i]
            alpha[:, i] = np.where(both[:, i - 1, None], step, alpha[:, i - 1])
        for i in range(w - 2, -1, -1):
            step = np.logaddexp.reduce(moves + (emit[:, i + 1] + beta[:, i + 1])[:, None, :], axis=2)
            beta[:, i] = np.where(both[:, i, None], step, beta[:, i + 1])
        whole = np.logaddexp.reduce(alpha[:, -1], axis=1)
        p = np.where(inside[..., None], np.exp(alpha + beta - whole[:, None, None]), 0.0)
        p = p / np.maximum(p.sum(2, keepdims=True), 1e-300) * inside[..., None]
        joint = np.exp(alpha[:, :-1, :, None] + moves + (emit + beta)[:, 1:, None, :] - whole[:, None, None, None])
        seen = (joint * both[..., None, None]).sum((0, 1))
        gap = (p - gold) / n
        slopes = []
        for k in range(3):
            s = np.zeros((FEATURES + 1, 3))
            for c in range(3):
                of_row = np.bincount(views[k].ravel(), gap[..., c].ravel(), len(rows))
                s[:, c] = np.bincount(rows.ravel(), np.repeat(of_row, rows.shape[1]), FEATURES + 1)
            s[FEATURES] = 0
            slopes.append(s + decay * weights[k])
        slopes += [files.T @ gap.sum(1) + decay * weights[3], (seen - pairs) / n + decay * weights[4]]
        for i, s in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * s
            second[i] = 0.999 * second[i] + 0.001 * s * s
            weights[i] = weights[i] - 0.05 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return Field(*(x[:FEATURES] for x in weights[:3]), weights[3], np.clip(_forbid(weights[4]), -30, 30)), p


def viterbi(emit: np.ndarray, moves: np.ndarray, start: int | None = OUT, end: int | None = OUT) -> list[int]:
    """Best tags of tokens with scores ``emit`` (n, 3), between neighbours of
    tags ``start`` and ``end`` (None: the text's edge, where inside can't start)."""
    score = emit[0] + (moves[start] if start is not None else np.array([0.0, 0.0, -30.0]))
    back = []
    for e in emit[1:]:
        step = score[:, None] + moves
        back.append(step.argmax(0))
        score = step.max(0) + e
    if end is not None:
        score = score + moves[:, end]
    tags = [int(score.argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


class Tagger:
    """A worker's field with the scores of the tokens it has met."""

    def __init__(self, field: Field):
        self.field = field
        # what a token of a secret can gain over outside by its transitions, at most
        allowed = np.delete(field.moves.ravel(), OUT * 3 + INSIDE)
        self.gain = 2 * max(0.0, float(allowed.max() - field.moves[OUT, OUT]))
        self.shapes: dict[Shape, int] = {}
        self.at: dict[bytes, int] = {}
        self.scores = np.zeros((1024, 9))

    def __call__(self, token: bytes) -> int:
        """Row of the token's scores."""
        shape = shape_of(token)
        i = self.shapes.get(shape)
        if i is None:
            i = len(self.shapes)
            if i == len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            slots = shape_features(shape)
            f = self.field
            self.scores[i] = np.concatenate([f.own[slots].sum(0), f.before[slots].sum(0), f.after[slots].sum(0)])
            self.shapes[shape] = i
        if len(token) <= 64:
            self.at[token] = i
        return i

    def emissions(self, tokens: list[bytes], file: np.ndarray) -> np.ndarray:
        if len(self.at) > KNOWN_TOKENS or len(self.shapes) > KNOWN_TOKENS // 4:
            self.at.clear()
            self.shapes.clear()
        known, add = self.at.get, self
        rows = np.array([i if (i := known(t)) is not None else add(t) for t in tokens])
        s = self.scores[rows]
        emit = s[:, :3] + file @ self.field.file
        emit[1:] += s[:-1, 3:6]
        emit[:-1] += s[1:, 6:]
        return emit

    def tags(self, tokens: list[bytes], file: np.ndarray) -> list[tuple[int, list[int]]]:
        """(place, tags) of the stretches in which a token may be a secret's."""
        emit = self.emissions(tokens, file)
        most = np.concatenate([[0.0], np.cumsum(emit[:, 1:].max(1) - emit[:, OUT] + self.gain)])
        # the most that a stretch over each token can gain over outside
        reach = np.maximum.accumulate(most[:0:-1])[::-1] - np.minimum.accumulate(most[:-1])
        unsure = np.flatnonzero(reach >= -1e-9)
        out = []
        if len(unsure):
            cuts = np.flatnonzero(np.diff(unsure) > 1) + 1
            for part in np.split(unsure, cuts):
                a, b = int(part[0]), int(part[-1]) + 1
                out.append((a, viterbi(emit[a:b], self.field.moves, OUT if a else None, OUT if b < len(tokens) else None)))
        return out


def field_spans(text: str, tagger: Tagger) -> list[tuple[int, int]]:
    """(start, end) of the secrets that the field finds, in code points."""
    raw = text.encode()
    tokens = raw.split()
    if not tokens:
        return []
    stretches = [(a, tags) for a, tags in tagger.tags(tokens, file_features(raw, len(tokens))) if any(tags)]
    if not stretches:
        return []
    spots = [m.span() for m in _WORD.finditer(raw)]
    out: list[tuple[int, int]] = []
    for a, tags in stretches:
        start = None
        for k, tag in enumerate([*tags, OUT]):
            if start is not None and tag != INSIDE:
                out.append((spots[a + start][0], spots[a + k - 1][1]))
                start = None
            if tag == BEGIN:
                start = k
    return [(len(raw[:s].decode()), len(raw[:e].decode())) for s, e in out]


def all_spans(text: str, tagger: Tagger | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base with the field's spans that overlap none of them."""
    base = base_spans(text)
    if tagger is None:
        return base, base
    added = [(s, 3, e) for s, e in field_spans(text, tagger) if not any(s < y and x < e for x, _, y in base)]
    return base, sorted(base + added)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_ALPHABETS = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef", "0123456789ABCDEF", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits]


def _value(rng: random.Random, low: int = 16, high: int = 64, alphabet: str | None = None) -> str:
    letters = alphabet or rng.choice(_ALPHABETS[:2] + _ALPHABETS)
    return "".join(rng.choices(letters, k=rng.randint(low, high)))


def _name(rng: random.Random, low: int = 2, high: int = 8) -> str:
    """Letters that can be spoken, as of names."""
    return "".join(rng.choice("bcdfgklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(low, high) // 2 + 1))


def planted_secret(rng: random.Random) -> tuple[list[str], list[int]]:
    """Tokens of a made-up secret, some with words around it, and their tags."""
    form = rng.randrange(9)
    if form == 0:  # an armoured block
        words = rng.choice([["KEY"], ["PRIVATE", "KEY"], ["RSA", "PRIVATE", "KEY"], ["PGP", "PRIVATE", "KEY", "BLOCK"]])
        lines = [_value(rng, 40, 76, _ALPHABETS[1]) for _ in range(rng.randint(1, 8))]
        fence = lambda word: [f"-----{word}", *words[:-1], f"{words[-1]}-----"]
        tokens = [*fence("BEGIN"), *lines, *fence("END")]
        return tokens, [BEGIN] + [INSIDE] * (len(tokens) - 1)
    if form == 1:  # a connection string
        host = _name(rng) + rng.choice(["", ".local", ".example.com"]) + rng.choice(["", f":{rng.randint(1000, 9999)}"])
        value = f"{_name(rng)}{rng.choice(['', 'ql', 's'])}://{_name(rng)}:{_value(rng, 6, 24, _ALPHABETS[0] + '!$%')}@{host}/{_name(rng)}"
    elif form == 2:  # parts behind dots
        value = ".".join([rng.choice(["ey", "", "v2"]) + _value(rng, 18, 50, _ALPHABETS[0] + "-_") for _ in range(3)])
    elif form in (3, 4):  # a prefix that tells the issuer
        mark = rng.choice("_--_")
        value = mark.join([_name(rng, 1, 4)[: rng.randint(2, 5)] for _ in range(rng.randint(1, 2))] + [str(rng.randint(10**8, 10**12)) for _ in range(rng.choice([0, 0, 0, 1, 2]))] + [_value(rng, 20, 48, rng.choice([_ALPHABETS[0], _ALPHABETS[5]]))])
    else:
        value = _value(rng) + rng.choice(["", "", "", "=", "=="])
    quote = rng.choice(["", "", "", "", "", '"', "'"])
    value = quote + value + quote + rng.choice(["", "", "", "", "", ";", ",", "."])
    word = rng.choice(["key", "auth", "pwd", "credential", "signature", "private", "cookie", "session", _name(rng)])
    before = [] if rng.random() < 0.5 else rng.choice([["Bearer"], ["Authorization:", "Bearer"], ["Basic"], [word + ":"], [word, "="], [word.upper(), "="], [word, "is"]])
    if rng.random() < 0.2:
        return [*before, word + rng.choice("=:") + value], [OUT] * len(before) + [BEGIN]
    return [*before, value], [OUT] * len(before) + [BEGIN]


def planted_harmless(rng: random.Random, near: list[str]) -> list[str]:
    """Tokens that look like secrets and are none; ``near`` are words of the text."""
    words = [w for w in near if w.isalpha()] or ["word"]
    some = lambda low, high: [rng.choice(words) for _ in range(rng.randint(low, high))]
    number = lambda low, high: str(rng.randint(10 ** (low - 1), 10**high - 1))
    forms = [
        lambda: [f"https://{_name(rng)}.{rng.choice(['com', 'org', 'example'])}/" + "/".join(some(1, 4)).lower() + rng.choice(["", "/", f"?id={number(1, 9)}", f"/{number(4, 8)}.html"])],
        lambda: [f"{_name(rng)}{rng.choice(['.', '_', ''])}{_name(rng)}{rng.choice(['', number(1, 3)])}@{_name(rng)}.example.{rng.choice(['com', 'org'])}"],
        lambda: [f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}Z"],
        lambda: ["-".join(number(3, 4) for _ in range(rng.randint(2, 4)))],
        lambda: [number(8, 19)],
        lambda: ["+" + " ".join(number(2, 4) for _ in range(4)).replace(" ", rng.choice([" ", "-", "."]))],
        lambda: ["_".join(some(2, 5)).lower() + rng.choice(["", "()", "=None,"])],
        lambda: ["".join(w.capitalize() for w in some(2, 5)) + rng.choice(["", "2", "()", "Test"])],
        lambda: ["-".join(some(2, 6)).lower()],
        lambda: ["".join(some(2, 5)).lower()],
        lambda: ["".join(some(2, 5)).upper()],
        lambda: ["/" + "/".join(some(2, 6)).lower() + rng.choice(["/", ".txt", ".py"])],
        lambda: [rng.choice("-=_*#~.") * rng.randint(3, 60)],
        lambda: [f'<{rng.choice(["div", "a", "span"])}', f'{rng.choice(["class", "id", "href"])}="{"-".join(some(1, 3)).lower()}">'],
        lambda: [f"v{rng.randint(0, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}-{rng.choice(['beta', 'rc1', 'alpha.2'])}"],
        lambda: [f"{rng.choice(words)}={rng.choice(words)}"], lambda: [f"{rng.choice(words)}:", rng.choice(words)],
        lambda: [rng.choice(words) + rng.choice("!#$%&*|") * rng.randint(1, 4)], lambda: [f"ISBN-{number(9, 13)}"], lambda: [f"{rng.choice(words)}{number(1, 4)}", f"{number(1, 6)}{rng.choice(['kg', 'km', 'GB', 'px'])}"],
        lambda: ["-----", *some(1, 3), "-----"],
        lambda: ["Bearer", *some(1, 3)],
    ]
    return " ".join(rng.choice(forms)()).split()


def windows_of(text: str, seed: int, count: int = 3, skipped: int | None = None) -> list[tuple[list[list[int]], np.ndarray, list[int], bool]]:
    """Training windows of one text: slots, file features, tags, and whether
    they hold something planted that is known to be harmless. ``count``
    windows at random places, of which half get a secret and half something
    harmless; and those of base matches but for the kind ``skipped``, whose
    places aren't learnt from at all."""
    raw = text.encode()
    spots = [m.span() for m in _WORD.finditer(raw)]
    if not spots:
        return []
    tokens = [raw[s:e] for s, e in spots]
    bytes_at = (lambda i: len(text[:i].encode())) if len(raw) != len(text) else (lambda i: i)
    tags = np.zeros(len(spots), int)
    starts = np.array([s for s, _ in spots])
    ends = np.array([e for _, e in spots])
    marks, unseen = [], np.zeros(len(spots), bool)
    for s, kind, e in base_spans(text):
        low, high = np.searchsorted(ends, bytes_at(s), "right"), np.searchsorted(starts, bytes_at(e), "left")
        if kind == skipped:
            unseen[low:high] = True
        elif high > low:
            if not tags[low]:
                tags[low] = BEGIN
            tags[low + 1 : high] = INSIDE
            marks.append(int(low))
    rng = random.Random(seed)
    words = [t.decode("utf-8", "replace") for t in tokens[:200]]
    out = []
    for k, c in enumerate([rng.randrange(len(spots)) for _ in range(count)] + marks[:PER_DOCUMENT]):
        low = max(0, c - rng.randint(2, WINDOW - 5))
        if tags[low] == INSIDE:
            low = c
        high = min(len(spots), low + WINDOW)
        if unseen[low:high].any():
            continue
        own, own_tags = tokens[low:high], tags[low:high].tolist()
        harmless = k < count and k % 2 == 1
        if k < count:
            new, new_tags = planted_secret(rng) if k % 2 == 0 else (planted_harmless(rng, words), None)
            at = rng.randint(0, len(own))
            if at == len(own) or own_tags[at] != INSIDE:
                own = own[:at] + [t.encode() for t in new] + own[at:]
                own_tags = own_tags[:at] + (new_tags or [OUT] * len(new)) + own_tags[at:]
                first = max(0, min(at, len(own) - WINDOW))
                while first and own_tags[first] == INSIDE:
                    first -= 1
                own, own_tags = own[first : first + WINDOW], own_tags[first : first + WINDOW]
        slots = [shape_features(shape_of(t)) for t in own]
        if rng.random() < 0.5:
            for s in slots:
                for i in BASE_NAMES:
                    s[i] = -1
        out.append((slots, file_features(raw, len(spots)), own_tags, harmless))
    return out


def train(df: DataFrame, id_col: str, text_col: str, sample: int, seed: int, skipped: int | None = None) -> Field | None:
    """A field from windows of about ``sample`` documents; None without any.
    ``skipped`` is a base kind whose matches aren't learnt from."""
    total = df.count()
    if not total:
        return None
    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    each = 2 * max(1, -(-LEAST_WINDOWS // (2 * min(sample, total))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(str(i), *w) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in windows_of(t, seed + zlib.crc32(str(i).encode()), min(each, 60), skipped)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[0] for m in made], pa.string()), pa.array([np.array(m[1], np.int32).tobytes() for m in made], pa.binary()), pa.array([m[2].tobytes() for m in made], pa.binary()), pa.array([np.array(m[3], np.int32).tobytes() for m in made], pa.binary()), pa.array([m[4] for m in made], pa.bool_())],
                ["id", "slots", "file", "tags", "harmless"],
            )

    got = sampled(rows, "id", sample / total, seed).mapInArrow(run, "id string, slots binary, file binary, tags binary, harmless boolean").toArrow()
    made = sorted(zip(*[got[c].to_pylist() for c in ("id", "slots", "file", "tags", "harmless")], strict=True))
    if not made:
        return None
    slots = np.full((len(made), WINDOW, N_NAMES), -1)
    tags = np.full((len(made), WINDOW), -1)
    for k, (_, s, _, t, _) in enumerate(made):
        own = np.frombuffer(t, np.int32)
        tags[k, : len(own)] = own
        slots[k, : len(own)] = np.frombuffer(s, np.int32).reshape(len(own), N_NAMES)
    if not (tags == BEGIN).any():
        return None
    files = np.array([np.frombuffer(m[2]) for m in made])
    _, p = fit_field(slots, files, tags, STEPS // 2)
    unsure = ((tags == OUT) & (p[..., OUT] < DOUBT)).any(1) & ~np.array([m[4] for m in made])
    return fit_field(slots[~unsure], files[~unsure], tags[~unsure])[0]


def trained(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, seed: int = 8) -> Field | None:
    bounded_batches(df.sparkSession)
    return train(df, id_col, text_col, sample, seed)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, seed: int = 8) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of every whole text."""
    field = trained(df, id_col, text_col, sample, seed)
    shared = df.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value) if shared.value is not None else None
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, spans = all_spans(text.as_py() or "", tagger)
                kinds = Counter(k for _, k, _ in base)
                rows.append((kinds[0], kinds[1], kinds[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    picked = df.select(id_col, df[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, f"`{id_col}` {dict(picked.dtypes)[id_col]}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """The text with every stretch that spans cover replaced by ``mask``."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "<SECRET>", sample: int = SAMPLE, seed: int = 8) -> DataFrame:
    """``df`` with the secrets of ``text_col`` masked; other columns as they are.

    A null text stays null.
    """
    field = trained(df, id_col, text_col, sample, seed)
    shared = df.sparkSession.sparkContext.broadcast(field)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value) if shared.value is not None else None
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                spans = all_spans(text, tagger)[1] if text else []
                out.append(redacted(text, spans, mask) if spans else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.column(at).type))

    return df.mapInArrow(run, df.schema)
