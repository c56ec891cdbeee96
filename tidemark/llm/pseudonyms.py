"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

A value is found by its pattern, validated (address parts, digit counts, calendar, check digit) and permuted within its
own format: digits stay digits, letters keep their case, a card number that passes its check digit still passes, a
date stays a date. The permutation depends on key, kind and format only, so equal values stay equal in all documents,
different values stay different, and the key's holder can undo it.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm import common

ROUNDS = 10
KINDS = ("email", "phone", "card", "account", "ip", "ssn", "iban", "date", "secret")

# Fixed patterns and prefixes of the recognised formats.
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_PHONE = r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,5}){1,4}(?![0-9A-Za-z])"
_FOUND = re.compile(rf"""
    (?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]{{0,63}}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?\.)+[A-Za-z]{{2,24}})
  | (?P<secret>(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{{16}}(?![A-Za-z0-9])
      | (?<![A-Za-z0-9])(?:ghp|gho|ghs|sk|pk|xoxb|xoxp)[_-][A-Za-z0-9_-]{{16,}}
      | (?<![A-Za-z0-9])(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)["']?\s{{0,3}}[=:]\s{{0,3}}["']?(?P<value>[A-Za-z0-9+/_.-]{{8,}}))
  | (?P<iban>{_IBAN})
  | (?P<phone>{_PHONE}
      | (?<![0-9A-Za-z])(?:\([0-9]{{3}}\)[ ]?|[0-9]{{3}}[.-])[0-9]{{3}}[.-][0-9]{{4}}(?![0-9A-Za-z]))
  | (?P<ip>(?<![0-9.])(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}(?![0-9]|\.[0-9]))
  | (?P<date>(?<![0-9A-Za-z])(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}|[0-9]{{2}}[./-][0-9]{{2}}[./-][0-9]{{4}})(?![0-9A-Za-z]))
  | (?P<ssn>(?<![0-9A-Za-z-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9A-Za-z-]))
  | (?P<card>(?<![0-9A-Za-z])(?:[0-9]{{4}}[ -]){{3}}[0-9]{{1,7}}(?![0-9A-Za-z]) | (?<![0-9A-Za-z])[0-9]{{13,19}}(?![0-9A-Za-z]))
""", re.VERBOSE)
#: Patterns whose greedy match can run into a following value.
_OPEN = {"iban": re.compile(_IBAN), "phone": re.compile(_PHONE)}
_EDGE = re.compile("(?<=[0-9A-Za-z])(?![0-9A-Za-z])")
#: Length of an account number by country, and least and most national digits of a phone number by calling code (public plans).
_IBAN_SIZES = {c[:2]: int(c[2:]) for c in """
    AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18
    FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27
    MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27
    SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30""".split()}
_NATIONAL = {"1": (10, 10), "7": (10, 10), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "41": (9, 9), "44": (9, 10),
             "45": (8, 8), "47": (8, 8), "48": (9, 9), "52": (10, 10), "55": (10, 11), "61": (9, 9), "65": (8, 8), "81": (9, 10),
             "86": (10, 11), "90": (10, 10), "91": (10, 10), "351": (9, 9), "420": (9, 9), "421": (9, 9), "852": (8, 8)}
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73049  # to 2099-12-31
_DATE_FORMS = ("%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%d/%m/%Y", "%d-%m-%Y", "%m/%d/%Y", "%m-%d-%Y", "%m.%d.%Y")


class Feistel:
    """Keyed permutations of [0, n) for any n: an alternating two-part Feistel network on mixed radices, with cycle walking."""

    def __init__(self, key: str):
        self.key = hashlib.sha256(key.encode()).digest()

    def _round(self, number: int, tweak: bytes, half: int, modulus: int) -> int:
        digest = hashlib.blake2b(b"%d|%d|" % (number, half) + tweak, key=self.key, digest_size=32).digest()
        return int.from_bytes(digest, "big") % modulus

    def _once(self, x: int, a: int, b: int, tweak: bytes, undo: bool) -> int:
        left, right = divmod(x, b)
        for number in (range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS)):
            sign = -1 if undo else 1
            if number % 2:
                right = (right + sign * self._round(number, tweak, left, b)) % b
            else:
                left = (left + sign * self._round(number, tweak, right, a)) % a
        return left * b + right

    def permute(self, x: int, n: int, tweak: str, undo: bool = False) -> int:
        a = max(1, int(n**0.5)) if n < 1 << 100 else 1 << (n.bit_length() // 2)
        b = -(-n // a)
        x = self._once(x, a, b, tweak.encode(), undo)
        while x >= n:
            x = self._once(x, a, b, tweak.encode(), undo)
        return x

    def text(self, value: str, tweak: str, undo: bool = False, keep: Iterable[int] = ()) -> str:
        """Permute the digits and letters; each stays in its class, other characters and ``keep`` stay as they are."""
        hexadecimal = tweak == "secret" and re.fullmatch("[0-9a-f]{16,}", value) is not None
        keep, classes = set(keep), []
        for place, c in enumerate(value):
            alphabet = None if place in keep else "0123456789abcdef" if hexadecimal else next((s for s in _ALPHABETS if c in s), None)
            classes.append(alphabet)
        x, n = 0, 1
        for c, alphabet in zip(value, classes):
            if alphabet:
                x, n = x * len(alphabet) + alphabet.index(c), n * len(alphabet)
        form = "".join("-" if not a else str(len(a)) + a[0] for a in classes)
        x = self.permute(x, n, f"{tweak}|{form}", undo)
        out = []
        for c, alphabet in zip(reversed(value), reversed(classes)):
            if alphabet:
                x, digit = divmod(x, len(alphabet))
                c = alphabet[digit]
            out.append(c)
        return "".join(reversed(out))


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def check_digit(digits: str) -> str:
    """The last digit that makes a card number valid, from the digits before it."""
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c) * (1 if place % 2 else 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def classify(kind: str, value: str) -> str | None:
    """The kind of a found value after validation; None if it is no such value."""
    digits = re.sub(r"\D", "", value)
    if kind == "ip":
        return "ip" if all(int(p) < 256 and p == str(int(p)) for p in value.split(".")) else None
    if kind == "phone":
        return "phone" if 8 <= len(digits) <= 15 else None
    if kind == "card":
        return "card" if check_digit(digits[:-1]) == digits[-1] else "account"
    if kind == "date":
        return "date" if _date(value) else None
    if kind == "iban":
        rest = value.replace(" ", "")
        return "iban" if 15 <= len(rest) <= 34 and int("".join(str(int(c, 36)) for c in rest[4:] + rest[:4])) % 97 == 1 else None
    return kind


def _date(value: str) -> tuple[int, str] | None:
    for form in _DATE_FORMS:
        try:
            number = datetime.datetime.strptime(value, form).date().toordinal() - _FIRST_DAY
        except ValueError:
            continue
        if 0 <= number < _DAYS:
            return number, form
    return None


def pseudonym(feistel: Feistel, kind: str, value: str, undo: bool = False) -> str:
    """The value's stand-in of the same kind and format; ``undo`` gives the value back."""
    if kind == "date":
        number, form = _date(value)
        moved = feistel.permute(number, _DAYS, "date", undo) + _FIRST_DAY
        day = datetime.date.fromordinal(moved)
        # Day and month of ambiguous forms must be read back by the same form.
        while (_date(day.strftime(form)) or (0, ""))[1] != form:
            moved = feistel.permute(moved - _FIRST_DAY, _DAYS, "date", undo) + _FIRST_DAY
            day = datetime.date.fromordinal(moved)
        return day.strftime(form)
    if kind == "ip":
        x = 0
        for part in value.split("."):
            x = x * 256 + int(part)
        return ".".join(str(b) for b in feistel.permute(x, 1 << 32, "ip", undo).to_bytes(4, "big"))
    if kind == "card":
        last = max(i for i, c in enumerate(value) if c.isdigit())
        moved = feistel.text(value[:last], "card", undo)
        return moved + check_digit(re.sub(r"\D", "", moved)) + value[last + 1:]
    if kind == "account":
        moved = feistel.text(value, "account", undo)
        while check_digit(re.sub(r"\D", "", moved)[:-1]) == re.sub(r"\D", "", moved)[-1]:
            moved = feistel.text(moved, "account", undo)
        return moved
    if kind == "iban":
        places = [i for i, c in enumerate(value) if c != " "]
        moved = list(feistel.text(value, "iban", undo, keep=places[:4]))
        rest = "".join(moved).replace(" ", "")
        check = 98 - int("".join(str(int(c, 36)) for c in rest[4:] + rest[:2] + "00")) % 97
        moved[places[2]], moved[places[3]] = f"{check:02d}"
        return "".join(moved)
    if kind == "email":
        return feistel.text(value, "email", undo, keep=range(value.rindex("."), len(value)))
    if kind == "phone":
        area = re.match(r"\+[0-9]{1,3}(?=[ .(-])", value)
        return feistel.text(value, "phone", undo, keep=range(area.end()) if area else ())
    return feistel.text(value, kind, undo, keep=range(4) if re.match("AKIA|ASIA", value) else ())


def _whole_phone(value: str) -> bool:
    """Whether a number has the length of its plan. Only what a pseudonym keeps is looked at, so that ``undo`` agrees."""
    code = re.match(r"\+([0-9]{1,3})[ .(-]", value)
    if not code:  # written in one piece, the calling code cannot be told
        return re.fullmatch(r"\+[0-9]{11,15}", value) is not None
    digits = len(re.sub(r"\D", "", re.sub(r"\([0-9]\)", "", value[code.end() - 1:])))  # no "(0)"
    least, most = _NATIONAL.get(code[1], (16, 0))
    return least <= digits <= most


def _validated(text: str, match: re.Match) -> tuple[str | None, int]:
    """Kind of a match and its end: of all ends where a value of its kind can stop, that of the value's own plan, else the last."""
    kind, (start, end) = match.lastgroup, match.span()
    if match["secret"]:
        return "secret", end
    if kind not in _OPEN or kind == "phone" and text[start] != "+":
        return classify(kind, match[0]), end
    stops = [e for e in range(end, start + 7, -1) if _EDGE.match(text, e)]
    stops = [e for e in stops if _OPEN[kind].fullmatch(text, start, e) and classify(kind, text[start:e])]
    if kind == "iban":
        size = _IBAN_SIZES.get(text[start:start + 2])
        best = [e for e in stops if len(text[start:e].replace(" ", "")) == size]
    else:
        clean = [e for e in stops if not re.match("[.-][0-9]", text[e:e + 2])]  # not within a following value
        best = [e for e in clean or stops if _whole_phone(text[start:e])] or [e for e in stops if _whole_phone(text[start:e])] or clean
    return (kind, (best or stops)[0]) if stops else (None, end)


def replace(text: str, feistel: Feistel, undo: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """Text with stand-ins, and (kind, start, end) of each in characters of the input."""
    out, at, spans, look = [], 0, [], 0
    while match := _FOUND.search(text, look):
        kind, last = _validated(text, match)
        if not kind:
            look = match.start() + 1
            continue
        start, end = match.span("value") if match["value"] else (match.start(), last)
        out += [text[at:start], pseudonym(feistel, kind, text[start:end], undo)]
        spans.append((kind, start, end))
        at = look = end
    if not spans:
        return text, spans
    return "".join([*out, text[at:]]), spans


FIELDS = [T.StructField("n_values", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))]
_HINT = np.zeros(256, np.uint8)
_HINT[[*range(48, 58), ord("@"), ord("="), ord(":"), ord("_"), ord("-")]] = 1
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", undo: bool = False) -> DataFrame:
    """Every row with the values of ``text`` replaced, their number ``n_values`` and their ``spans`` in the input.

    Whole texts are searched. A null text stays null with no spans, an empty one stays empty; texts without values are
    unchanged, repeated rows get equal results. ``n_values`` and ``spans`` replace columns of these names, all others
    pass through. The leftmost value wins; at one place the order of the patterns decides. What fails validation is tried
    with shorter ends and then searched for values inside. A phone number ends where its calling code's plan says; under a
    plan of open length a short number behind a space counts as part of it. ``undo`` can miss where new digits by chance
    (one in 97) make a valid IBAN of what was none.
    """
    fields = [T.StructField(text, T.StringType()), *FIELDS]

    def make():
        feistel = Feistel(key)

        def run(texts: pa.Array):
            offsets, data = common.utf8(texts)
            marks = np.concatenate([[0], np.cumsum(_HINT[data], dtype=np.int64)])
            hit = np.flatnonzero(marks[offsets[1:]] > marks[offsets[:-1]])
            changed, new, spans = [], [], [[]] * len(texts)
            for k in hit:
                made, found = replace(texts[k].as_py(), feistel, undo)
                if found:
                    changed.append(k)
                    new.append(made)
                    spans[k] = found
            if changed:
                mask = np.zeros(len(texts), bool)
                mask[changed] = True
                texts = pa.compute.replace_with_mask(texts, pa.array(mask), pa.array(new, texts.type))
            found = pa.array([[{"kind": a, "start": b, "end": c} for a, b, c in s] for s in spans], _ARROW_SPANS)
            return texts, pa.array([len(s) for s in spans], pa.int64()), found
        return run

    order = docs.columns
    out = common.append(docs, [text], fields, make)
    return out.select(*[c for c in order if c not in ("n_values", "spans")], "n_values", "spans")
