"""Format-preserving pseudonyms of personal data.

Values are found by format, then validated: card numbers by their Luhn digit,
phone numbers by length (8 to 15 digits after a plus, 10 or 11 after a trunk 0,
else 10), IPv4 octets by range, IPv6 addresses by their parser, IBANs by modulus
97, dates by the calendar. A valid value is replaced by a keyed permutation of
the set of its own format: a balanced Feistel network over the number of its
variable digits, walked until the result is in the set again. So equal values
get equal pseudonyms in every document, different values different ones, and a
card stays a Luhn-valid card, a date a date. Mail addresses and secrets (access
keys and tokens, quoted hexadecimal keys, passwords and keys behind their name,
private-key blocks) keep each character's class: digits, lower and upper letters
and the letters of other scripts are permuted with the same network, as one
number of mixed radix for up to SEGMENT characters. Longer values are permuted
segment by segment, forwards and backwards, each under the hash of the segments
before it, so every character depends on the whole value and the map stays a
permutation. Where a candidate fails validation, cards and IBANs are tried again
with fewer groups, and the search goes on one character behind its start, so
neighbouring numbers (expiry, CVV, quantity) hide no value. Values that fail
validation are left alone. Dates with slashes are day first, and month first
where only that is a date; the latter stay in their own set.

Defined results: null text stays null with no findings; empty texts, repeated
rows and null ids are kept as they are; values may be of any length; extra
columns are carried, and where one is called `findings` already, the new column
takes the name that `fresh` gives.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import ipaddress
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resolva.llm.common import fresh

ROUNDS = 8
FINDINGS = "text string, findings array<struct<kind:string,pseudonym:string>>"

# Formats, tried in this order at every position.
FORMATS = [
    ("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]+-----END [A-Z ]{0,40}PRIVATE KEY-----"),
    ("email", r"(?<![\w.+-])[^\W_][\w.+-]*@[^\W_][\w-]*(?:\.[\w-]+)*\.[^\W\d_]{2,}"),
    ("access_key", r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36,255})(?![A-Za-z0-9])"),
    ("password", r"(?<![A-Za-z])(?i:password|passwd|api[_-]?key|secret[_-]?key|access[_-]?token)\s*[=:]\s*[^\s]+"),
    ("hex_key", r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    ("date", r"(?<![\d.])\d{4}-\d{2}-\d{2}(?![\d])|(?<!\d)\d{2}/\d{2}/\d{4}(?!\d)|(?<![\d.])\d{2}\.\d{2}\.\d{4}(?!\d|\.\d)"),
    ("ipv6", r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])"),
    ("ipv4", r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"),
    ("phone", r"(?<![\d+])\+\d{1,3}[ -]?\(\d{2,4}\)[ -]?\d{3}[ -]?\d{3,4}(?!\d)|(?<!\d)\(\d{3}\)[ -]?\d{3}-\d{4}(?!\d)"
     r"|(?<![\w+])\+[1-9](?:[ .-]?\(?\d\)?){6,14}(?!\d)|(?<![\d.-])(?<!\d )[2-9]\d{2}(?:-[2-9]\d{2}-| [2-9]\d{2} |\.[2-9]\d{2}\.)\d{4}(?![ .-]?\d)"
     r"|(?<![\w.+-])(?<!\d )0[1-9]\d{1,3} \d{3,4} \d{3,4}(?![ .-]?\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"),
]
#: What a text must hold for a kind to occur in it; without it the kind's format is not searched.
SIGNS = {"private_key": "PRIVATE KEY-----", "email": "@", "access_key": "AKIA|gh[opsu]_", "password": "(?i:passw|api[_-]?key|secret[_-]?key|access[_-]?token)",
         "hex_key": "[0-9a-f]{32}", "iban": r"[A-Z]{2}\d{2}", "date": r"\d{2}[-/.]\d{2}", "ipv6": "::|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "ipv4": r"\d\.\d",
         "phone": r"\+\d|\d{3}[ )-]|\d{3}\.\d", "ssn": r"\d{3}-\d{2}-", "card": r"\d(?:[ -]?\d){12}"}


def _span(first: str, last: str) -> str:
    return "".join(map(chr, range(ord(first), ord(last) + 1)))


#: Characters that are permuted among themselves.
ALPHABETS = {"d": "0123456789", "l": "abcdefghijklmnopqrstuvwxyz", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "h": "0123456789abcdef",
             "a": _span("à", "ö") + _span("ø", "ÿ"), "A": _span("À", "Ö") + _span("Ø", "Þ"), "x": _span("\u0100", "\u017f"),
             "g": _span("α", "ω"), "G": _span("Α", "Ρ") + _span("Σ", "Ω"), "c": _span("а", "џ"), "C": _span("Ѐ", "Я"),
             "e": _span("\u05d0", "\u05ea"), "r": _span("\u0621", "\u063a"), "i": _span("\u0905", "\u0939"),
             "k": _span("\u3041", "\u3096"), "K": _span("\u30a1", "\u30fa"), "z": _span("\u4e00", "\u9fa5"), "w": _span("\uac00", "\ud7a3")}
CLASS_OF = {c: k for k in ALPHABETS if k not in "hzw" for c in ALPHABETS[k]}
SEGMENT = 24


def _class(c: str) -> str:
    return CLASS_OF.get(c) or ("z" if "\u4e00" <= c <= "\u9fa5" else "w" if "\uac00" <= c <= "\ud7a3" else "-")


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0..size-1: Feistel rounds on two halves of equal
    bit length, repeated while the result is outside. A half that is longer than
    one digest takes as many as it needs."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, n_bytes = (1 << half) - 1, (half + 7) // 8
    head = f"{tweak}|{half}|".encode() + size.to_bytes((size.bit_length() + 7) // 8, "big")
    while True:
        a, b = value >> half, value & mask
        for i in range(ROUNDS):
            message = head + bytes([i]) + b.to_bytes(n_bytes, "big")
            stream = b"".join(hmac.digest(key, message + n.to_bytes(4, "big"), "sha256") for n in range(-(-n_bytes // 32)))
            a, b = b, a ^ (int.from_bytes(stream, "big") & mask)
        value = a << half | b
        if value < size:
            return value


def luhn_digit(digits: str) -> str:
    """The check digit that follows these digits."""
    total = sum((2 * int(d) - 9 * (int(d) > 4)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _digits(text: str, new: str) -> str:
    """Put new digits into the places of a text's digits."""
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _segment(text: str, kinds: str, key: bytes, tweak: str) -> str:
    """Permute the characters of a short text within their classes, as one number."""
    value, size = 0, 1
    for c, k in zip(text, kinds):
        if k != "-":
            value = value * len(ALPHABETS[k]) + ALPHABETS[k].index(c)
            size *= len(ALPHABETS[k])
    value, out = permute(value, size, key, f"{tweak}|{kinds}") if size > 1 else value, []
    for c, k in zip(reversed(text), reversed(kinds)):
        if k == "-":
            out.append(c)
        else:
            value, i = divmod(value, len(ALPHABETS[k]))
            out.append(ALPHABETS[k][i])
    return "".join(reversed(out))


def _mixed(text: str, key: bytes, tweak: str, kinds: str | None = None) -> str:
    """Permute the characters of a text within their classes."""
    kinds = kinds or "".join(map(_class, text))
    if len(text) <= SEGMENT:
        return _segment(text, kinds, key, tweak)
    places = range(0, len(text), SEGMENT)
    parts, forms = [text[i:i + SEGMENT] for i in places], [kinds[i:i + SEGMENT] for i in places]
    seen = hashlib.sha256(f"{len(text)}|{tweak}|{kinds}".encode())
    for way in (1, -1):
        for i in range(len(parts))[::way]:
            parts[i] = _segment(parts[i], forms[i], key, f"{tweak}|{way}|{i}|{seen.hexdigest()}")
            seen.update(parts[i].encode())
        seen = hashlib.sha256(f"back|{len(text)}|{tweak}|{kinds}".encode())
    return "".join(parts)


def _card(m: str, key: bytes) -> str | None:
    d = "".join(c for c in m if c.isdigit())
    if len(set(d)) == 1 or luhn_digit(d[:-1]) != d[-1]:
        return None
    body = str(permute(int(d[:-1]), 10 ** (len(d) - 1), key, "card")).zfill(len(d) - 1)
    return _digits(m, body + luhn_digit(body))


def _numbers(kind: str):
    def run(m: str, key: bytes) -> str:
        d = "".join(c for c in m if c.isdigit())
        return _digits(m, str(permute(int(d), 10 ** len(d), key, kind)).zfill(len(d)))
    return run


def _ssn(m: str, key: bytes) -> str | None:
    a, b, c = m.split("-")
    return None if a in ("000", "666") or a[0] == "9" or b == "00" or c == "0000" else _numbers("ssn")(m, key)


def _ipv4(m: str, key: bytes) -> str | None:
    octets = [int(x) for x in m.split(".")]
    if max(octets) > 255:
        return None
    v = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "ipv4")
    return ".".join(map(str, v.to_bytes(4, "big")))


def _ipv6(m: str, key: bytes) -> str | None:
    try:
        old = ipaddress.IPv6Address(m)
    except ValueError:
        return None
    if not any(c.isdigit() for c in m) or len(m) < 5:       # names such as a::b are no addresses
        return None
    new = ipaddress.IPv6Address(permute(int(old), 1 << 128, key, "ipv6"))
    return new.compressed if "::" in m else new.exploded


def _phone(m: str, key: bytes) -> str | None:
    n = sum(c.isdigit() for c in m)
    return _numbers("phone")(m, key) if (8 <= n <= 15 if m[0] == "+" else n in (10, 11) if m[0] == "0" else n == 10) else None


def _date(m: str, key: bytes) -> str | None:
    if "-" not in m:
        sep, (d, month, y) = m[2], (m[:2], m[3:5], m[6:])
        if sep == "/" and int(month) > 12:  # month first, to another date that can only be month first
            new = f"{y}-{d}-{month}"
            while (new := _date(new, key)) and int(new[8:]) <= 12:
                pass
            return new and f"{new[5:7]}/{new[8:]}/{new[:4]}"
        new = _date(f"{y}-{month}-{d}", key)
        return new and sep.join((new[8:], new[5:7], new[:4]))
    try:
        day = datetime.datetime.strptime(m, "%Y-%m-%d").date()
    except ValueError:
        return None
    first, last = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal()
    at = day.toordinal()
    lo, hi = (first, last) if first <= at < last else (1, datetime.date.max.toordinal() + 1)
    new = datetime.date.fromordinal(lo + permute(at - lo, hi - lo, key, "date"))
    return f"{new.year:04d}-{new.month:02d}-{new.day:02d}"


def _iban(m: str, key: bytes) -> str | None:
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    gaps, m = [i for i, c in enumerate(m) if c == " "], m.replace(" ", "")
    if number(m[4:] + m[:4]) % 97 != 1:
        return None
    body = _mixed(m[4:], key, "iban")
    new = m[:2] + f"{98 - number(body + m[:2] + '00') % 97:02d}" + body
    for i in gaps:
        new = new[:i] + " " + new[i:]
    return new


def _email(m: str, key: bytes) -> str:
    local, _, domain = m.rpartition("@")
    return _mixed(local, key, "email") + "@" + _mixed(domain.rpartition(".")[0], key, "domain") + "." + domain.rpartition(".")[2]


def _after(prefix: str, kind: str, hexadecimal: bool = False):
    def run(m: str, key: bytes) -> str:
        head = re.match(prefix, m).group(0)
        rest = m[len(head):]
        return head + _mixed(rest, key, kind, "h" * len(rest) if hexadecimal else None)
    return run


def _private_key(m: str, key: bytes) -> str:
    first, last = m.index("KEY-----") + 8, m.rindex("-----END")
    return m[:first] + _mixed(m[first:last], key, "private_key") + m[last:]


RULES = {"private_key": _private_key, "email": _email, "access_key": _after("AKIA|gh[opsu]_", "access_key"),
         "password": _after(r"[^=:]*[=:]\s*", "password"), "hex_key": _after("", "hex_key", True), "iban": _iban, "date": _date, "ipv6": _ipv6,
         "ipv4": _ipv4, "phone": _phone, "ssn": _ssn, "card": _card}


class Finder:
    """Searches a text for the formats of those kinds whose signs it holds."""

    def __init__(self):
        self.signs = [(kind, re.compile(SIGNS[kind]).search) for kind, _ in FORMATS]
        self.known: dict[tuple, re.Pattern] = {}

    def __call__(self, text: str) -> re.Pattern | None:
        kinds = tuple(kind for kind, sign in self.signs if sign(text))
        if kinds and kinds not in self.known:
            self.known[kinds] = re.compile("|".join(f"(?P<{kind}>{form})" for kind, form in FORMATS if kind in kinds))
        return self.known.get(kinds)


#: Least characters, without gaps, of the kinds that are tried again with fewer groups.
SHORTEST = {"card": 13, "iban": 15}


#: Cards as they are printed; they go before other groupings of the same digits.
PRINTED = re.compile(r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{4,5})(?!\d)")


def _candidates(text: str, m: re.Match) -> list[str]:
    """The match, then its beginnings that end before a gap, longest first. A
    printed card at the start goes first; one further on leaves no other."""
    kind, found = m.lastgroup, m.group(0)
    if kind not in SHORTEST:
        return [found]
    gaps = [g.start() for g in re.finditer("[ -]", found)]
    if kind == "card":
        for at in (0, *(g + 1 for g in gaps)):
            card = PRINTED.match(text, m.start() + at)
            if card and _card(card.group(0), b"") is not None:
                return [card.group(0)] if at == 0 else []
    return [found, *(found[:g] for g in reversed(gaps) if sum(c not in " -" for c in found[:g]) >= SHORTEST[kind])]


def pseudonymise_text(text: str, key: bytes, finder: Finder) -> tuple[str, list[dict]]:
    out, at, start, found = [], 0, 0, []
    find = finder(text)
    while find and (m := find.search(text, start)):
        kind, start = m.lastgroup, m.start() + 1
        for old in _candidates(text, m):
            new = RULES[kind](old, key)
            if new is not None:
                out += [text[at:m.start()], new]
                at = start = m.start() + len(old)
                found.append({"kind": kind, "pseudonym": new})
                break
    return "".join([*out, text[at:]]), found


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replace the text column and add `findings`, in text order, as the last column."""
    secret = key.encode()

    @F.pandas_udf(FINDINGS)
    def run(texts: pd.Series) -> pd.DataFrame:
        finder = Finder()
        rows = [(None, []) if t is None else pseudonymise_text(t, secret, finder) for t in texts]
        return pd.DataFrame(rows, columns=["text", "findings"])

    done, findings = fresh(docs, "pseudonymised", "findings")
    return docs.withColumn(done, run(F.col(text).cast("string"))).select(
        *[F.col(done)["text"].alias(c) if c == text else F.col(c) for c in docs.columns], F.col(done)["findings"].alias(findings))
