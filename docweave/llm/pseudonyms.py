"""Personal data by format-preserving Feistel pseudonyms.

Numbers and dates that pass their own validation (check digits, country codes and lengths, calendar, address syntax), and names and
secrets in addresses and credentials, are replaced by a keyed permutation within their format: every digit
becomes a digit, every letter a letter of its case, and what was valid stays valid. A value is permuted in its canonical
form (the digits of a phone or card number, the letters and digits of an IBAN, the bits of an address) and then
written in the layout that it was found in, so equal values get equal pseudonyms in every document however they are spaced or
punctuated, different values different ones, and whoever holds the key can turn them back.

A value is ranked within its format, the rank goes through a Feistel network of ``TURNS`` keyed rounds over the
next even number of bits, again and again until it falls on the rank of a valid value (cycle walking).
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import secrets
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import null_safe

TURNS = 10
#: The setting that holds the key.
KEY_SETTING = "spark.docweave.pii.key"

_DAYS = (datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal() + 1)
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
_HEX = "0123456789abcdef"
# Lengths of IBANs by country, and telephone country codes of one and of two digits (all others have three).
_IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 "
        "JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}
_ONE_DIGIT = frozenset("17")
_TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


class Cipher:
    """A keyed permutation of 0..size-1 for any size; ``tweak`` names the format, so formats are permuted apart."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def _round(self, tweak: bytes, n: int, half: int, bits: int) -> int:
        raw = hashlib.blake2b(n.to_bytes(1, "big") + bits.to_bytes(2, "big") + half.to_bytes((bits + 7) // 8, "big") + tweak, key=self.key, digest_size=(bits + 7) // 8 + 8).digest()
        return int.from_bytes(raw, "big") & ((1 << bits) - 1)

    def _once(self, x: int, bits: int, tweak: bytes, back: bool) -> int:
        a, b = x >> bits, x & ((1 << bits) - 1)
        for n in reversed(range(TURNS)) if back else range(TURNS):
            if back:
                a, b = b ^ self._round(tweak, n, a, bits), a
            else:
                a, b = b, a ^ self._round(tweak, n, b, bits)
        return a << bits | b

    def permute(self, x: int, size: int, tweak: str, valid=None, back: bool = False) -> int:
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        while True:
            x = self._once(x, bits, tweak.encode(), back)
            if x < size and (valid is None or valid(x)):
                return x


def _alphabets(text: str, hexed: bool) -> list[str | None]:
    return [_HEX if hexed and c in _HEX else next((k for k in _CLASSES if c in k), None) for c in text]


def _rank(text: str, alphabets: list) -> tuple[int, int]:
    x, size = 0, 1
    for c, k in zip(text, alphabets):
        if k:
            x, size = x * len(k) + k.index(c), size * len(k)
    return x, size


def _unrank(x: int, text: str, alphabets: list) -> str:
    out = list(text)
    for i in range(len(text) - 1, -1, -1):
        if k := alphabets[i]:
            x, at = divmod(x, len(k))
            out[i] = k[at]
    return "".join(out)


def luhn(digits: str) -> bool:
    s = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        s += d - 9 * (d > 9)
    return s % 10 == 0


def _iban_number(s: str) -> int:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4]))


def _valid_ssn(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _date(parts: tuple[str, ...], order: str) -> datetime.date | None:
    v = dict(zip(order, map(int, parts)))
    try:
        day = datetime.date(v["y"], v["m"], v["d"])
    except ValueError:
        return None
    return day if _DAYS[0] <= day.toordinal() < _DAYS[1] else None


class Pseudonyms:
    """Finds values in a text and permutes them; ``back`` turns pseudonyms into the values again."""

    #: Kinds in order: at a place the first that matches and validates wins.
    PATTERN = re.compile(
        r"""(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![\w-]))
        |(?P<access_key>(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9]))
        |(?P<secret>(?i:(?<![A-Za-z0-9])(?:password|passwd|pwd|token|secret|api[_-]?key)["']?\s{0,3}[=:]\s{0,3}["']?)(?P<value>[A-Za-z0-9_+/-]{6,}))
        |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
        |(?P<mac>(?<![0-9A-Za-z:-])[0-9A-Fa-f]{2}(?P<colon>[:-])[0-9A-Fa-f]{2}(?:(?P=colon)[0-9A-Fa-f]{2}){4}(?![0-9A-Za-z]|[:-][0-9A-Fa-f]))
        |(?P<ipv6>(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:]))
        |(?P<iso_date>(?<![\d-])(?:19|20)\d\d-\d\d-\d\d(?![\d-]))
        |(?P<date>(?<![\d./])\d{1,2}(?P<sep>[./])\d{1,2}(?P=sep)(?:19|20)\d\d(?!\d|[./]\d))
        |(?P<ipv4>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d))
        |(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
        |(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d|[ .-]?\d)|(?<![\w(])\(\d{3}\)[ ]?\d{3}[-. ]\d{4}(?!\d)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?!\d|[.-]\d))
        |(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|[.]\d))
        """,
        re.X,
    )
    MAYBE = re.compile(r"\d|@|AKIA|ASIA|[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]|[0-9A-Fa-f]::[0-9A-Fa-f]|(?i:password|passwd|pwd|token|secret|api[_-]?key)")

    def __init__(self, key: str):
        self.cipher = Cipher(key)
        self.turn = lru_cache(1 << 16)(self._turn)

    def apply(self, text: str, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with its values permuted, and (kind, start, stop) of each in the text given."""
        if not self.MAYBE.search(text):
            return text, []
        out, at, found, pos = [], 0, [], 0
        while m := self.PATTERN.search(text, pos):
            kind = {"value": "secret", "sep": "date", "colon": "mac"}.get(m.lastgroup, m.lastgroup)
            s, e = m.span("value") if kind == "secret" else m.span()
            new = None if kind == "secret" and not _is_secret(m["secret"], m["value"]) else self.turn(kind, text[s:e], back)
            if new is None and (other := self._others(m, text)):
                kind, s, e, new = other[0], other[1], other[2], self.turn(other[0], text[other[1] : other[2]], back)
            if new is None:
                pos = m.start() + 1
                while pos < len(text) and text[pos - 1].isalnum() and text[pos].isalnum():
                    pos += 1
                continue
            out += [text[at:s], new]
            at = pos = e
            found.append((kind, s, e))
        return "".join([*out, text[at:]]), found

    def _others(self, m, text):
        """Where the first kind doesn't validate, a later kind may: a phone-like run of digits that is a card, or the reverse."""
        for kind in ("card", "iban", "ssn"):
            if other := _ALONE[kind].match(text, m.start()):
                if self.turn(kind, other[0], False) is not None:
                    return kind, other.start(), other.end()
        return None

    def _turn(self, kind: str, text: str, back: bool) -> str | None:
        return getattr(self, f"_{kind}")(text, back)

    def _letters(self, text, tweak, back, hexed=False, valid=None):
        k = _alphabets(text, hexed)
        x, size = _rank(text, k)
        check = None if valid is None else lambda y: valid(_unrank(y, text, k))
        return _unrank(self.cipher.permute(x, size, tweak + "".join("-" if a is None else str(len(a)) + a[0] for a in k), check, back), text, k) if size > 1 else text

    def _email(self, text, back):
        head, _, tld = text.rpartition(".")
        return f"{self._letters(head, 'email', back)}.{tld}"

    def _access_key(self, text, back):
        alphabet = _CLASSES[1] + _CLASSES[2]
        k = [alphabet] * 16
        x, size = _rank(text[4:], k)
        return text[:4] + _unrank(self.cipher.permute(x, size, "access_key", None, back), text[4:], k)

    def _secret(self, text, back):
        hexed = all(c in _HEX for c in text)
        return self._letters(text, "secret", back, hexed, valid=(lambda y: all(c in _HEX for c in y) == hexed))

    def _iban(self, text, back):
        bare = text.replace(" ", "")
        if len(bare) != _IBAN_LENGTHS.get(bare[:2]) or _iban_number(bare) % 97 != 1:
            return None
        body = self._letters(bare[4:], "iban" + bare[:2], back)
        check = 98 - _iban_number(bare[:2] + "00" + body) % 97
        return _laid_out(text, f"{bare[:2]}{check:02d}{body}")

    def _mac(self, text, back):
        digits = re.sub("[:-]", "", text).lower()
        wordy = digits.isdigit()
        if len(set(digits)) == 1:  # all zeros or the broadcast address name nobody
            return None
        # a value without letters has no case to keep, so it stays among those
        n = self.cipher.permute(int(digits, 16), 1 << 48, "mac", lambda y: f"{y:012x}".isdigit() == wordy and len(set(f"{y:012x}")) > 1, back)
        return _laid_out(text, f"{n:012x}".upper() if text != text.lower() else f"{n:012x}")

    def _ipv6(self, text, back):
        """All 128 bits are permuted and written in the shortest spelling."""
        try:
            x = int(ipaddress.IPv6Address(text))
        except ValueError:
            return None
        if not re.search(r"\d", text) or x < 1 << 64:  # words of code that look like one, and addresses of the machine itself
            return None
        n = self.cipher.permute(x, 1 << 128, "ipv6", lambda y: y >= 1 << 64 and re.search("[a-f]", str(ipaddress.IPv6Address(y))) is not None, back) if re.search("[A-Fa-f]", text) else None
        if n is None:
            n = self.cipher.permute(x, 1 << 128, "ipv6-digits", None, back)
        new = str(ipaddress.IPv6Address(n))
        return new.upper() if text != text.lower() else new

    def _ipv4(self, text, back):
        parts = text.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        x = int.from_bytes(bytes(map(int, parts)), "big")
        return ".".join(map(str, self.cipher.permute(x, 1 << 32, "ipv4", None, back).to_bytes(4, "big")))

    def _ssn(self, text, back):
        valid = lambda y: _valid_ssn(y.replace("-", ""))
        return self._letters(text, "ssn", back, valid=valid) if valid(text) else None

    def _phone(self, text, back):
        """Digits after the country code are permuted together; a number without one is taken as of +1, as its layout says."""
        digits = re.sub(r"\D", "", text)
        code = _country(digits) if text.startswith("+") else "1" if len(digits) == 10 else ""
        own = digits[len(code) :] if text.startswith("+") else digits
        if not code or not 6 <= len(own) <= 15 - len(code) or len(set(own)) == 1:
            return None
        k = _alphabets(own, False)
        x, size = _rank(own, k)
        kind = _numbering(code, own)
        n = self.cipher.permute(x, size, f"phone+{code}/{len(own)}", lambda y: _numbering(code, f"{y:0{len(own)}d}") == kind, back)
        return _laid_out(text, (code if text.startswith("+") else "") + f"{n:0{len(own)}d}")

    def _card(self, text, back):
        digits = re.sub(r"\D", "", text)
        if not luhn(digits) or len(set(digits)) == 1 or digits[0] not in "23456":  # issuers of cards
            return None
        body = digits[1:-1]
        k = _alphabets(body, False)
        x, size = _rank(body, k)

        def whole(y):
            d = digits[0] + _unrank(y, body, k)
            return d + next(c for c in "0123456789" if luhn(d + c))

        y = self.cipher.permute(x, size, f"card{digits[0]}{len(digits)}", lambda y: len(set(whole(y))) > 1, back)
        return _laid_out(text, whole(y))

    def _iso_date(self, text, back):
        return self._calendar(text, "-", ("ymd",), back)

    def _date(self, text, back):
        return self._calendar(text, "/" if "/" in text else ".", ("dmy", "mdy"), back)

    def _calendar(self, text, sep, orders, back):
        """Dates are permuted among those that are written alike: the same order, separator and padding."""

        def kind(t):
            parts = tuple(t.split(sep))
            return next(((o, d, any(len(p) == 1 for p in parts)) for o in orders if (d := _date(parts, o))), None)

        def write(n, order, bare):
            d = datetime.date.fromordinal(n + _DAYS[0])
            v = {"y": str(d.year), "m": str(d.month) if bare else f"{d.month:02d}", "d": str(d.day) if bare else f"{d.day:02d}"}
            return sep.join(v[c] for c in order)

        if (own := kind(text)) is None:
            return None
        order, day, bare = own
        if write(day.toordinal() - _DAYS[0], order, bare) != text:  # padded in part only
            bare = None
        if sep != "/" and not bare and order in ("ymd", "dmy") and bare is not None:  # every day can be written so: one permutation, whichever way it is written
            n = self.cipher.permute(day.toordinal() - _DAYS[0], _DAYS[1] - _DAYS[0], "day", None, back)
            return write(n, order, False)
        same = lambda n: (k := kind(write(n, order, bool(bare)))) and k[0] == order and k[2] == bool(bare)
        n = self.cipher.permute(day.toordinal() - _DAYS[0], _DAYS[1] - _DAYS[0], f"date{sep}{order}{bare}", None if bare is None else same, back)
        return write(n, order, bool(bare))


def _laid_out(text: str, letters: str) -> str:
    """The letters and digits in the places that the text has for them."""
    new = iter(letters)
    return "".join(next(new) if c.isalnum() else c for c in text)


def _country(digits: str) -> str:
    """The telephone country code that a number with one begins with; empty where there is none such."""
    if digits[:1] in _ONE_DIGIT:
        return digits[:1]
    return digits[:2] if digits[:2] in _TWO_DIGITS else "" if digits[:1] == "0" else digits[:3]


def _numbering(code: str, own: str) -> str:
    """What of a number's form stays: whether it fits the plan of +1, or else whether it begins with a zero."""
    if code == "1":
        return "plan" if len(own) == 10 and own[0] > "1" and own[3] > "1" else "other"
    return "0" if own[0] == "0" else "other"


def _is_secret(before: str, value: str) -> bool:
    """An assigned value, or one that no word looks like: ``token: something`` in prose isn't one."""
    return "=" in before or (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)) or (value != value.lower() and value != value.capitalize() and not value.isupper())


_ALONE = {
    "card": re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|[.]\d)"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
}


def _scan(key: str):
    def run(batches):
        names = Pseudonyms(key)
        for b in batches:
            texts, counts, kinds, spans = [], [], [], []
            for t in b.column(1).to_pylist():
                new, found = names.apply(t) if t is not None else (None, [])
                texts.append(new)
                counts.append(len(found))
                kinds.append(",".join(sorted({k for k, *_ in found})))
                spans.append([{"kind": k, "start": s, "stop": e} for k, s, e in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.string()), pa.array(spans, _SPANS)], ["doc_id", "text", "n_values", "kinds", "spans"])

    return run


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def pii_key(spark: SparkSession) -> str:
    """The key of the setting; there is none by default, so that no pseudonym is made with a known one."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"set {KEY_SETTING} to the key of the pseudonyms")
    return key


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, text (values permuted), n_values, kinds, spans (code points of the text given).

    A null text stays null with no values, an empty one empty; every other character of a text stays as it is. Rows are handled
    on their own and whole, however long, so repeated rows give equal results; a null doc_id is carried through; of kinds that
    begin at one place the first of ``Pseudonyms.PATTERN`` wins; an empty table gives an empty result; only doc_id and text
    are read. An address of IPv6 that wasn't written in its shortest spelling comes back in it. The key must not be empty.
    """
    if not key:
        raise ValueError("an empty key")
    source = docs.select(null_safe(docs, "doc_id", "long"), null_safe(docs, "text", "string"))
    return source.mapInArrow(_scan(key), "doc_id long, text string, n_values long, kinds string, spans array<struct<kind:string,start:long,stop:long>>")


_session_keys: dict[str, str] = {}


def pseudonym_report(docs: DataFrame) -> DataFrame:
    """The digest of the registered query. Without a key in the settings one is drawn at random for the application, so
    pseudonyms link documents within it and can't be turned back after it. Edge cases as in ``pseudonymise``."""
    spark = docs.sparkSession
    try:
        key = pii_key(spark)
    except ValueError:
        key = _session_keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))
    return pseudonymise(docs, key).select("doc_id", "text", "n_values", "kinds", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"))
