"""Format-preserving pseudonyms of personal data by a keyed Feistel network.

A value is found by its pattern and validated (Luhn for cards, mod 97 for IBANs, calendar for dates, octets for
addresses, ranges for social security numbers). Its digits, or its day number, are an integer x below N; the pseudonym
is the integer g^-1(g(x) + 1 mod N) written in the same format, g being a keyed Feistel permutation of 0..N-1. That is
again a keyed permutation, and one without fixed points, so no value stays as it was. Where a format has further rules,
the permutation is repeated until they hold (cycle walking), which keeps it a bijection on valid values; check digits
are computed anew. Equal values get equal pseudonyms in all documents, whatever separators they are written with; a phone
number of ten digits without a country code counts as one of code 1. Dates keep the order and the widths of their parts:
days that would be read in another order, or take more digits, aren't valid for the format. So a date has the same
pseudonym in all formats of full width, and another one where it is written with a single digit or month first.

Nulls and edge cases: a null text stays null with no values; texts without values come back unchanged; repeated rows are
treated alike; an empty table gives no rows; other columns are ignored. Letters of an e-mail's local part are permuted
within a-z, A-Z and Latin-1 letters; its domain stays.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import table

ROUNDS = 8
#: The key of the registered query, for test tables. It is public: real data need one of their own.
QUERY_KEY = "tallyforge-demo-key"
#: Country codes of one and two digits; all others have three.
CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
KINDS = ("email", "phone", "address", "date", "ssn", "card", "iban")


class Feistel:
    """A keyed permutation of 0..n-1: a balanced network over a x b >= n with cycle walking."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n, self.a = n, isqrt(n - 1) + 1
        self.b = -(-n // self.a)
        self.key, self.tweak = key, tweak.encode()

    def _mix(self, i: int, x: int) -> int:
        h = hashlib.blake2b(b"%s|%d|%d|%d" % (self.tweak, self.n, i, x), key=self.key, digest_size=24)
        return int.from_bytes(h.digest(), "big")

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in range(ROUNDS):
            if i % 2:
                right = (right + self._mix(i, left)) % self.b
            else:
                left = (left + self._mix(i, right)) % self.a
        return left * self.b + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in reversed(range(ROUNDS)):
            if i % 2:
                right = (right - self._mix(i, left)) % self.b
            else:
                left = (left - self._mix(i, right)) % self.a
        return left * self.b + right

    def forward(self, x: int) -> int:
        x = self._once(x)
        while x >= self.n:
            x = self._once(x)
        return x

    def backward(self, x: int) -> int:
        x = self._back(x)
        while x >= self.n:
            x = self._back(x)
        return x

    def shifted(self, x: int, valid: Callable[[int], bool] = lambda x: True) -> int:
        """The pseudonym of x among the valid values; another value unless x is the only one."""
        at = self.forward(x)
        while True:
            at = (at + 1) % self.n
            y = self.backward(at)
            if y == x or valid(y):
                return y

    def unshifted(self, y: int, valid: Callable[[int], bool] = lambda x: True) -> int:
        at = self.forward(y)
        while True:
            at = (at - 1) % self.n
            x = self.backward(at)
            if x == y or valid(x):
                return x


def luhn_sum(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdecimal())


def _refill(text: str, digits: str) -> str:
    """text with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdecimal() else c for c in text)


_LETTERS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(map(chr, [*range(0xE0, 0xF7), *range(0xF8, 0x100)])), "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)])))
_CLASS = {c: alphabet for alphabet in _LETTERS for c in alphabet}

_PATTERN = re.compile(
    r"(?P<phone>(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w|\.\d)|(?<![\w(])(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-]))"
    r"|(?<![\w.])(?P<address>\d{1,3}(?:\.\d{1,3}){3})(?!\w|\.\d)"
    r"|(?<![\w./-])(?P<date>\d{4}-\d{2}-\d{2}(?=T\d|(?!\w|-\d))|\d{4}/\d{2}/\d{2}(?!\w|/\d)|\d{1,2}\.\d{1,2}\.\d{4}(?!\w|\.\d)|\d{1,2}/\d{1,2}/\d{4}(?!\w|/\d))"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?!\w|-\d)"
    r"|(?<!\w)(?P<card>\d{13,19}|\d{4}([ -])\d{4}\6\d{4}\6\d{1,7}|\d{4}([ -])\d{6}\7\d{5})(?!\w)"
    r"|(?<!\w)(?P<iban>[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)(?!\w)",
    re.ASCII,
)
_LOCAL = re.compile(r"[\w.+%-]+\Z")
_DOMAIN = re.compile(r"@((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})")
_DIGIT = re.compile(r"[0-9]")
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Pseudonyms:
    """Pseudonyms of single values under a key; every method gives None for a value that isn't valid."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()
        self.of = lru_cache(100_000)(self._of)

    def _feistel(self, tweak: str, n: int) -> Feistel:
        return Feistel(self.key, tweak, n)

    def _of(self, kind: str, value: str) -> str | None:
        return getattr(self, kind)(value)

    def email(self, value: str) -> str | None:
        local, _, domain = value.rpartition("@")
        places = [(i, _CLASS[c]) for i, c in enumerate(local) if c in _CLASS]
        if not places:
            return None
        x, n = 0, 1
        for i, alphabet in places:
            x, n = x * len(alphabet) + alphabet.index(local[i]), n * len(alphabet)
        shape = "".join(str(_LETTERS.index(_CLASS[c])) if c in _CLASS else c for c in local)
        y, out = self._feistel(f"email {shape}", n).shifted(x), list(local)
        for i, alphabet in reversed(places):
            y, k = divmod(y, len(alphabet))
            out[i] = alphabet[k]
        return f"{''.join(out)}@{domain}"

    def phone(self, value: str) -> str | None:
        digits, kept = _digits(value), 0
        if value.startswith("+"):
            kept = next((k for k in (1, 2) if digits[:k] in CODES), 3)
        own = digits[kept:]
        if not 7 <= len(digits) <= 15 or len(own) < 4:
            return None
        code = digits[:kept] or ("1" if len(own) == 10 else "")
        return _refill(value, digits[:kept] + f"{self._feistel(f'phone {code}', 10 ** len(own)).shifted(int(own)):0{len(own)}}")

    def address(self, value: str) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        y = self._feistel("address", 1 << 32).shifted(int.from_bytes(map(int, parts), "big"))
        return ".".join(map(str, y.to_bytes(4, "big")))

    def date(self, value: str) -> str | None:
        texts, seps = re.split(r"[./-]", value), re.findall(r"[./-]", value)
        year_first = len(texts[0]) == 4
        month_first = seps[0] == "/" and not year_first and int(texts[1]) > 12
        y, m, d = (0, 1, 2) if year_first else (2, 0, 1) if month_first else (2, 1, 0)
        try:
            day = datetime.date(int(texts[y]), int(texts[m]), int(texts[d])).toordinal()
        except ValueError:
            return None
        if not _FIRST_DAY <= day <= _LAST_DAY:
            return None

        def written(x: int) -> list[str] | None:
            """The parts of a day in the format of the value, None if it doesn't fit."""
            new, out = datetime.date.fromordinal(_FIRST_DAY + x), ["", "", ""]
            for k, part in ((y, new.year), (m, new.month), (d, new.day)):
                out[k] = f"{part:0{len(texts[k])}}"
            return out if all(map(lambda a, b: len(a) == len(b), out, texts)) and (not month_first or new.day > 12) else None

        out = written(self._feistel("date", _LAST_DAY - _FIRST_DAY + 1).shifted(day - _FIRST_DAY, lambda x: written(x) is not None))
        return out[0] + seps[0] + out[1] + seps[1] + out[2]

    def ssn(self, value: str) -> str | None:
        good = lambda x: 0 < x // 10**6 < 900 and x // 10**6 != 666 and x // 10**4 % 100 and x % 10**4
        x = int(_digits(value))
        return _refill(value, f"{self._feistel('ssn', 10**9).shifted(x, good):09}") if good(x) else None

    def card(self, value: str) -> str | None:
        digits = _digits(value)
        if luhn_sum(digits) % 10 or not digits.strip("0"):
            return None
        body = digits[:-1]
        new = f"{self._feistel('card', 10 ** len(body)).shifted(int(body), lambda x: x > 0):0{len(body)}}"
        return _refill(value, new + str(-luhn_sum(new + "0") % 10))

    def iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        body = plain[4:]
        places = [i for i, c in enumerate(body) if c.isdecimal()]
        if not places:
            return None
        old = "".join(body[i] for i in places)
        shape = "".join("0" if c.isdecimal() else c for c in body)
        new = f"{self._feistel(f'iban {plain[:2]} {shape}', 10 ** len(old)).shifted(int(old)):0{len(old)}}"
        body = _refill(body, new)
        check = 98 - number(body + plain[:2] + "00") % 97
        it = iter(f"{plain[:2]}{check:02}{body}")
        return "".join(c if c == " " else next(it) for c in value)


def find(text: str, names: Pseudonyms) -> list[tuple[str, int, int, str]]:
    """Valid values (kind, start, end, pseudonym), leftmost, not overlapping; e-mail addresses first.

    Behind a candidate that isn't valid the search goes on at its second character.
    """
    mails, at = [], text.find("@")
    while at >= 0:
        domain, low = _DOMAIN.match(text, at), mails[-1][2] if mails else 0
        start = at
        while start > low and (text[start - 1].isalnum() or text[start - 1] in "_.+%-"):
            start -= 1
        while start < at and text[start] in ".-":
            start += 1
        new = names.of("email", text[start : domain.end()]) if domain and start < at else None
        if new is not None:
            mails.append(("email", start, domain.end(), new))
        at = text.find("@", domain.end() if domain else at + 1)
    spans, at, k = list(mails), 0, 0
    while _DIGIT.search(text, at) and (m := _PATTERN.search(text, at)):
        start, end = m.span()
        while k < len(mails) and mails[k][2] <= start:
            k += 1
        if k < len(mails) and mails[k][1] < end:
            at = max(mails[k][2], start + 1)
            continue
        kind = next(x for x in KINDS if x != "email" and m[x])
        new = names.of(kind, m[0])
        if new is not None:
            spans.append((kind, start, end, new))
        at = start + 1 if new is None else end
    return sorted(spans, key=lambda s: s[1])


def pseudonymised(text: str, names: Pseudonyms) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with all valid values replaced, and their spans in the source."""
    out, spans, at = [], [], 0
    for kind, start, end, new in find(text, names):
        out += (text[at:start], new)
        spans.append((kind, start, end))
        at = end
    return ("".join(out) + text[at:] if spans else text), spans


def masked(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: key, text with pseudonyms, n_values and their spans (kind:start:end in the source text).

    Who has the secret can undo the pseudonyms; an empty one is refused.
    """
    if not secret:
        raise ValueError("pseudonyms need a secret key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(secret)
        for batch in batches:
            texts, counts, spans = [], [], []
            for value in batch.column(1).to_pylist():
                new, found = (None, []) if value is None else pseudonymised(value, names)
                texts.append(new)
                counts.append(len(found))
                spans.append(",".join(f"{k}:{a}:{b}" for k, a, b in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(spans, pa.string())], names=["key", "text", "n_values", "spans"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, text string, n_values long, spans string").withColumnRenamed("key", key)


def query(spark, sf_dir):
    """op10: all documents with pseudonyms, under the key of ``spark.tallyforge.pii.key``, else the query's own."""
    return masked(table(spark, sf_dir, "documents"), spark.conf.get("spark.tallyforge.pii.key", QUERY_KEY))
