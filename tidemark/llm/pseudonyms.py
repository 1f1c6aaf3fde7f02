"""Format-preserving pseudonyms for personal numbers, dates, addresses and secrets in texts.

A validated value is numbered within its format and that number is permuted by a keyed Feistel network, so
equal values stay linked across documents, the text keeps its length, and the key's owner can invert it.
"""

from __future__ import annotations

import bisect
import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.frames import unused

ROUNDS = 10
CACHED_VALUES = 50_000
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutation of 0 .. size-1. Each half is shifted by a keyed hash of the other; numbers beyond the
    domain, or outside `accept`, walk on along their cycle."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size, self.key, self.tweak = size, hashlib.blake2b(key, digest_size=32).digest(), tweak.encode()
        self.left = max(1, int(size**0.5) if size < 1 << 50 else 1 << (size.bit_length() // 2))
        self.right = -(-size // self.left)

    def _shift(self, turn: int, half: int) -> int:
        data = b"%d|%d|%b|" % (turn, self.size, self.tweak) + b"%d" % half
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=64).digest())

    def _once(self, x: int, back: bool) -> int:
        a, b = x // self.right, x % self.right
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if turn % 2:
                b = (b + sign * self._shift(turn, a)) % self.right
            else:
                a = (a + sign * self._shift(turn, b)) % self.left
        return a * self.right + b

    def permute(self, x: int, back: bool = False, accept: Callable[[int], bool] = lambda _: True) -> int:
        x = self._once(x, back)
        while x >= self.size or not accept(x):
            x = self._once(x, back)
        return x


def luhn(digits: str) -> int:
    """Sum of the Luhn rule modulo 10; 0 for a valid number."""
    doubled = [int(d) * 2 if k % 2 else int(d) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10


def _refill(layout: str, digits: str) -> str:
    """The layout with its digits replaced in order."""
    supply = iter(digits)
    return "".join(next(supply) if c.isdigit() else c for c in layout)


def _digits(value: str) -> str:
    return "".join(c for c in value if c.isdigit())


def _mixed(values: list[int], sizes: list[int]) -> tuple[int, int]:
    number, size = 0, 1
    for v, s in zip(values, sizes):
        number, size = number * s + v, size * s
    return number, size


def _unmixed(number: int, sizes: list[int]) -> list[int]:
    out = []
    for s in reversed(sizes):
        number, v = divmod(number, s)
        out.append(v)
    return out[::-1]


#: Alphabets whose characters are permuted among themselves; all other characters stay.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýþÿßð", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝÞÐ")
HEX = ("0123456789abcdef",)
_PLACE = {c: (a, k) for a in ALPHABETS for k, c in enumerate(a)}


@dataclass
class Pseudonymiser:
    key: bytes
    back: bool = False
    cache: dict = field(default_factory=dict)

    def _permute(self, kind: str, number: int, size: int, accept=lambda _: True) -> int:
        return Feistel(self.key, kind, size).permute(number, self.back, accept)

    def _letters(self, kind: str, value: str, place: dict) -> str:
        parts = [place.get(c) for c in value]
        sizes = [len(p[0]) for p in parts if p]
        if not sizes:
            return value
        number, size = _mixed([p[1] for p in parts if p], sizes)
        new = iter(zip([p[0] for p in parts if p], _unmixed(self._permute(f"{kind}{sizes}", number, size), sizes)))
        return "".join((lambda x: x[0][x[1]])(next(new)) if p else c for c, p in zip(value, parts))

    # Each returns None where the value is not valid, and is then left alone.

    def card(self, value: str) -> str | None:
        """Luhn-valid numbers of 13 to 19 digits; the last digit stays the check digit."""
        digits = _digits(value)
        if luhn(digits) or len(set(digits)) == 1:
            return None
        body = len(digits) - 1
        new = str(self._permute(f"card{body}", int(digits[:-1]), 10**body)).zfill(body)
        return _refill(value, new + str(-luhn(new + "0") % 10))

    def phone(self, value: str) -> str | None:
        """Digits after the country code; area and exchange codes of ten-digit numbers keep 2 to 9 in front."""
        lead = re.match(r"\+\d{1,3}(?=\D)|\+1|\+\d\d", value)
        lead = lead[0] if lead else ""
        digits = _digits(value[len(lead) :])
        if not 6 <= len(digits) <= 14:
            return None
        lows = [2 if len(digits) == 10 and k in (0, 3) and digits[k] > "1" else 0 for k in range(len(digits))]
        sizes = [10 - low for low in lows]
        number, size = _mixed([int(d) - low for d, low in zip(digits, lows)], sizes)
        new = _unmixed(self._permute(f"phone{lead}{sizes}", number, size), sizes)
        return lead + _refill(value[len(lead) :], "".join(str(v + low) for v, low in zip(new, lows)))

    def ip(self, value: str) -> str | None:
        """IPv4 addresses, permuted among those with octets of the same lengths, so that the text keeps its layout."""
        octets = value.split(".")
        if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
            return None
        lows = [{1: 0, 2: 10, 3: 100}[len(o)] for o in octets]
        sizes = [{1: 10, 2: 90, 3: 156}[len(o)] for o in octets]
        number, size = _mixed([int(o) - low for o, low in zip(octets, lows)], sizes)
        return ".".join(str(v + low) for v, low in zip(_unmixed(self._permute(f"ip{sizes}", number, size), sizes), lows))

    def ssn(self, value: str) -> str | None:
        """Social security numbers: area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
        area, group, serial = (int(p) for p in re.split("[- ]", value))
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return None
        sizes = [898, 99, 9999]
        number, size = _mixed([area - 1 - (area > 666), group - 1, serial - 1], sizes)
        a, g, s = _unmixed(self._permute("ssn", number, size), sizes)
        return _refill(value, f"{a + 1 + (a >= 665):03d}{g + 1:02d}{s + 1:04d}")

    def iban(self, value: str) -> str | None:
        """Account numbers valid modulo 97: the part after the check digits is permuted, which are computed anew."""
        plain = value.replace(" ", "")
        check = lambda p: int("".join(str(int(c, 36)) for c in p[4:] + p[:4])) % 97
        if not 15 <= len(plain) <= 34 or check(plain) != 1:
            return None
        body = self._letters(f"iban{plain[:2]}", plain[4:], _PLACE)
        new = plain[:2] + f"{98 - check(plain[:2] + '00' + body):02d}" + body
        supply = iter(new)
        return "".join(next(supply) if c != " " else c for c in value)

    def date(self, value: str) -> str | None:
        """Calendar dates 1900 to 2099; with slashes a result must be read in the same order as the value."""

        def read(text: str) -> tuple[str, dt.date] | None:
            a, b, c = re.split(r"[-/.]", text)
            try:
                if len(a) == 4:
                    return "ymd", dt.date(int(a), int(b), int(c))
                if int(b) > 12:
                    return "mdy", dt.date(int(c), int(a), int(b))
                return "dmy", dt.date(int(c), int(b), int(a))
            except ValueError:
                return None

        got = read(value)
        if got is None or not FIRST_DAY <= got[1].toordinal() <= LAST_DAY:
            return None
        widths = [len(p) for p in re.split(r"[-/.]", value)]
        mark = re.search(r"[-/.]", value)[0]

        def write(number: int) -> str:
            day = dt.date.fromordinal(FIRST_DAY + number)
            parts = {"ymd": (day.year, day.month, day.day), "mdy": (day.month, day.day, day.year), "dmy": (day.day, day.month, day.year)}[got[0]]
            return mark.join(str(p).zfill(2 if w > 1 else 1) for p, w in zip(parts, widths))

        accept = lambda n: len(text := write(n)) == len(value) and [len(p) for p in text.split(mark)] == widths and read(text)[0] == got[0]
        return write(self._permute("date", got[1].toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, accept))

    def email(self, value: str) -> str | None:
        """All but the signs and the last label, each character within its alphabet."""
        head, _, top = value.rpartition(".")
        name, _, host = head.partition("@")
        return self._letters("name", name, _PLACE) + "@" + self._letters("host", host, _PLACE) + "." + top

    def secret(self, value: str) -> str | None:
        """Quoted values of token, key, secret and password settings; hexadecimal ones stay hexadecimal."""
        place = {c: (a, k) for a in HEX for k, c in enumerate(a)} if re.fullmatch("[0-9a-f]+", value) else _PLACE
        return self._letters("secret", value, place)

    def value(self, kind: str, value: str) -> str | None:
        known = (kind, value)
        if known not in self.cache:
            if len(self.cache) >= CACHED_VALUES:
                self.cache.clear()
            self.cache[known] = getattr(self, kind)(value)
        return self.cache[known]

    def text(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and the kind, start and end (characters) of each."""
        taken: list[tuple[int, int, str, str]] = []
        for kind, pattern, needs in PATTERNS:
            if needs and needs not in text:
                continue
            for m in pattern.finditer(text):
                start, end = m.span("value" if "value" in pattern.groupindex else 0)
                new = self.value(kind, text[start:end])
                place = bisect.bisect_left(taken, (start,))
                free = (place == len(taken) or taken[place][0] >= end) and (not place or taken[place - 1][1] <= start)
                if new is not None and free:
                    taken.insert(place, (start, end, kind, new))
        out, at = [], 0
        for start, end, _, new in taken:
            out += [text[at:start], new]
            at = end
        return "".join([*out, text[at:]]), [(kind, start, end) for start, end, kind, _ in taken]


#: (kind, pattern, a sign without which it cannot match), earlier kinds first where they overlap. The group `value`, where there is one, is the value.
PATTERNS = [
    ("secret", re.compile(r"""(?i:\b(?:\w*(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key))\b["']?\s*[:=]\s*["'])(?P<value>[^\s"']{6,})(?=["'])"""), ""),
    ("email", re.compile(r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b"), "@"),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"), ""),
    ("card", re.compile(r"(?<![0-9A-Za-z])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![0-9A-Za-z])"), ""),
    ("ip", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"), "."),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), "-"),
    ("date", re.compile(r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\w/-]|\.\d)"), ""),
    ("phone", re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-]|\.\d)"), ""),
]
DIGIT_OR_AT = re.compile(r"[0-9@]")
SETTING = re.compile(r"[:=]\s*[\"']")


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str = "pii") -> DataFrame:
    """All columns of `docs` with the text replaced, and `found`: kind, start and end (characters) of each value.

    Lengths and all other characters stay. Equal values get equal pseudonyms everywhere, whatever their
    separators. Null and empty texts, and texts without a valid value, stay as they are (null too), with an empty list.
    Rows that repeat are treated alike; an existing column called as `found` is replaced.
    """
    rest = [c for c in docs.columns if c not in (text, found)]
    body = unused(docs.columns, "_body")
    spans = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    secret = key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Pseudonymiser(secret)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                done = [work.text(t) if t and (DIGIT_OR_AT.search(t) or SETTING.search(t)) else (t, []) for t in part.column(0).to_pylist()]
                lists = [[dict(zip(("kind", "start", "end"), x)) for x in d[1]] for d in done]
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), *part.columns[1:], pa.array(lists, kind)], names=[body, *part.schema.names[1:], found])

    frame = docs.select(F.col(f"`{text}`").alias(body), *[F.col(f"`{c}`") for c in rest])
    schema = T.StructType([T.StructField(body, T.StringType()), *frame.schema[1:], T.StructField(found, spans)])
    mapped = frame.mapInArrow(run, schema)
    return mapped.select(*[F.col(f"`{body}`").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c != found], found)
