"""Format-preserving pseudonyms for personal data.

Values are found by pattern and validated: card numbers and IBANs by their check digits,
phone and social security numbers and addresses of machines by their parts, dates by the
calendar. A valid value is its rank among all valid values of its format. A keyed Feistel
network permutes the ranks, walking on while it lands outside, so equal values get equal
pseudonyms in every document, different values of a format get different ones, a pseudonym
is valid again (check digits are recomputed), and whoever has the key can reverse it. Mail
addresses and secrets (access keys, values of ``password=``, ``API_KEY =`` and the like in any case) are
permuted letter by letter class, mail addresses under their top-level domain. Numbers in the
format of a card or a phone that are not valid are permuted among those that are not.

Each row is worked on by itself, without a shuffle. Null texts stay null, empty ones empty,
repeated rows get equal results; other columns are carried along where the caller asks for
them. A value in a very short format (two letters, say) may be its own pseudonym, as in any
permutation. Patterns start only where a value can start and do not step back, so very long
texts take time in proportion to their length.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date", "secret")

#: The formats. A name in a group tells the kind.
_FORMATS = {
    "email": r"(?<![\w.%+-])([A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*+)\.)++[A-Za-z]{2,24})(?![\w-])",
    "akia": r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[0-9A-Z]{16})(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?+([^\s\"',;<>]{6,}+)",
    "iban": r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "date": r"(?<![\d./-])(\d{4}(?P<s>[-/.])\d{1,2}(?P=s)\d{1,2}|\d{1,2}(?P<t>[-/.])\d{1,2}(?P=t)\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d.-])(\d{3}-\d{2}-\d{4})(?![\d-])",
    "ip": r"(?<![\d.])(\d{1,3}(?:\.\d{1,3}){3})(?!\d|\.\d)",
    "card": r"(?<![\w.-])(\d(?:[ -]?\d){12,18})(?!\d|-\d)",
    "phone": r"(?<![\w+])((?:\+1[ .-]?|1[.-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4})(?![\d-])",
    "far": r"(?<![\w+])(\+[1-9]\d{0,2}(?:[ .-]?\(?\d{1,5}\)?){2,6})(?![\d-])",
}
_PATTERNS = {kind: re.compile(pattern) for kind, pattern in _FORMATS.items()}
#: Where a value may start: a cheap look ahead, so that few places are tried with all formats.
_START = re.compile(
    r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@|(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]|[A-Z]{2}\d\d|"
    r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[=:])|(?<![\w.])[(+]?\d(?=[\d.()/ -]{6})"
)
_MAYBE = re.compile(r"@|\d[\d .()/-]{5}|AKIA|ASIA|[=:]\s{0,3}[\"']?\S{6}")


class Feistel:
    """A keyed permutation of ``range(size)`` for any size and tweak."""

    def __init__(self, key: bytes):
        self.key = key

    def _draw(self, tweak: str, turn: int, half: int, size: int) -> int:
        text = f"{tweak}|{turn}|{half}|{size}".encode()
        wide = (size.bit_length() + 71) // 8
        block = b""
        while len(block) < wide:
            block += hmac.new(self.key, text + b"|%d" % len(block), hashlib.sha256).digest()
        return int.from_bytes(block[:wide], "big")

    def _once(self, x: int, a: int, b: int, tweak: str, back: bool) -> int:
        left, right = divmod(x, b)
        turns = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
        sign = -1 if back else 1
        for turn in turns:
            if turn % 2 == 0:
                left = (left + sign * self._draw(tweak, turn, right, a)) % a
            else:
                right = (right + sign * self._draw(tweak, turn, left, b)) % b
        return left * b + right

    def permute(self, x: int, size: int, tweak: str, back: bool = False) -> int:
        if size < 2:
            return x
        import math

        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        x = self._once(x, a, b, tweak, back)
        while x >= size:
            x = self._once(x, a, b, tweak, back)
        return x


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_rest(code: str) -> int:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def _refill(shape: str, letters: str) -> str:
    """``shape`` with its letters and digits replaced in turn."""
    fresh = iter(letters)
    return "".join(next(fresh) if c.isalnum() else c for c in shape)


def _rank(values: list[int], sizes: list[int]) -> tuple[int, int]:
    x, size = 0, 1
    for v, s in zip(values, sizes):
        x, size = x * s + v, size * s
    return x, size


def _unrank(x: int, sizes: list[int]) -> list[int]:
    out = []
    for s in reversed(sizes):
        x, v = divmod(x, s)
        out.append(v)
    return out[::-1]


_DIGITS = "0123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2099, 12, 31).toordinal() - _FIRST_DAY + 1
#: Addresses that are the same everywhere stay as they are.
_NO_ONES = {"0.0.0.0", "127.0.0.1", "255.255.255.255"}


class Pseudonyms:
    """Replaces what is valid; ``back`` reverses."""

    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.back = Feistel(key), back

    def _move(self, values: list[int], sizes: list[int], tweak: str) -> list[int]:
        x, size = _rank(values, sizes)
        return _unrank(self.feistel.permute(x, size, tweak, self.back), sizes)

    def _letters(self, text: str, tweak: str) -> str:
        """Letters and digits permuted within their classes; other characters stay."""
        own = [c for c in text if c.isascii() and c.isalnum()]
        # Letters of a long hexadecimal number stay such, so it stays one.
        lower = _LOWER[:6] if len(own) >= 16 and all(c in _DIGITS or c in _LOWER[:6] for c in own) else _LOWER
        sets = [_DIGITS if c in _DIGITS else lower if c in _LOWER else _UPPER for c in own]
        shape = "".join("d" if s is _DIGITS else "l" if s is lower else "u" for s in sets) + str(len(lower))
        moved = self._move([s.index(c) for s, c in zip(sets, own)], [len(s) for s in sets], f"{tweak}|{shape}|{len(own)}")
        fresh = iter(s[v] for s, v in zip(sets, moved))
        return "".join(next(fresh) if c.isascii() and c.isalnum() else c for c in text)

    def email(self, text: str) -> str:
        name, _, top = text.rpartition(".")
        return f"{self._letters(name, 'email|' + top.lower())}.{top}"

    def akia(self, text: str) -> str:
        return text[:4] + self._letters(text[4:], "akia")

    def secret(self, text: str) -> str:
        return self._letters(text, "secret")

    def iban(self, text: str) -> str | None:
        code = text.replace(" ", "")
        if not 15 <= len(code) <= 34 or iban_rest(code) != 1:
            return None
        body = self._letters(code[4:], "iban|" + code[:2])
        check = 98 - iban_rest(code[:2] + "00" + body)
        return _refill(text, f"{code[:2]}{check:02d}{body}")

    def _walk(self, digits: str, inside: Callable[[str], bool], tweak: str) -> str:
        """Digits permuted among those of the same length that ``inside`` holds for."""
        size = 10 ** len(digits)
        x = self.feistel.permute(int(digits), size, tweak, self.back)
        while not inside(f"{x:0{len(digits)}d}"):
            x = self.feistel.permute(x, size, tweak, self.back)
        return f"{x:0{len(digits)}d}"

    def card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if luhn_digit(digits[:-1]) != digits[-1]:
            # No card, but as long a number names someone too: among those that are none.
            return _refill(text, self._walk(digits, lambda d: luhn_digit(d[:-1]) != d[-1], f"number|{len(digits)}"))
        middle = self._move([int(c) for c in digits[1:-1]], [10] * (len(digits) - 2), f"card|{digits[0]}|{len(digits)}")
        moved = digits[0] + "".join(map(str, middle))
        return _refill(text, moved + luhn_digit(moved))

    def ssn(self, text: str) -> str | None:
        area, group, serial = (int(x) for x in text.split("-"))
        areas = [n for n in range(1, 900) if n != 666]
        if area not in areas or not group or not serial:
            return None
        a, g, s = self._move([areas.index(area), group - 1, serial - 1], [len(areas), 99, 9999], "ssn")
        return f"{areas[a]:03d}-{g + 1:02d}-{s + 1:04d}"

    def phone(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        lead, own = digits[:-10], digits[-10:]
        if own[0] in "01" or own[3] in "01":
            return _refill(text, lead + self._walk(own, lambda d: d[0] in "01" or d[3] in "01", "no phone"))
        values = [int(c) - (2 if i in (0, 3) else 0) for i, c in enumerate(own)]
        moved = self._move(values, [8 if i in (0, 3) else 10 for i in range(10)], "phone")
        return _refill(text, lead + "".join(str(v + (2 if i in (0, 3) else 0)) for i, v in enumerate(moved)))

    def far(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if not 8 <= len(digits) <= 15:
            return None
        moved = self._move([int(c) for c in digits[2:]], [10] * (len(digits) - 2), f"far|{digits[:2]}|{len(digits)}")
        return _refill(text, digits[:2] + "".join(map(str, moved)))

    def ip(self, text: str) -> str | None:
        parts = [int(x) for x in text.split(".")]
        if max(parts) > 255 or text in _NO_ONES or any(p != str(int(p)) for p in text.split(".")):
            return None
        while True:
            parts = self._move(parts, [256] * 4, "ip")
            moved = ".".join(map(str, parts))
            if moved not in _NO_ONES:
                return moved

    def date(self, text: str) -> str | None:
        mark = re.search(r"\D", text)[0]
        parts = text.split(mark)
        order = "ymd" if len(parts[0]) == 4 else "dmy"
        made = _as_date(parts, order)
        if made is None and order == "dmy":
            order = "mdy"
            made = _as_date(parts, order)
        if made is None or not 1900 <= made.year <= 2099:
            return None
        if order == "mdy":  # read this way only if the day is over 12, and kept so
            days = _late_days()
            fresh = datetime.date.fromordinal(days[self.feistel.permute(_late_rank()[made.toordinal()], len(days), "mdy", self.back)])
        else:
            x = self.feistel.permute(made.toordinal() - _FIRST_DAY, _DAYS, f"date|{order}", self.back)
            fresh = datetime.date.fromordinal(x + _FIRST_DAY)
        padded = all(len(p) > 1 for p in parts)
        spelled = {"y": f"{fresh.year:04d}", "m": f"{fresh.month:02d}" if padded else str(fresh.month), "d": f"{fresh.day:02d}" if padded else str(fresh.day)}
        return mark.join(spelled[c] for c in order)

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with its values replaced, and how many of each kind."""
        counts: dict[str, int] = {}
        if not _MAYBE.search(text):
            return text, counts

        parts, at, done = [], 0, 0
        while start := _START.search(text, at):
            at = start.start()
            for kind, pattern in _PATTERNS.items():
                match = pattern.match(text, at)
                fresh = getattr(self, kind)(match[1]) if match else None
                if fresh is not None:
                    shown = {"akia": "secret", "far": "phone"}.get(kind, kind)
                    counts[shown] = counts.get(shown, 0) + 1
                    parts += [text[done : match.start(1)], fresh]
                    at = done = match.end(1)
                    break
            else:
                at += 1
        return "".join([*parts, text[done:]]), counts


def _as_date(parts: list[str], order: str) -> datetime.date | None:
    named = dict(zip(order, map(int, parts)))
    if not 1 <= named["m"] <= 12 or not 1 <= named["d"] <= 31 or not 1 <= named["y"]:
        return None
    if named["d"] > calendar.monthrange(named["y"], named["m"])[1]:
        return None
    return datetime.date(named["y"], named["m"], named["d"])


@lru_cache(1)
def _late_days() -> list[int]:
    return [n for n in range(_FIRST_DAY, _FIRST_DAY + _DAYS) if datetime.date.fromordinal(n).day > 12]


@lru_cache(1)
def _late_rank() -> dict[int, int]:
    return {n: i for i, n in enumerate(_late_days())}


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``text`` with pseudonyms, and ``n_<kind>`` for each kind."""
    kinds = list(KINDS)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema += ", text string, " + ", ".join(f"n_{k} long" for k in kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key, back)
        for batch in batches:
            done = [(None, {}) if t is None else own.replace(t) for t in batch.column(len(keep)).to_pylist()]
            arrays = [batch.column(i) for i in range(len(keep))]
            arrays.append(pa.array([t for t, _ in done], pa.string()))
            arrays += [pa.array([c.get(k, 0) for _, c in done], pa.int64()) for k in kinds]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "text", *(f"n_{k}" for k in kinds)])

    carried = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    return docs.select(*carried, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
