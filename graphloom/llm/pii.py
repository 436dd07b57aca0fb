"""Personal data replaced by format-preserving Feistel pseudonyms."""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import col, slices

ROUNDS = 10
LETTERS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]


class Feistel:
    """Keyed permutations of the integers below n, for any n."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, n: int, i: int, half: int) -> int:
        text = b"%d:%d:%d:" % (n, i, half) + tweak
        return int.from_bytes(hashlib.blake2b(text, key=self.key, digest_size=64).digest(), "big")

    def _once(self, x: int, n: int, tweak: bytes, back: bool) -> int:
        # x is (left, right) in mixed radix; the rounds add a keyed function of one half to the other.
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        left, right = divmod(x, b)
        for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            if i % 2:
                right = (right + (-1 if back else 1) * self._round(tweak, n, i, left)) % b
            else:
                left = (left + (-1 if back else 1) * self._round(tweak, n, i, right)) % a
        return left * b + right

    def _walk(self, x: int, n: int, tweak: bytes, back: bool) -> int:
        x = self._once(x, n, tweak, back)
        while x >= n:  # the halves' domain is slightly larger than n: walk on until inside
            x = self._once(x, n, tweak, back)
        return x

    def permute(self, x: int, n: int, tweak: bytes, back: bool = False) -> int:
        """A permutation that moves every x (for n > 1): one step along the cycle that the Feistel network orders."""
        if n < 2:
            return x
        return self._walk((self._walk(x, n, tweak, False) + (-1 if back else 1)) % n, n, tweak, True)


def luhn_digit(digits: str) -> str:
    """The digit that makes digits + it pass the Luhn check."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 - i % 2)
        total += v - 9 * (v > 9)
    return str(-total % 10)


def refill(pattern: str, digits: str) -> str:
    """pattern with its digits replaced, in order."""
    each = iter(digits)
    return "".join(next(each) if c.isdigit() else c for c in pattern)


def iban_value(country: str, check: str, rest: str) -> int:
    return int("".join(str(int(c, 36)) for c in rest + country + check))


Change = Callable[["Feistel", re.Match, bool], "str | None"]


def card(f: Feistel, m: re.Match, back: bool) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = str(f.permute(int(digits[:-1]), 10 ** (len(digits) - 1), b"card%d" % len(digits), back)).zfill(len(digits) - 1)
    return refill(m[0], body + luhn_digit(body))


def phone(f: Feistel, m: re.Match, back: bool) -> str | None:
    prefix, local = m["prefix"] or "", m[0][len(m["prefix"] or "") :]
    digits = re.sub(r"\D", "", local)
    code = re.sub(r"\D", "", prefix) or "1"
    if not 7 <= len(digits) <= 12:
        return None
    return prefix + refill(local, str(f.permute(int(digits), 10 ** len(digits), f"phone{code}:{len(digits)}".encode(), back)).zfill(len(digits)))


def ssn(f: Feistel, m: re.Match, back: bool) -> str | None:
    def good(area: int, group: int, serial: int) -> bool:
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    a, g, s = map(int, m[0].split("-"))
    if not good(a, g, s):
        return None
    area = a - 1 - (a > 666)
    x = f.permute((area * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, b"ssn", back)
    x, s = divmod(x, 9999)
    area, g = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{g + 1:02d}-{s + 1:04d}"


def ip(f: Feistel, m: re.Match, back: bool) -> str | None:
    parts = m[0].split(".")
    if any(int(p) > 255 or (p[0] == "0" and len(p) > 1) for p in parts):
        return None
    return ".".join(map(str, f.permute(int.from_bytes(bytes(map(int, parts)), "big"), 2**32, b"ip", back).to_bytes(4, "big")))


COMMON = (datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal())


def moved_day(f: Feistel, day: datetime.date, back: bool) -> datetime.date:
    """Days of 1900 to 2099 stay among these; others stay among the others."""
    low, high = COMMON
    n, day = day.toordinal(), datetime.date.fromordinal
    if low <= n < high:
        return day(low + f.permute(n - low, high - low, b"date", back))
    last = datetime.date.max.toordinal()
    x = f.permute(n - 1 if n < low else n - 1 - (high - low), last - (high - low), b"far date", back) + 1
    return day(x if x < low else x + (high - low))


def iso_date(f: Feistel, m: re.Match, back: bool) -> str | None:
    try:
        day = datetime.date(int(m["y"]), int(m["m"]), int(m["d"]))
    except ValueError:
        return None
    day = moved_day(f, day, back)
    return f"{day.year:04d}{m['sep']}{day.month:02d}{m['sep']}{day.day:02d}"


def day_first(f: Feistel, m: re.Match, back: bool) -> str | None:
    """dd/mm/yyyy where that is a date, else mm/dd/yyyy where that is one; those stay such that only mm/dd is one."""
    a, b, y, sep = int(m["a"]), int(m["b"]), int(m["year"]), m["s"]
    try:
        day = moved_day(f, datetime.date(y, b, a), back)
        return f"{day.day:02d}{sep}{day.month:02d}{sep}{day.year:04d}"
    except ValueError:
        pass
    try:
        day = moved_day(f, datetime.date(y, a, b), back)
    except ValueError:
        return None
    while day.day <= 12:
        day = moved_day(f, day, back)
    return f"{day.month:02d}{sep}{day.day:02d}{sep}{day.year:04d}"


def spread(f: Feistel, text: str, tweak: str, back: bool, kinds: list[str]) -> str:
    """The characters that are of these kinds permuted jointly, each within its kind; the rest stays."""
    x, n, at = 0, 1, []
    shape = []
    for i, c in enumerate(text):
        for k in kinds:
            if c in k:
                x, n = x * len(k) + k.index(c), n * len(k)
                at.append((i, k))
                shape.append(k[0])
                break
        else:
            shape.append("." + c)
    x = f.permute(x, n, (tweak + "".join(shape)).encode(), back)
    out = list(text)
    for i, k in reversed(at):
        x, r = divmod(x, len(k))
        out[i] = k[r]
    return "".join(out)


def iban(f: Feistel, m: re.Match, back: bool) -> str | None:
    text = m[0].replace(" ", "")
    country, check, rest = text[:2], text[2:4], text[4:]
    if not 11 <= len(rest) <= 30 or iban_value(country, check, rest) % 97 != 1:
        return None
    rest = spread(f, rest, "iban" + country, back, LETTERS)
    check = f"{98 - iban_value(country, '00', rest) % 97:02d}"
    each = iter(country + check + rest)
    return "".join(" " if c == " " else next(each) for c in m[0])


def secret(f: Feistel, m: re.Match, back: bool) -> str | None:
    text = m[0]
    if text.isdigit() or not any(c.isdigit() for c in text) or (text != text.lower() and text != text.upper()):
        return None
    alphabet = "0123456789abcdef" if text == text.lower() else "0123456789ABCDEF"
    while True:  # a value without letters, or without digits, would not be found again
        text = spread(f, text, "secret", back, [alphabet])
        if any(c.isdigit() for c in text) and any(c.isalpha() for c in text):
            return text


#: In order of preference where matches overlap and begin alike.
KINDS: list[tuple[str, str, Change]] = [
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", iban),
    ("date", r"(?<![\d.\-/])(?P<y>\d{4})(?P<sep>[-/.])(?P<m>\d{2})(?P=sep)(?P<d>\d{2})(?![\d/]|[.-]\d)", iso_date),
    ("date", r"(?<![\d.\-/])(?P<a>\d{2})(?P<s>[-/.])(?P<b>\d{2})(?P=s)(?P<year>\d{4})(?![\d/]|[.-]\d)", day_first),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d]|-\d)", ssn),
    ("ip", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)", ip),
    ("phone", r"(?<![\w+])(?P<prefix>\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|(?<!\d)\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d|[.-]\d)", phone),
    ("phone", r"(?<![\w+])(?P<prefix>\+\d{1,3}[ .-])(?:\(?\d{1,4}\)?[ .-]?){2,5}(?<=\d)(?!\d|[.-]\d)", phone),
    ("card", r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?!\d|[.-]\d)", card),
    ("secret", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])", secret),
]
COMPILED = [(kind, re.compile(pattern, re.ASCII), change) for kind, pattern, change in KINDS]
DIGIT = re.compile(r"[0-9]")
LOCAL = re.compile(r"(?<![\w.%+-])[A-Za-z0-9_%+-](?:[\w.%+-]{0,62}[A-Za-z0-9_%+-])?$", re.ASCII)
DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])", re.ASCII)


def emails(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    while at >= 0:
        low = max(0, at - 65)
        local = LOCAL.search(text[low:at])
        domain = DOMAIN.match(text, at + 1)
        if local and domain and (low == 0 or local.start() > 0):
            yield low + local.start(), domain.end()
        at = text.find("@", at + 1)


def pseudonymous(text: str, f: Feistel, back: bool = False) -> tuple[str, list[str]]:
    """(text with pseudonyms, kinds of what was replaced, in the text's order)."""
    found: list[tuple[int, int, int, str, str]] = []
    if "@" in text:
        for a, b in emails(text):
            local, domain = text[a:b].rsplit("@", 1)
            if re.search("[A-Za-z0-9]", local):
                found.append((a, -1, b, "email", spread(f, local, "email@" + domain.lower(), back, LETTERS) + "@" + domain))
    if DIGIT.search(text):
        for order, (kind, pattern, change) in enumerate(COMPILED):
            for m in pattern.finditer(text):
                new = change(f, m, back)
                if new is not None:
                    found.append((m.start(), order, m.end(), kind, new))
    if not found:
        return text, []
    out, kinds, last = [], [], 0
    for a, _, b, kind, new in sorted(found):
        if a >= last:
            out += [text[last:a], new]
            kinds.append(kind)
            last = b
    return "".join(out) + text[last:], kinds


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """(id, text, kinds): whole texts with pseudonyms for personal data, and the kinds of what was replaced.

    Replaced are cards that pass the Luhn check, IBANs that pass theirs, calendar dates, social-security and phone
    numbers, IP addresses, e-mail addresses' local parts and hexadecimal secrets of 32 digits or more. A value is
    permuted among the valid values of its format under the key, so equal values get equal pseudonyms in all
    documents, different ones different ones, and no value itself; ``back`` with the same key undoes it. Numbers that
    fail their check stay. Who has the key can undo the pseudonyms, so there is none by default. Rows are independent,
    ties and repeated rows included: one row comes out for each in, no shuffle. A null text stays null, an empty one
    empty, both with no kinds. Texts of any length are read whole, a few MB of them at a time. An empty table gives
    none. Other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for batch in slices(batches, "text", 4 << 20):
            texts, kinds = [], []
            for text in batch.column(1).to_pylist():
                new, k = (None, []) if text is None else pseudonymous(text, f, back)
                texts.append(new)
                kinds.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=["id", "text", "kinds"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, text string, kinds array<string>").toDF(id_col, text_col, "kinds")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the setting graphloom.pii.key; the test tables' texts are invented, so theirs is no secret."""
    key = spark.conf.get("graphloom.pii.key", "for invented texts only")
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), key.encode())
