"""Format-preserving pseudonyms for personal data.

Each value found and validated is replaced by a keyed permutation of itself within its own format: a Feistel network
over its digits (or hex digits, letters, days, addresses). The same value under the same key gives the same
pseudonym in every document, whatever its separators, so links survive; without the key it can't be undone, with the
key ``undo=True`` undoes it. Validated means: a value that fails its check (Luhn, mod 97, octets, calendar, number
ranges) is an ordinary number and stays; then the shorter and later groups of its digits are tried.

| kind | check | permuted | kept |
| --- | --- | --- | --- |
| email | shape | letters and digits of all parts but the last label | ``. _ + -``, last label |
| card | 13 to 19 digits, Luhn | all but the check digit, which is computed anew | separators |
| iban | mod 97 | digits and letters behind the check digits | country, grouping |
| ssn | area, group, serial in range | nine digits, again until in range | separators |
| phone | ``+`` and 8 to 15 digits, or ``(ddd) ddd-dddd`` | digits behind the country code | code, separators |
| ip | four octets up to 255 | the 32 bits | dots |
| date | calendar, years 1900 to 2099 | the day number | order of the parts, separators |
| secret | 20 hex digits or more, assigned to a token, key, secret or password | hex digits | quotes, case |

Defined cases: null text stays null and counts 0; empty text stays empty; repeated rows are replaced alike; other
columns stay, those with the names of the result are replaced. Runs row by row in Arrow batches, without a shuffle;
texts without a digit or an ``@`` are passed through after one search.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date", "secret")
ROUNDS = 10

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY

_ANY = re.compile(r"[0-9@]")
_EMAIL = re.compile(r"(?<![\w.+\-])[\w+\-](?:[\w.+\-]*[\w+\-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w\-])")
_SECRET = re.compile(r"(?i)\b(?:[a-z_\-]*(?:token|key|secret|password|passwd))[\"']?\s{0,3}[:=]\s{0,3}[\"']?([0-9a-f]{20,})(?![0-9a-z])")
_NUMBERS = re.compile(
    r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}(?:[ .\-/]?\(?\d{1,5}\)?){2,6}(?!\w)|(?<![\w)])\(\d{3}\) ?\d{3}[\-. ]\d{4}(?!\w))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    r"|(?P<date>(?:(?<![\w\-/.])|(?<=\d{4}-\d{2}-\d{2}/)|(?<=\dZ/)|(?<=:\d{2}/))\d{4}-\d{2}-\d{2}(?=T\d|/|(?![\w\-]|\.\d))"
    r"|(?<![\w\-/.])(?:\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w\-/]|\.\d))"
    r"|(?P<ssn>(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-]))"
    r"|(?P<card>(?:(?<![\w.\-])|(?<=\d-))\d(?:[ \-]?\d){12,18}(?![\w\-]))")
_RUN = re.compile(r"\d+(?:[ \-]\d+)*(?!\w)")
_GROUP = re.compile(r"\d+")


class Feistel:
    """Keyed permutations of bounded domains."""

    def __init__(self, key: bytes, undo: bool = False):
        self.key, self.undo = key, undo

    def _round(self, tweak: str, i: int, half: int, size: int) -> int:
        digest = hmac.new(self.key, f"{tweak}|{i}|{half}".encode(), hashlib.sha256).digest()
        return int.from_bytes(digest, "big") % size

    def pair(self, a: int, b: int, size_a: int, size_b: int, tweak: str) -> tuple[int, int]:
        """Permute a pair below ``size_a`` and ``size_b``: the halves are changed in turn, each by the other."""
        for i in (reversed(range(ROUNDS)) if self.undo else range(ROUNDS)):
            if i % 2 == 0:
                step = self._round(tweak, i, b, size_a)
                a = (a - step if self.undo else a + step) % size_a
            else:
                step = self._round(tweak, i, a, size_b)
                b = (b - step if self.undo else b + step) % size_b
        return a, b

    def digits(self, values: list[int], radices: list[int], tweak: str) -> list[int]:
        """Permute a number in mixed radices, digit for digit in the same radix."""
        tweak = f"{tweak}|{','.join(map(str, radices))}"
        cut = len(values) // 2
        halves = [(values[:cut], radices[:cut]), (values[cut:], radices[cut:])]
        numbers, sizes = [], []
        for part, radix in halves:
            number, size = 0, 1
            for v, r in zip(part, radix):
                number, size = number * r + v, size * r
            numbers.append(number)
            sizes.append(size)
        out = []
        for number, (part, radix) in zip(self.pair(*numbers, *sizes, tweak), halves):
            back = []
            for r in reversed(radix):
                number, v = divmod(number, r)
                back.append(v)
            out += back[::-1]
        return out

    def below(self, value: int, size: int, tweak: str) -> int:
        """Permute the numbers below ``size``: walk the cycle of a slightly larger square until back inside."""
        side = int(size ** 0.5) + 1
        while True:
            a, b = self.pair(*divmod(value, side), side, side, f"{tweak}|{size}")
            value = a * side + b
            if value < size:
                return value

    def text(self, text: str, tweak: str) -> str:
        """Permute letters and ASCII digits of a text, each within its class; everything else stays in place."""
        places, values, radices, classes = [], [], [], []
        for i, c in enumerate(text):
            for alphabet in (_DIGITS, _LOWER, _UPPER):
                if c in alphabet:
                    places.append(i)
                    values.append(alphabet.index(c))
                    radices.append(len(alphabet))
                    classes.append(alphabet)
        out = list(text)
        for i, v, alphabet in zip(places, self.digits(values, radices, tweak), classes):
            out[i] = alphabet[v]
        return "".join(out)


def luhn(digits: list[int]) -> int:
    """The check digit for these digits."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = d if i % 2 else d * 2
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(shape: str, digits: list[int]) -> str:
    """Put digits in the places of a shape's digits."""
    rest = iter(digits)
    return "".join(str(next(rest)) if c in _DIGITS else c for c in shape)


def _only(text: str) -> list[int]:
    return [int(c) for c in text if c in _DIGITS]


def _email(f: Feistel, value: str) -> str:
    head, last = value.rsplit(".", 1)
    return f"{f.text(head, 'email')}.{last}"


def _is_card(d: list[int]) -> bool:
    return luhn(d[:-1]) == d[-1] and len(set(d)) > 1


def _card(f: Feistel, value: str, clash: Callable[[str], bool] = lambda made: False) -> str | None:
    """``clash`` tells whether a pseudonym would be found in another place; then the next one is taken."""
    d = _only(value)
    if not _is_card(d):
        return None
    body = d[:-1]
    while True:         # a number of one repeated digit isn't taken for a card, so none is made either
        body = f.digits(body, [10] * len(body), "card")
        out = [*body, luhn(body)]
        if len(set(out)) > 1 and not clash(made := _refill(value, out)):
            return made


def _windows(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Where a card that starts here may end: the span found, then others of 13 to 19 digits at group borders, longest first.
    None reaches into a value of another kind."""
    ends, n = [], 0
    run = _RUN.match(text, start)
    for group in _GROUP.finditer(text, start, run.end() if run else end):
        if group.start() > start and (other := _NUMBERS.match(text, group.start())) and other.lastgroup != "card":
            end = min(end, group.start() - 1)
            break
        n += len(group[0])
        if n > 19:
            break
        if n >= 13 and group.end() != end:
            ends.append(group.end())
    whole = sum(c in _DIGITS for c in text[start:end]) >= 13 and end not in ends
    return [(start, e) for e in ([end] * whole + ends[::-1])]


def _iban(f: Feistel, value: str) -> str | None:
    plain = value.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = f.text(plain[4:], "iban" + plain[:2])
    made = plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body
    rest = iter(made)
    return "".join(c if c == " " else next(rest) for c in value)


def _ssn(f: Feistel, value: str) -> str | None:
    def valid(d):
        area, group, serial = d[0] * 100 + d[1] * 10 + d[2], d[3] * 10 + d[4], sum(d[5:])
        return area not in (0, 666) and area < 900 and group and serial

    d = _only(value)
    if not valid(d):
        return None
    d = f.digits(d, [10] * 9, "ssn")
    while not valid(d):
        d = f.digits(d, [10] * 9, "ssn")
    return _refill(value, d)


def _phone(f: Feistel, value: str) -> str | None:
    head = re.match(r"\+\d{1,3}(?=[ .\-/(])", value)
    head = head[0] if head else value[:2] if value[0] == "+" else ""
    tail = value[len(head):]
    d = _only(tail)
    if not 7 <= len(d) <= 14 or len(_only(head)) + len(d) > 15:
        return None
    return head + _refill(tail, f.digits(d, [10] * len(d), f"phone{head}"))


def _ip(f: Feistel, value: str) -> str | None:
    octets = value.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in octets):
        return None
    a, b, c, d = map(int, octets)
    high, low = f.pair(a * 256 + b, c * 256 + d, 65536, 65536, "ip")
    return f"{high >> 8}.{high & 255}.{low >> 8}.{low & 255}"


def _date(f: Feistel, value: str) -> str | None:
    mark = value[4] if value[4:5] == "-" else "/" if "/" in value else "."
    parts = [int(x) for x in value.split(mark)]
    orders = [(0, 1, 2)] if mark == "-" else [(2, 1, 0)] if mark == "." else [(2, 0, 1), (2, 1, 0)]
    for y, m, d in orders:
        try:
            day = datetime.date(parts[y], parts[m], parts[d])
        except ValueError:
            continue
        if not 1900 <= day.year <= 2099:
            return None
        while True:
            day = datetime.date.fromordinal(_FIRST_DAY + f.below(day.toordinal() - _FIRST_DAY, _DAYS, "date"))
            # a date whose parts could be read the other way round must stay readable in the same way
            if mark != "/" or (y, m, d) == (2, 0, 1) or day.day > 12:
                break
        out = [0, 0, 0]
        out[y], out[m], out[d] = day.year, day.month, day.day
        return mark.join(f"{v:04d}" if i == y else f"{v:02d}" for i, v in enumerate(out))
    return None


def _secret(f: Feistel, value: str) -> str:
    made = f.digits([int(c, 16) for c in value], [16] * len(value), "secret")
    return "".join("0123456789ABCDEF"[v] if c.isupper() else "0123456789abcdef"[v] for c, v in zip(value, made))


_REPLACE = {"email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date}


def pseudonymise(text: str, f: Feistel) -> tuple[str, dict[str, int]]:
    """The text with its personal data replaced, and how many of each kind."""
    found: list[tuple[int, int, str, str]] = []
    if not _ANY.search(text):
        return text, {}
    if "@" in text:
        found += [(m.start(), m.end(), "email", _email(f, m[0])) for m in _EMAIL.finditer(text)]
    found += [(m.start(1), m.end(1), "secret", _secret(f, m[1])) for m in _SECRET.finditer(text)]
    at = 0
    tried: list[tuple[int, int]] = []               # spans that are no cards and must not become any
    while m := _NUMBERS.search(text, at):
        made, end = None, m.end()
        if m.lastgroup == "card":
            tried = [x for x in tried if x[1] > m.start()]
            for start, end in _windows(text, m.start(), m.end()):
                made = _card(f, text[start:end], lambda made: any(_is_card(_only(  # noqa: B023
                    text[s:start] + made[max(s - start, 0):e - start] + text[end:e])) for s, e in tried))  # noqa: B023
                if made is not None:
                    break
                tried.append((start, end))
        else:
            made = _REPLACE[m.lastgroup](f, m[0])
        if made is not None:
            found.append((m.start(), end, m.lastgroup, made))
            at = end
        elif m.lastgroup == "iban":
            at = m.start() + 1                      # what follows may hold another kind
        else:
            at = _GROUP.search(text, m.start()).end()       # so may the later groups of digits
    out, end, counts = [], 0, {}
    for a, b, kind, made in sorted(found, key=lambda x: (x[0], -x[1])):
        if a < end:
            continue                                # inside a value already replaced
        out += [text[end:a], made]
        end = b
        counts[kind] = counts.get(kind, 0) + 1
    return "".join([*out, text[end:]]), counts


def pseudonymise_column(docs: DataFrame, key: bytes, text: str = "text", undo: bool = False) -> DataFrame:
    """Replace personal data in a text column; adds ``n_<kind>`` for each kind and ``n_private`` for all."""
    columns = [f"n_{k}" for k in KINDS]
    schema = "text string, " + ", ".join(f"{c} int" for c in columns)

    @F.pandas_udf(schema)
    def replaced(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = Feistel(key, undo)
        for texts in batches:
            rows = []
            for t in texts:
                made, counts = (t, {}) if t is None else pseudonymise(t, f)
                rows.append((made, *(counts.get(k, 0) for k in KINDS)))
            yield pd.DataFrame(rows, columns=["text", *columns]).astype(dict.fromkeys(columns, "int32"))

    keep = [c for c in docs.columns if c not in (*columns, "n_private")]
    made = docs.select(*(f"`{c}`" for c in keep), replaced(F.col(f"`{text}`")).alias("__made"))
    return made.select(
        *(F.col("__made.text").alias(c) if c == text else F.col(f"`{c}`") for c in keep),
        *(F.col(f"__made.{c}").alias(c) for c in columns),
        sum((F.col(f"__made.{c}") for c in columns), F.lit(0)).alias("n_private"))
