"""PII: format-preserving pseudonyms.

Numbers and dates that pass their validation are permuted by a keyed Feistel
network within their own format: a card number becomes another valid card
number of the same layout, a date another date. The permutation depends on key
and format only, so equal values stay equal across documents and different ones
stay different.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listing_engine.llm.shared import table

DEFAULT_KEY = "replace this key"
ROUNDS = 8
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of 0 .. n-1 for any n, one for each label."""

    key: str

    def permute(self, value: int, n: int, label: str) -> int:
        """Alternating Feistel rounds on value = high * b + low with a * b >= n; a
        result of n or more goes through again (the cycle must return below n).
        With n < 2 there is nothing to permute."""
        if n < 2:
            return value
        b = isqrt(n - 1) + 1
        a = -(-n // b)
        while True:
            high, low = divmod(value, b)
            for i in range(ROUNDS):
                if i % 2:
                    low = (low + self._round(i, high, label, n)) % b
                else:
                    high = (high + self._round(i, low, label, n)) % a
            value = high * b + low
            if value < n:
                return value

    def _round(self, i: int, half: int, label: str, n: int) -> int:
        size = max(8, n.bit_length() // 8 + 8)
        said = hashlib.shake_128(f"{self.key}\0{label}\0{n}\0{i}\0{half}".encode())
        return int.from_bytes(said.digest(size), "little")

    def spell(self, text: str, label: str) -> str:
        """`text` with its ASCII letters and digits permuted together, each within its kind and case."""
        value, n = 0, 1
        for c in text:
            if alphabet := _alphabet(c):
                value, n = value * len(alphabet) + alphabet.index(c), n * len(alphabet)
        value = self.permute(value, n, f"{label} {_layout(text)}")
        out = []
        for c in reversed(text):
            if alphabet := _alphabet(c):
                value, at = divmod(value, len(alphabet))
                c = alphabet[at]
            out.append(c)
        return "".join(reversed(out))


def _alphabet(c: str) -> str:
    if not c.isascii() or not c.isalnum():
        return ""
    return DIGITS if c.isdigit() else LOWER if c.islower() else LOWER.upper()


def _layout(text: str) -> str:
    return "".join("9" if _alphabet(c) == DIGITS else "a" if _alphabet(c) == LOWER else "A" if _alphabet(c) else c for c in text)


def luhn_sum(digits: str) -> int:
    """Sum of the digits, every second from the right doubled (and its own digits added)."""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return doubled + sum(map(int, digits[-1::-2]))


def _refill(layout: str, digits: str) -> str:
    """`digits` in the places of the digits of `layout`."""
    following = iter(digits)
    return "".join(next(following) if c in DIGITS else c for c in layout)


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def card(text: str, f: Feistel) -> str | None:
    """13 to 19 digits with a right check digit: the first digit stays, the check digit is made anew."""
    digits = _only_digits(text)
    if not 13 <= len(digits) <= 19 or luhn_sum(digits) % 10 or len(set(digits)) == 1:
        return None
    inner = digits[1:-1]
    moved = digits[0] + f"{f.permute(int(inner), 10 ** len(inner), f'card {len(digits)} {digits[0]}'):0{len(inner)}d}"
    return _refill(text, moved + str(-luhn_sum(moved + "0") % 10))


def iban(text: str, f: Feistel) -> str | None:
    """Country stays, the account is permuted sign by sign within its kind, the check digits are made anew."""
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
        return None
    account = f.spell(plain[4:], f"iban {plain[:2]}")
    rest = int("".join(str(int(c, 36)) for c in account + plain[:2] + "00")) % 97
    following = iter(f"{plain[:2]}{98 - rest:02d}{account}")
    return "".join(c if c == " " else next(following) for c in text)


def address(text: str, f: Feistel) -> str | None:
    """IPv4 with four numbers up to 255; the pseudonym is one, too (of other width, perhaps)."""
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255:
        return None
    value = int.from_bytes(bytes(parts), "big")
    return ".".join(map(str, f.permute(value, 1 << 32, "ipv4").to_bytes(4, "big")))


def national(text: str, f: Feistel) -> str | None:
    """ddd-dd-dddd with an area of 1 to 899 but 666, group and serial not 0."""
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    value, serial = divmod(f.permute(value, 898 * 99 * 9999, "ssn"), 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def phone(text: str, f: Feistel) -> str | None:
    """7 to 15 digits: the country code in front stays, all later digits are permuted together."""
    digits = _only_digits(text)
    if not 7 <= len(digits) <= 15:
        return None
    code = len(re.match(r"\+?(\d{0,3})(?=[^\d])|", text)[1] or "") if text.startswith("+") else 0
    rest = digits[code:]
    return _refill(text, digits[:code] + f"{f.permute(int(rest), 10 ** len(rest), f'phone {_layout(text)} {digits[:code]}'):0{len(rest)}d}")


def date(text: str, f: Feistel) -> str | None:
    """A day of 1900 to 2099, year-month-day, day.month.year or month/day/year (day/month/year if only that is a day)."""
    numbers = [int(p) for p in re.split(r"[-./]", text)]
    sign = text[len(re.match(r"\d+", text)[0])]
    orders = ((0, 1, 2),) if sign == "-" and len(text.split("-")[0]) == 4 else ((2, 1, 0),) if sign != "/" else ((2, 0, 1), (2, 1, 0))
    for order in orders:
        try:
            day = datetime.date(*(numbers[i] for i in order)).toordinal()
        except (ValueError, OverflowError):
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            moved = datetime.date.fromordinal(FIRST_DAY + f.permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date"))
            values = dict(zip(order, (moved.year, moved.month, moved.day)))
            return sign.join(f"{values[i]:0{4 if order[0] == i else 2}d}" for i in range(3))
    return None


def email(text: str, f: Feistel) -> str | None:
    """Both sides are permuted sign by sign; the last label (and an example domain of its own) stays."""
    name, _, domain = text.rpartition("@")
    labels = domain.split(".")
    return f"{f.spell(name.lower(), 'email')}@{f.spell('.'.join(labels[:-1]).lower(), 'domain')}.{labels[-1].lower()}"


def secret(text: str, f: Feistel) -> str | None:
    """The value after the name and the sign, permuted sign by sign."""
    name, value = re.match(r"(\w+[ \t]*[=:][ \t]*[\"']?)(.*)", text).groups()
    return name + f.spell(value, "secret")


#: (kind, pattern, pseudonym); the first that matches and validates wins. Each
#: pattern starts at an anchor that fails at once, so a text is read in one pass.
KINDS: tuple[tuple[str, str, Callable[[str, Feistel], str | None]], ...] = (
    ("secret", r"(?:password|passwd|token|secret|api_key)[ \t]{0,2}[=:][ \t]{0,2}[\"']?[A-Za-z0-9_+/-]{6,}+", secret),
    ("email", r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    ("ipv4", r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)", address),
    ("date", r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4})(?!\w|[./-]\d)", date),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?!\w|-\d)", national),
    ("card", r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?!\w|-\d)", card),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ -]?(?:\(\d{1,4}\)[ -]?)?\d{2,4}(?:[ -]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\w|-\d)", phone),
)
_TURN = {kind: turn for kind, _, turn in KINDS}
# nothing but signs that can begin a value is looked at closely
_ANY = re.compile(r"(?=[A-Za-z0-9+(])(?:" + "|".join(f"(?P<{kind}>{pattern})" for kind, pattern, _ in KINDS) + ")")
_EACH = {kind: re.compile(pattern) for kind, pattern, _ in KINDS}
#: A text without any of these holds none of the kinds.
_SIGN = re.compile(r"[0-9@]|password|passwd|token|secret|api_key")


def pseudonymized(text: str, key: str = DEFAULT_KEY) -> tuple[str, dict[str, int]]:
    """The text with every validated value replaced, and how many of each kind."""
    counts: dict[str, int] = {}
    if not _SIGN.search(text):
        return text, counts
    f = Feistel(key)
    out, done = [], 0
    for lo, hi in _neighbourhoods(text):
        at = max(lo, done)
        while (m := _ANY.search(text, at, hi)) is not None:
            at = m.start() + 1
            for kind in list(_EACH)[list(_EACH).index(m.lastgroup) :]:
                own = _EACH[kind].match(text, m.start(), hi)
                new = own and _TURN[kind](own[0], f)
                if new:
                    out += [text[done : m.start()], new]
                    counts[kind] = counts.get(kind, 0) + 1
                    done = at = own.end()
                    break
    return "".join([*out, text[done:]]), counts


def _neighbourhoods(text: str) -> list[tuple[int, int]]:
    """Stretches of text from the word of a sign of _SIGN to ten blanks beyond the last sign in them.

    A value starts in the word of its first sign, and no pattern has ten blanks
    without another sign, so none is cut. A stretch starts behind the one
    before, and words without a sign are read ten times at most.
    """
    found: list[list[int]] = []
    end = 0
    for m in _SIGNED.finditer(text):
        reach = _REACH.match(text, m.end()).end()  # groups of digits may be parted by single blanks
        if found and m.start() < end:
            found[-1][1] = reach
        else:
            found.append([max(end, *(text.rfind(c, end, m.start()) + 1 for c in " \n\t")), reach])
        end = reach
    return [(a, b) for a, b in found]


#: A sign with the rest of its word, so that each word is met once.
_SIGNED = re.compile(rf"(?:{_SIGN.pattern})[^ \n\t]*")
_REACH = re.compile(r"(?:[^ \n\t]*[ \n\t]?){10}")


def pseudonymize(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """`docs` with `text` rewritten and `pii` (map from kind to number found; empty if none).

    Null texts stay null; repeated rows stay and get equal pseudonyms; other
    columns pass through (one named `pii` is replaced). Whole texts are read.
    """

    @F.arrow_udf("struct<text: string, pii: map<string, int>>")
    def turn(texts: pa.Array) -> pa.Array:
        new, counts = [], []
        for t in texts:
            t = t.as_py()
            changed, found = (None, {}) if t is None else pseudonymized(t, key)
            new.append(changed)
            counts.append(list(found.items()))
        return pa.StructArray.from_arrays([pa.array(new, pa.string()), pa.array(counts, pa.map_(pa.string(), pa.int32()))], ["text", "pii"])

    names = [c for c in docs.columns if c != "pii"]
    both = docs.select(*names, turn("text").alias("turned__"))
    return both.select(*(F.col("turned__.text").alias("text") if c == "text" else F.col(c) for c in names), F.col("turned__.pii").alias("pii"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = F.aggregate(F.map_values("pii"), F.lit(0).cast("long"), lambda a, b: a + b)
    return done.select("doc_id", "text", number.alias("n_pii"), F.concat_ws(",", F.array_sort(F.map_keys("pii"))).alias("kinds"))


QUERIES = {"op6_pii": op6_pii}
ORACLE: dict[str, str] = {}
