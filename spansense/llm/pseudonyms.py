"""Format-preserving pseudonyms: numbers and dates read into a canonical value, permuted by key among the values as valid as it, and written in the format they had."""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Callable

#: So many bits keep the pseudonyms of a billion values apart but for a chance of 1 in 10**11.
PSEUDONYM_BITS = 96

# The letters that check a Spanish number, the spoken digits, and the calling codes of two digits (1 and 7 have one, all others three).
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
SPOKEN = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
_EXTENSION = re.compile(r",?[^\S\n]?(?:ext\.?|extension|x|durchwahl|poste)[^\S\n]?(\d{1,6})$", re.I)


class Feistel:
    """A keyed permutation of the numbers below ``n``: an unbalanced Feistel network over two digits of a mixed radix, with cycle walking."""

    def __init__(self, key: bytes, rounds: int = 8) -> None:
        self.key, self.rounds = key, rounds

    def _f(self, r: int, tweak: str, half: int, modulus: int) -> int:
        digest = hmac.new(self.key, f"{r}|{tweak}|{modulus}|{half}".encode(), hashlib.sha256).digest()
        return int.from_bytes(digest[:16], "big") % modulus

    def _once(self, x: int, n: int, tweak: str, forward: bool) -> int:
        b = int(n**0.5) + 1
        left, right = divmod(x, b)
        steps = range(self.rounds) if forward else range(self.rounds - 1, -1, -1)
        for r in steps:
            shift = self._f(r, tweak, right if r % 2 == 0 else left, b)
            shift = shift if forward else -shift
            if r % 2 == 0:
                left = (left + shift) % b
            else:
                right = (right + shift) % b
        return left * b + right

    def permute(self, x: int, n: int, tweak: str = "", forward: bool = True, like: Callable[[int], object] | None = None) -> int:
        """The image of ``x`` among 0 ... n - 1; with ``forward`` false the number whose image ``x`` is.

        With ``like`` the numbers for which it gives the same value are permuted among themselves.
        """
        if n < 2:
            return x
        kind = like(x) if like else None
        while True:
            x = self._once(x, n, tweak, forward)
            if x < n and (like is None or like(x) == kind):
                return x

    def digits(self, value: str, tweak: str, forward: bool = True, like: Callable[[str], object] | None = None) -> str:
        """A run of digits permuted among those of its length (and, with ``like``, of its kind)."""
        width = len(value)
        test = (lambda x: like(str(x).zfill(width))) if like else None
        return str(self.permute(int(value), 10**width, f"{tweak}|{width}", forward, test)).zfill(width) if width else ""

    def letters(self, value: str, tweak: str, forward: bool = True) -> str:
        """A run of ASCII letters permuted among those of its length, in upper case."""
        x = 0
        for c in value.upper():
            x = x * 26 + ord(c) - 65
        x = self.permute(x, 26 ** len(value), f"{tweak}|{len(value)}|a", forward)
        out = []
        for _ in value:
            x, c = divmod(x, 26)
            out.append(chr(65 + c))
        return "".join(reversed(out))


# --- phone numbers ------------------------------------------------------------------------------------------------------------------------


def _subscriber_kind(digits: str) -> tuple[bool, bool]:
    """What a pseudonym of a subscriber's number keeps: that it starts with no zero, and that it is a North American number (area and exchange start with 2 to 9)."""
    return digits[0] != "0", len(digits) == 10 and digits[0] in "23456789" and digits[3] in "23456789"


def phone_parts(value: str) -> tuple[str, str, str]:
    """``(lead, subscriber, extension)`` of a written or spoken number, digits only.

    The lead (calling code, trunk zero) stays as written; the subscriber's number is what the spellings of one number have in common: ``+1 415 555 0100``, ``1-415-555-0100`` and
    ``(415) 555-0100``, or ``+44 7700 900126``, ``0044 7700 900126``, ``+44 (0)7700 900126`` and ``07700 900126``.
    """
    ext = ""
    if m := _EXTENSION.search(value):
        ext, value = m.group(1), value[: m.start()]
    words = re.findall(r"[a-z]+", value.lower())
    if words and all(w in SPOKEN for w in words):
        digits, international = "".join(SPOKEN[w] for w in words), False
    else:
        digits = "".join(str(int(c)) for c in value if c.isdigit())
        international = value.lstrip().startswith("+") or digits.startswith("00")
    lead = ""
    if international:
        lead = "00" if digits.startswith("00") and not value.lstrip().startswith("+") else ""
        rest = digits[len(lead) :]
        code = rest[:1] if rest[:1] in ("1", "7") else rest[:2] if rest[:2] in TWO_DIGIT_CODES else rest[:3]
        lead += code
        if rest[len(code) : len(code) + 1] == "0":
            lead += "0"
    elif digits.startswith("0"):
        lead = "0"
    elif len(digits) == 11 and digits.startswith("1"):
        lead = "1"
    return lead, digits[len(lead) :], ext


def pseudonym_phone(value: str, cipher: Feistel, forward: bool = True) -> str:
    """A phone number of the same format: its calling code and trunk digit stay, its subscriber's number is permuted, and so is its extension."""
    lead, subscriber, ext = phone_parts(value)
    if subscriber:
        subscriber = cipher.digits(subscriber, "phone", forward, _subscriber_kind)
    return _pour(value, lead + subscriber + (cipher.digits(ext, "extension", forward) if ext else ""))


def _pour(value: str, digits: str) -> str:
    """``value`` with its digits, written or spoken, replaced in order."""
    rest = iter(digits)
    if not any(c.isdigit() for c in value):
        names = {d: w for w, d in SPOKEN.items() if w != "oh"}

        def say(m: re.Match) -> str:
            word, d = m.group(), next(rest)
            new = "oh" if d == "0" and word.lower() == "oh" else names[d]
            return new.upper() if word.isupper() else new.capitalize() if word[0].isupper() else new

        return re.sub(r"[A-Za-z]+", say, value)
    return "".join(next(rest) if c.isdigit() else c for c in value)


# --- identity numbers ---------------------------------------------------------------------------------------------------------------------


def _dni_check(bare: str) -> str:
    return DNI_LETTERS[int(bare[:-1].replace("X", "0").replace("Y", "1").replace("Z", "2")) % 23]


def _belgian_check(bare: str) -> str:
    """The last two digits of a Belgian national number; those born from 2000 on count with a 2 before it."""
    return f"{97 - int(bare[:9]) % 97:02d}"


def _belgian_born(bare: str) -> object:
    """Whether the first six digits are a date of birth, as a pseudonym must keep."""
    return 1 <= int(bare[2:4]) <= 12 and 1 <= int(bare[4:6]) <= 31


def _us_kind(bare: str) -> object:
    """The kind of a US number by its area: social security numbers have areas 001 to 899 but for 666, tax numbers start with 9; group and serial are not 0."""
    area = bare[:3]
    kind = "tax" if area[0] == "9" else "none" if area in ("000", "666") else "social"
    return kind, bare[3:5] == "00", bare[5:] == "0000"


def check_offset(bare: str) -> int | None:
    """How far the check characters of a bare number are from what they should be, 0 if it is valid; null if its format has none."""
    if re.fullmatch(r"(?:\d{8}|[XYZ]\d{7})[A-Z]", bare):
        at = DNI_LETTERS.find(bare[-1])
        return (at - DNI_LETTERS.index(_dni_check(bare))) % 23 if at >= 0 else None
    if re.fullmatch(r"\d{11}", bare):
        return (int(bare[9:]) - int(_belgian_check(bare))) % 100
    return None


def pseudonym_id(value: str, cipher: Feistel, forward: bool = True) -> str:
    """An identity number of the same format. Separators and case don't matter to what it becomes; check characters are worked out anew, so a valid number stays valid and a wrong one wrong.

    What isn't a check is permuted: runs of digits and of letters each among those of their length, within the ranges that a US or Belgian number has.
    """
    bare = re.sub(r"[^0-9A-Za-z]", "", value).upper()
    offset = check_offset(bare)
    shape = re.sub(r"[A-Z]", "a", re.sub(r"\d", "0", bare))
    if offset is not None and len(bare) == 11:
        body = cipher.digits(bare[:9], "belgian", forward, _belgian_born)
        new = body + f"{(int(_belgian_check(body + '00')) + offset) % 100:02d}"
    elif offset is not None:
        lead, body = (bare[0], bare[1:-1]) if bare[0] in "XYZ" else ("", bare[:-1])
        body = lead + cipher.digits(body, f"spanish{lead and 'nie'}", forward)
        new = body + DNI_LETTERS[(DNI_LETTERS.index(_dni_check(body + "A")) + offset) % 23]
    elif shape == "0" * 9:
        new = cipher.digits(bare, "us", forward, _us_kind)
    else:
        # the runs see each other's places only, so each is permuted on its own; the last letter of a British number is one of A to D
        fixed = bare[-1] if shape == "aa000000a" else ""
        parts = re.findall(r"\d+|[A-Z]+", bare[: len(bare) - len(fixed)])
        new = "".join(cipher.digits(p, f"{shape}|{i}", forward) if p[0].isdigit() else cipher.letters(p, f"{shape}|{i}", forward) for i, p in enumerate(parts)) + fixed
    rest = iter(new)
    out = []
    for c in value:
        n = next(rest) if c.isascii() and c.isalnum() else c
        out.append(n.lower() if c.islower() else n)
    return "".join(out)


# --- dates --------------------------------------------------------------------------------------------------------------------------------

_DATE = re.compile(r"(\d{4})(-)(\d{1,2})-(\d{1,2})|(\d{1,2})([./-])(\d{1,2})[./-](\d{4})")


def read_date(value: str) -> datetime.date | None:
    """The day of ``2001-03-04``, ``04.03.2001`` or ``4/3/2001``, day first unless it can't be; null if there is no such day between 1900 and 2099."""
    m = _DATE.fullmatch(value)
    if not m:
        return None
    year, month, day = (int(m[1]), int(m[3]), int(m[4])) if m[1] else (int(m[8]), int(m[7]), int(m[5]))
    if month > 12 and not m[1]:
        month, day = day, month
    try:
        date = datetime.date(year, month, day)
    except ValueError:
        return None
    return date if _FIRST_DAY <= date.toordinal() <= _LAST_DAY else None


def pseudonym_date(value: str, cipher: Feistel, forward: bool = True) -> str:
    """A date of the same format, permuted among all days of 1900 to 2099; what is no day becomes other digits.

    A day that is written month first stays one that can only be read so, and a date that can be read either way stays so.
    """
    date, m = read_date(value), _DATE.fullmatch(value)
    if date is None or m is None:
        return _pour(value, cipher.digits("".join(c for c in value if c.isdigit()), "no date", forward))
    month_first = not m[1] and int(m[7]) > 12
    both = lambda x: month_first and datetime.date.fromordinal(x + _FIRST_DAY).day > 12
    new = datetime.date.fromordinal(cipher.permute(date.toordinal() - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, "date|month first" if month_first else "date", forward, both) + _FIRST_DAY)
    if m[1]:
        return f"{new.year}-{new.month:02d}-{new.day:02d}"
    a, b = (new.month, new.day) if month_first else (new.day, new.month)
    return f"{a:02d}{m[6]}{b:02d}{m[6]}{new.year}"


def placeholder(kind: str, value: str, cipher: Feistel) -> str:
    """``[kind pseudonym]``: numbers and dates keep their format; of the other kinds the pseudonym is the first ``PSEUDONYM_BITS`` of a keyed digest in hexadecimal."""
    if kind in _FORMS:
        return f"[{kind} {_FORMS[kind](value, cipher)}]"
    plain = " ".join(value.lower().split())
    digest = hmac.new(cipher.key, f"{kind}|{plain}".encode(), hashlib.sha256).digest()
    return f"[{kind} {digest[: PSEUDONYM_BITS // 8].hex()}]"


_FORMS: dict[str, Callable[[str, Feistel], str]] = {"phone": pseudonym_phone, "id_number": pseudonym_id, "date": pseudonym_date}
