"""Personal data replaced by format-preserving keyed pseudonyms (Feistel permutations)."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands in where no key is given; whoever holds the key can undo the pseudonyms.
EXAMPLE_KEY = b"replace this key before use"
ROUNDS = 8
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY

#: Characters that are permuted as one number.
LONGEST = 512

LOWER = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
HEX = "0123456789abcdef"
UPPER_DIGITS = LOWER.upper() + DIGITS


class Permutation:
    """Keyed permutations of the numbers below any size, one for each ``tweak``."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = blake2b(key, digest_size=32).digest(), rounds

    def _mix(self, tweak: bytes, turn: int, half: int, bits: int) -> int:
        name = b"%d %d %d " % (turn, bits, half) + tweak
        found, n = b"", 0
        while 8 * len(found) < bits:
            found += blake2b(b"%d " % n + name, key=self.key).digest()
            n += 1
        return int.from_bytes(found, "big") & ((1 << bits) - 1)

    def __call__(
        self, value: int, size: int, tweak: str, valid: Callable[[int], bool] = lambda v: True
    ) -> int:
        """The image of ``value``; a walk along its cycle ends at the next valid number below ``size``.

        As the walk starts at a valid number, it ends at one, and no two values share an image.
        """
        bits = max(1, (max(1, size - 1).bit_length() + 1) // 2)
        low, name = (1 << bits) - 1, b"%d %s" % (size, tweak.encode())
        while True:
            left, right = value >> bits, value & low
            for turn in range(self.rounds):
                left, right = right, left ^ self._mix(name, turn, right, bits)
            value = left << bits | right
            if value < size and valid(value):
                return value

    def characters(self, text: str, tweak: str, alphabets: tuple[str, ...]) -> str:
        """Permute the characters of each alphabet among texts of the same shape.

        Letters keep their case if only the lower-case alphabet is given; others stay. Long texts are permuted in
        parts, each with a tweak of its own.
        """
        if len(text) > LONGEST:
            parts = [text[at : at + LONGEST] for at in range(0, len(text), LONGEST)]
            return "".join(self.characters(part, f"{tweak} part {i}", alphabets) for i, part in enumerate(parts))
        places, value, size, shape = [], 0, 1, []
        for i, c in enumerate(text):
            own = next((a for a in alphabets if c in a), None)
            own = own or next((a for a in alphabets if c.lower() in a and c.isascii()), None)
            shape.append(str(len(own)) if own else c)
            if own:
                digit = own.find(c) if c in own else own.find(c.lower())
                value, size = value * len(own) + digit, size * len(own)
                places.append((i, own))
        if not places:
            return text
        value, out = self(value, size, f"{tweak} {' '.join(shape)}"), list(text)
        for i, own in reversed(places):
            value, digit = divmod(value, len(own))
            out[i] = own[digit] if out[i] in own else own[digit].upper()
        return "".join(out)

    def digits(self, text: str, new: int, many: int) -> str:
        """``text`` with its digits replaced by those of ``new``."""
        fresh = iter(f"{new:0{many}d}")
        return "".join(next(fresh) if c in DIGITS else c for c in text)


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _plain(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _card(text: str, permute: Permutation) -> str | None:
    number = _plain(text)
    if not 13 <= len(number) <= 19 or not luhn(number):
        return None
    # The first digit names the kind of card; the check digit follows from the others.
    body, many = number[1:-1], len(number) - 2
    new = number[0] + f"{permute(int(body), 10**many, f'card {len(number)}'):0{many}d}"
    check = next(c for c in DIGITS if luhn(new + c))
    return permute.digits(text, int(new + check), len(number))


def _phone(text: str, permute: Permutation) -> str | None:
    number = _plain(text)
    if not 8 <= len(number) <= 15 or not (text.startswith("+") or len(number) == 10):
        return None
    # Numbers of ten digits keep a country code before them, so they link with and without it.
    many = 10 if len(number) >= 10 else len(number)
    own = permute(int(number[-many:]), 10**many, "phone")
    return permute.digits(text, int(number[:-many] + f"{own:0{many}d}"), len(number))


def _social(text: str, permute: Permutation) -> str | None:
    def valid(value: int) -> bool:
        area, group, serial = value // 10**6, value // 10**4 % 100, value % 10**4
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    value = int(_plain(text))
    if not valid(value):
        return None
    return permute.digits(text, permute(value, 10**9, "social", valid), 9)


def _address(text: str, permute: Permutation) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _account(text: str, permute: Permutation) -> str | None:
    plain = text.replace(" ", "")

    def remainder(check: str, body: str) -> int:
        return int("".join(str(int(c, 36)) for c in body + plain[:2] + check)) % 97

    if not 15 <= len(plain) <= 34 or remainder(plain[2:4], plain[4:]) != 1:
        return None
    body = permute.characters(plain[4:], "account " + plain[:2], (LOWER.upper(), DIGITS))
    fresh = iter(plain[:2] + f"{98 - remainder('00', body):02d}" + body)
    return "".join(c if c == " " else next(fresh) for c in text)


def _date(text: str, permute: Permutation) -> str | None:
    a, mark, b, _, c = re.split(r"([-/.])", text)
    for form in ("ymd",) if len(a) == 4 else ("dmy",) if mark == "." else ("mdy", "dmy"):
        own = dict(zip(form, map(int, (a, b, c))))
        try:
            day = datetime.date(own["y"], own["m"], own["d"]).toordinal() - FIRST_DAY
        except ValueError:
            continue
        if 0 <= day < DAYS:
            width = dict(zip(form, map(len, (a, b, c))))

            # Among dates of one layout; of slashed ones only the first that fits is read back.
            def valid(value: int) -> bool:
                found = datetime.date.fromordinal(FIRST_DAY + value)
                short = (width["m"] > 1 or found.month < 10) and (width["d"] > 1 or found.day < 10)
                return short and (form != "dmy" or mark == "." or found.day > 12)

            new = datetime.date.fromordinal(FIRST_DAY + permute(day, DAYS, "date", valid))
            named = {"y": new.year, "m": new.month, "d": new.day}
            return mark.join(f"{named[f]:0{width[f]}d}" for f in form)
    return None


def _email(text: str, permute: Permutation) -> str:
    name, domain = text.rsplit("@", 1)
    labels, top = domain.rsplit(".", 1)
    return "@".join((
        permute.characters(name, "mail", (LOWER, DIGITS)),
        permute.characters(labels, "domain", (LOWER, DIGITS)) + "." + top,
    ))


def _cloud_key(text: str, permute: Permutation) -> str:
    return text[:4] + permute.characters(text[4:], "cloud key", (UPPER_DIGITS,))


def _secret(text: str, permute: Permutation) -> str:
    if re.fullmatch(r"[0-9a-f]+", text):
        return permute.characters(text, "secret", (HEX,))
    return permute.characters(text, "secret", (LOWER, DIGITS))


#: The forms of values looked for, in order of preference at one place.
FORMS = {
    "email": (
        r"(?<![\w.%+-])[\w.%+-]++@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.){1,8}[A-Za-z]{2,24}(?![\w-])",
        _email,
    ),
    "cloud_key": (r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)", _cloud_key),
    "secret": (
        r"(?i:(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?[ \t]{0,4}[=:][ \t]{0,4})"
        r"(?:\"[^\s\"']{6,}+(?=\")|'[^\s\"']{6,}+(?=')|[^\s\"']{6,}+)",
        _secret,
    ),
    "account": (r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)", _account),
    "date": (
        r"(?<![\w.,/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})"
        r"(?![0-9]|[/-][0-9])",
        _date,
    ),
    "address": (r"(?<![\w.-])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]|-[0-9])", _address),
    "social": (r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", _social),
    "card": (
        r"(?<![\w.+-])(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{1,4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1,4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})"
        r"(?![\w]|-[0-9])",
        _card,
    ),
    "phone": (
        r"(?<![\w+.-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])"
        r"|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,5}\)?){2,5}(?![\w-])",
        _phone,
    ),
}
_HINT = re.compile(r"[0-9@=:]")
_FOUND = re.compile("|".join(f"(?P<{kind}>{form})" for kind, (form, _) in FORMS.items()))
_LEAD = re.compile(r"[^=:]*[=:][ \t]*[\"']?")


def pseudonymised(text: str, permute: Permutation) -> tuple[str, int]:
    """``text`` with every valid value replaced, and how many there were."""
    if not _HINT.search(text):
        return text, 0
    parts, at, start, many = [], 0, 0, 0
    while found := _FOUND.search(text, start):
        kind, own = found.lastgroup, found.group()
        lead = _LEAD.match(own).group() if kind == "secret" else ""
        new = FORMS[kind][1](own[len(lead):], permute)
        if new is None:
            # Not valid as this kind: others may match at the same place.
            rest = (k for k in list(FORMS)[list(FORMS).index(kind) + 1 :])
            for other in rest:
                again = _ALONE[other].match(text, found.start())
                new = again and FORMS[other][1](again.group(), permute)
                if new is not None:
                    found, lead = again, ""
                    break
        if new is None:
            start = found.start() + 1
            continue
        parts += [text[at : found.start()], lead, new]
        at = start = found.end()
        many += 1
    return ("".join([*parts, text[at:]]), many) if many else (text, 0)


_ALONE = {kind: re.compile(form) for kind, (form, _) in FORMS.items()}


def pseudonymise(docs: DataFrame, key: bytes = EXAMPLE_KEY, count: str | None = None) -> DataFrame:
    """``docs`` with personal data and secrets in ``text`` replaced by keyed pseudonyms.

    Found are mail addresses, phone numbers, card numbers (by check digit), social security numbers, IPv4
    addresses, bank accounts (by check digits), dates, and keys, passwords and tokens. Each
    is permuted among the valid values of its form by a Feistel network under ``key``, so equal values have
    equal pseudonyms in all documents, layout and length stay, and check digits hold. Values that are not
    valid stay as they are. ``n_chars`` follows the text, if there is such a column; ``count`` names a
    column to add with the number of values replaced.

    Null texts stay null with 0 values; repeated rows get equal results; an empty table gives no rows;
    other columns pass through whatever their names.
    """
    @F.pandas_udf("text string, found bigint")
    def run(texts: pd.Series) -> pd.DataFrame:
        permute = Permutation(key)
        rows = [(None, 0) if t is None else pseudonymised(t, permute) for t in texts]
        return pd.DataFrame(rows, columns=["text", "found"])

    mark = "_pseudonyms"
    while mark in docs.columns:
        mark += "_"
    out = docs.withColumn(mark, run("text"))
    changes = {"text": F.col(f"{mark}.text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.length(F.col(f"{mark}.text")).cast(kind)
        changes["n_chars"] = F.when(F.col(f"{mark}.found") > 0, length).otherwise(F.col("n_chars"))
    columns = [changes.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns]
    return out.select(*columns, *([F.col(f"{mark}.found").alias(count)] if count else []))
