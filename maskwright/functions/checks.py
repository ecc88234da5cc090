"""Checksums and shapes in Python, the twins of those in `columns`."""

from __future__ import annotations

import re

# First digits and lengths of the card networks.
NETWORKS = (("4", (13, 16, 19)), ("5[1-5]|2(?:2[2-9]|[3-6][0-9]|7[01]|720)", (16,)), ("3[47]", (15,)), ("6011|65|64[4-9]", (16, 19)), ("35(?:2[89]|[3-8][0-9])", (16, 19)), ("3(?:0[0-5]|[68])", (14,)))


def iban_ok(value: str) -> bool:
    s = value.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and s.isascii() and s.isalnum() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def longest_iban(match: str) -> str | None:
    cuts = (match[:e] for e in range(len(match), 14, -1) if e == len(match) or match[e] == " ")
    return next((c for c in cuts if c == c.rstrip() and iban_ok(c)), None)


def _digits(value: str) -> str:
    return "".join(c for c in value if c.isdigit())


def luhn_ok(value: str) -> bool:
    d = [int(c) for c in _digits(value)]
    doubled = [sum(divmod(2 * x, 10)) for x in d[-2::-2]]
    return 13 <= len(d) <= 19 and len(set(d)) > 1 and (sum(d[-1::-2]) + sum(doubled)) % 10 == 0


def card_ok(value: str) -> bool:
    d = _digits(value)
    return luhn_ok(d) and any(len(d) in sizes and re.match(first, d) for first, sizes in NETWORKS)


def identifier_shaped(digits: str) -> bool:
    if len(digits) == 7:
        return sum(int(d) * w for d, w in zip(digits, range(7, 1, -1))) % 10 == int(digits[6])
    return len(digits) == 9 and digits[0] in "234567"
