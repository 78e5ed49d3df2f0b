"""Exact rationals, certified root enclosures, strict and canonical JSON, for use inside UDFs."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from decimal import Context, Decimal
from fractions import Fraction
from math import isqrt

#: The literal's grammar and bounds.
LITERAL = re.compile(r"-?(?:0|[1-9][0-9]*)(?:/[1-9][0-9]*)?")
MAX_DIGITS, MAX_BITS, MAX_TERMS = 64, 8192, 32


class Invalid(ValueError):
    """The input isn't of the form that is checked."""


def need(ok: bool, code: str) -> None:
    if not ok:
        raise Invalid(code)


def rational(text, digits: int = MAX_DIGITS, reduced: bool = False) -> Fraction:
    need(isinstance(text, str) and LITERAL.fullmatch(text) is not None, "RATIONAL_LITERAL")
    need(all(len(x.lstrip("-")) <= digits for x in text.split("/")), "RATIONAL_MAGNITUDE")
    value = Fraction(text)
    need(not reduced or str(value) == text, "RATIONAL_NOT_REDUCED")
    return value


def bounded(x: Fraction) -> Fraction:
    need(max(x.numerator.bit_length(), x.denominator.bit_length()) <= MAX_BITS, "RATIONAL_RESOURCE_LIMIT")
    return x


def show(x: Fraction, digits: int = 45) -> str:
    context = Context(prec=digits)
    return str(context.divide(Decimal(x.numerator), Decimal(x.denominator)))


def outward(x: Fraction, up: bool, places: int = 12) -> str:
    """Decimal text that is never below (up) or above x."""
    unit = 10**places
    scaled = -((-x.numerator * unit) // x.denominator) if up else x.numerator * unit // x.denominator
    whole, part = divmod(abs(scaled), unit)
    return f"{'-' if scaled < 0 else ''}{whole}.{part:0{places}d}"


@dataclass(frozen=True)
class Interval:
    low: Fraction
    high: Fraction

    def __post_init__(self):
        need(bounded(self.low) <= bounded(self.high), "REVERSED_INTERVAL")

    def __add__(self, other: Interval) -> Interval:
        return Interval(self.low + other.low, self.high + other.high)

    def __sub__(self, other: Interval) -> Interval:
        return Interval(self.low - other.high, self.high - other.low)

    def times(self, k: Fraction) -> Interval:
        ends = sorted((k * self.low, k * self.high))
        return Interval(*ends)


def point(x: Fraction) -> Interval:
    return Interval(x, x)


def root(x: Fraction, digits: int = 40) -> Interval:
    """Enclosure of the square root on the grid of 10^-digits; a point where the root is on it."""
    need(x >= 0, "NEGATIVE_RADICAND")
    need(1 <= digits <= 80, "DIGITS")
    unit = 10**digits
    k = isqrt(x.numerator * unit * unit // x.denominator)
    low = Fraction(k, unit)
    return point(low) if low * low == x else Interval(low, Fraction(k + 1, unit))


def radical_sum(spec, digits: int) -> Interval:
    need(isinstance(spec, dict) and set(spec) == {"constant", "terms"}, "RADICAL_FIELDS")
    need(isinstance(spec["terms"], list) and len(spec["terms"]) <= MAX_TERMS, "RADICAL_TERMS")
    total = point(rational(spec["constant"]))
    for t in spec["terms"]:
        need(isinstance(t, dict) and set(t) == {"coefficient", "radicand"}, "RADICAL_TERM_FIELDS")
        total += root(rational(t["radicand"]), digits).times(rational(t["coefficient"]))
    return total


def strict_json(text: str, depth: int = 64):
    """JSON without duplicate keys, floats and constants, integers of at most 17 digits."""

    def pairs(items):
        need(len({k for k, _ in items}) == len(items), "DUPLICATE_KEY")
        return dict(items)

    def no_float(_):
        raise Invalid("FLOAT_NOT_ACCEPTED")

    def small(digits):
        need(len(digits.lstrip("-")) <= 17, "INTEGER_TOO_LONG")
        return int(digits)

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_float=no_float, parse_constant=no_float, parse_int=small)
    except (json.JSONDecodeError, RecursionError):
        raise Invalid("MALFORMED_JSON") from None
    stack = [(value, 1)]
    while stack:
        x, level = stack.pop()
        need(level <= depth, "JSON_TOO_DEEP")
        stack.extend((y, level + 1) for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()))
    return value


def canonical(value, indent: bool = False, newline: bool = False) -> bytes:
    """Sorted keys; compact, or indented ASCII; with or without a final line end: the dialects that hashes are made of."""
    if indent:
        text = json.dumps(value, sort_keys=True, indent=2, ensure_ascii=True)
    else:
        text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    return (text + ("\n" if newline or indent else "")).encode()


def digest(value) -> str:
    return hashlib.sha256(canonical(value)).hexdigest()
