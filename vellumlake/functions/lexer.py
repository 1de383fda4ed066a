"""Quantities, references and units that a translation has to keep, as normalised tokens."""

from __future__ import annotations

import re
from collections import Counter
from math import gcd

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHITE = r"[\t-\r \x85\xa0  -     　]"
# Numerals, magnitudes and units, the units in the order in which they are tried.
_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
_POWERS = {"十": 10, "百": 100, "千": 1000, "万": 10**4, "亿": 10**8}
_WORDS = {"thousand": 3, "million": 6, "billion": 9, "K": 3, "M": 6, "B": 9, "万": 4, "亿": 8}
_UNITS = "GHz MHz kHz dpi bits bytes bit byte km cm mm ms Hz KB MB GB TB mV mA kW dB px pt °C min s h m K V A W".split()

_CN = "".join([*_DIGITS, *_POWERS])
#: Cheap test that all tokens need.
HINT = f"[0-9{_CN}]"
_TOKEN = re.compile(
    rf"(?P<den>[{_CN}]+)分之(?P<num>[{_CN}]*)"
    r"|\[[0-9, ]*[0-9][0-9, ]*\]"
    r"|(?P<raw>(?:(?<![^\W_])[+\-−])?[0-9]+(?:,[0-9]{3}(?![0-9]))*(?P<tail>(?:\.[0-9]+)?(?:[eE][+\-−]?[0-9]+)?%?))"
)
_RATIO = re.compile("/([0-9]+)")
_MAGNITUDE = re.compile(rf"(?:(?P<s>[KMB])(?![A-Za-z])|{_WHITE}*(?:(?P<w>(?i:thousand|million|billion))(?![A-Za-z])|(?P<c>[万亿])))")
_UNIT = re.compile(rf"{_WHITE}*({'|'.join(map(re.escape, _UNITS))})(?![A-Za-z])")
_MOST = 2**64


def chinese_integer(text: str) -> int | None:
    """The value of a numeral; None beyond 64 bits."""
    total = 0
    for section, unit in re.findall(r"([^万亿]*)([万亿]?)", text):
        value = 0
        for digits, power in re.findall(r"([^十百千]*)([十百千]?)", section):
            if digits or power:
                value += (_DIGITS[digits[-1]] if digits else 1) * _POWERS.get(power, 1)
        total += max(value, 1) * _POWERS[unit] if unit else value
    return total if total < _MOST else None


def fraction(numerator: int, denominator: int) -> str:
    """In lowest terms; hundredths as a percentage."""
    d = max(1, gcd(numerator, denominator))
    a, b = numerator // d, denominator // d
    return f"{a}%" if b == 100 else f"{a}/{b}"


def decimal(raw: str, power: int) -> str:
    """A number written out, times a power of ten; exponents and percentages stay as they are."""
    text = raw.replace("−", "-").replace(",", "")
    if re.search("[eE%]", text):
        return text
    sign, body = (text[0], text[1:]) if text[0] in "+-" else ("", text)
    whole, _, part = body.partition(".")
    zeros = whole[: len(whole) - len(str(int(whole)))] if sign == "+" else ""
    places = max(0, len(part) - power)
    n = int(whole + part) * 10 ** max(0, power - len(part))
    digits = str(n).rjust(places + 1, "0")
    out = digits[: len(digits) - places] + ("." + digits[len(digits) - places :] if places else "")
    out = out.rstrip("0").rstrip(".") if "." in out else out
    return out if sign == "-" and out == "0" else sign + zeros + out


def conserved_tokens(text: str) -> list[str]:
    """Tokens from left to right; what a token takes is not read again, but a unit is."""
    out, at = [], 0
    while (m := _TOKEN.search(text, at)) is not None:
        at = m.end()
        if m["den"] is not None:
            n, d = chinese_integer(m["num"]), chinese_integer(m["den"])
            if n is None or not d:
                at = m.start() + 1
            else:
                out.append(fraction(n, d))
        elif m["raw"] is None:
            out.append(m[0])
        else:
            raw = m["raw"]
            over = None if m["tail"] else _RATIO.match(text, at)
            plain = raw.replace(",", "").replace("−", "")
            if over and not plain.startswith("-") and int(plain) < _MOST and 0 < int(over[1]) < _MOST:
                out.append(fraction(int(plain), int(over[1])))
                at = over.end()
                continue
            times = _MAGNITUDE.match(text, at)
            word = (times["s"] or times["c"] or times["w"].lower()) if times else None
            out.append(decimal(raw, _WORDS[word] if word else 0))
            if not times and (unit := _UNIT.match(text, at)):
                out.append(unit[1])
    return out


def missing_tokens(source: str, target: str) -> list[str]:
    """Source tokens that the target lacks, sorted, as often as they are missing."""
    return sorted((Counter(conserved_tokens(source)) - Counter(conserved_tokens(target))).elements(), key=lambda t: t.encode())


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokens_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: conserved_tokens(t) if t is not None else None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def missing_of(source: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([missing_tokens(s or "", t or "") for s, t in zip(source, target)])


def simple_tokens(text: Column) -> Column:
    """The ASCII part of the same on the JVM: plain numbers, decimals and percentages."""
    return F.regexp_extract_all(text, F.lit(r"[0-9]+(?:[.][0-9]+)?%?"), F.lit(0))
