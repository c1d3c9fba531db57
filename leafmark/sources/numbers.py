"""Numbers of a workbook as they are shown: an interpreter of number-format codes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The format codes that workbooks name by number only.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?",
    13: "# ??/??", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM",
    20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)",
    39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0",
    48: "##0.0E+0", 49: "@",
}
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()

_TOKEN = re.compile(
    r'"(?P<quoted>[^"]*)"?|\\(?P<escaped>.)|_(?P<blank>.)|\*(?P<fill>.)|\[(?P<elapsed>h+|m+|s+)\]|\[(?P<bracket>[^\]]*)\]'
    r"|(?P<general>General)|(?P<half>AM/PM|A/P)|(?P<date>y+|m+|d+|h+|s+)|(?P<second>\.0+)(?=[^0#?]|$)|(?P<digits>[0#?.,]+)"
    r"|(?P<exponent>E[+-][0#?]+)|(?P<percent>%)|(?P<text>@)|(?P<other>.)",
    re.I | re.S,
)
_CONDITION = re.compile(r"(<=|>=|<>|<|>|=)\s*(-?[0-9.]+)")
_TESTS = {
    "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b,
}


class Section:
    """One of the parts of a code between semicolons."""

    def __init__(self, code: str):
        self.condition = None
        self.tokens: list[tuple[str, str]] = []
        for m in _TOKEN.finditer(code):
            kind, text = m.lastgroup, m[m.lastgroup]
            if kind == "bracket":
                if found := _CONDITION.match(text):
                    self.condition = found[1], float(found[2])
                elif text.startswith("$"):  # a currency, with the language after a dash
                    self.tokens.append(("literal", text[1:].split("-")[0]))
            elif kind == "blank":
                self.tokens.append(("literal", " "))
            elif kind in ("quoted", "escaped", "other"):
                self.tokens.append(("literal", text))
            elif kind != "fill":
                self.tokens.append((kind, text))
        kinds = [k for k, _ in self.tokens]
        self.is_date = "date" in kinds or "elapsed" in kinds
        if not self.is_date:  # ".00" belongs to the digits unless it follows seconds
            self.tokens = [("digits", t) if k == "second" else (k, t) for k, t in self.tokens]
        self.percent = kinds.count("percent")
        places = [i for i, (k, t) in enumerate(self.tokens) if k == "literal" and t == "/"]
        self.fraction = bool(places) and not self.is_date and "digits" in kinds


@lru_cache(4096)
def _sections(code: str) -> list[Section]:
    parts, quoted, escaped, start = [], False, False, 0
    for i, c in enumerate(code):
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == '"':
            quoted = not quoted
        elif c == ";" and not quoted:
            parts.append(code[start:i])
            start = i + 1
    return [Section(p) for p in [*parts, code[start:]]]


def general(value: float) -> str:
    """A number without a format: as many digits as fit into eleven characters."""
    if value == int(value) and abs(value) < 1e11:
        return str(int(value))
    if 1e-4 <= abs(value) < 1e11:
        whole = len(str(int(abs(value))))
        return f"{value:.{max(0, 10 - whole)}f}".rstrip("0").rstrip(".")
    mantissa, exponent = f"{value:.5E}".split("E")
    mantissa = mantissa.rstrip("0").rstrip(".") if "." in mantissa else mantissa
    return f"{mantissa}E{exponent[0]}{exponent[1:].zfill(2)}"


def shown(value: float | None, code: str | None, from_1904: bool = False) -> str | None:
    """The text a cell shows for ``value`` under ``code``; no code is General, a code that no part of fits is too."""
    if value is None or math.isnan(value):
        return None
    sections = _sections(code or "General")[:3]
    picked, minus = _pick(sections, value)
    if picked is None:
        return general(value)
    if not picked.tokens:
        return ""
    if picked.is_date:
        return _date(picked, value, from_1904)
    return _number(picked, abs(value) if minus is not None else value, minus or "")


def _pick(sections: list[Section], value: float) -> tuple[Section | None, str | None]:
    """The section for a value, and the sign to put before its digits (None: the number keeps its own)."""
    conditional = [s for s in sections if s.condition]
    if conditional:
        for s in sections:
            if s.condition is None or _TESTS[s.condition[0]](value, s.condition[1]):
                return s, "-" if value < 0 and s is not sections[0] and s.condition is None else ""
        return None, None
    if len(sections) == 1:
        return sections[0], "-" if value < 0 else ""
    if value < 0:
        return sections[1], ""
    return (sections[2] if value == 0 and len(sections) > 2 else sections[0]), ""


def _number(section: Section, value: float, sign: str) -> str:
    if any(k == "general" for k, _ in section.tokens):
        return sign + "".join(general(value) if k == "general" else t for k, t in section.tokens if k in ("general", "literal"))
    if not any(k == "digits" for k, _ in section.tokens):
        return sign * any(k != "literal" for k, _ in section.tokens) + "".join(general(value) if k == "text" else t for k, t in section.tokens)
    if section.fraction:
        return sign + _fraction(section, value)
    mask = "".join(t for k, t in section.tokens if k == "digits")
    scaled = Decimal(repr(value)) * 100**section.percent
    exponent = next((t for k, t in section.tokens if k == "exponent"), None)
    if exponent:
        return sign + _scientific(section, scaled, mask, exponent)
    trimmed = mask.rstrip(",")
    scaled /= Decimal(1000) ** (len(mask) - len(trimmed))
    whole_mask, _, part_mask = trimmed.partition(".")
    places = len(part_mask.replace(",", ""))
    rounded = scaled.quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)
    whole, _, part = f"{rounded:f}".partition(".")
    digits = _whole(whole, whole_mask)
    if "." in trimmed:
        kept = list(part)
        for i in range(len(kept) - 1, -1, -1):  # zeros that the mask does not ask for
            if kept[i] != "0" or part_mask[i] == "0":
                break
            kept[i] = " " if part_mask[i] == "?" else ""
        digits += "." + "".join(kept)
    if rounded == 0 and sign == "-":
        sign = ""
    # the digits stand where the first mask is; literals between masks come after
    out, placed = [], False
    for kind, text in section.tokens:
        if kind == "digits":
            out.append("" if placed else digits)
            placed = True
        else:
            out.append(text)
    return sign + "".join(out)


def _whole(whole: str, mask: str) -> str:
    plain = mask.replace(",", "")
    whole = "" if whole == "0" and "0" not in plain else whole
    least = len(plain) - plain.index("0") if "0" in plain else 0
    whole = whole.zfill(least)
    if "," in mask:
        head = len(whole) % 3
        whole = ",".join([*([whole[:head]] if head else []), *(whole[i : i + 3] for i in range(head, len(whole), 3))])
    blanks = plain.count("?") - len(whole.replace(",", ""))
    return " " * max(0, blanks if "?" in plain else 0) + whole


def _scientific(section: Section, value: Decimal, mask: str, exponent: str) -> str:
    whole_mask, _, part_mask = mask.partition(".")
    width, power = max(1, len(whole_mask)), 0
    if value:
        power = value.adjusted()
        power -= power % width if width > 1 else 0
    mantissa = value.scaleb(-power).quantize(Decimal(1).scaleb(-len(part_mask)), ROUND_HALF_UP)
    if mantissa and mantissa.adjusted() >= width:
        power += width
        mantissa = value.scaleb(-power).quantize(Decimal(1).scaleb(-len(part_mask)), ROUND_HALF_UP)
    sign = "-" if power < 0 else "+" if exponent[1] == "+" else ""
    shown_power = f"{sign}{abs(power):0{len(exponent) - 2}d}"
    texts = {"digits": f"{mantissa:f}", "exponent": f"E{shown_power}"}
    return "".join(texts.get(k, t) for k, t in section.tokens)


def _fraction(section: Section, value: float) -> str:
    masks = [t for k, t in section.tokens if k == "digits"]
    mixed, bottom = len(masks) > 2, masks[-1]
    whole, rest = (int(value), value - int(value)) if mixed else (0, value)
    top, below = min(((round(rest * d), d) for d in range(1, 10 ** len(bottom))), key=lambda x: (abs(rest - x[0] / x[1]), x[1]))
    if mixed and top == below:
        whole, top = whole + 1, 0
    if mixed and not top:
        return f"{whole}" + " " * (2 + 2 * len(bottom))
    part = f"{str(top).rjust(len(masks[-2]))}/{str(below).ljust(len(bottom))}"
    return (f"{whole} " if whole else "  " if "#" not in masks[0] else " ") + part if mixed else part


def _date(section: Section, serial: float, from_1904: bool) -> str | None:
    if serial < 0:
        return None
    kinds = section.tokens
    decimals = max([len(t) - 1 for k, t in kinds if k == "second"], default=0)
    if from_1904:
        serial += 1462
    seconds = round(serial * 86400, decimals) if decimals else math.floor(serial * 86400 + 0.5)
    days, clock = divmod(seconds, 86400)
    # day 60 is the 29th of February that 1900 did not have
    moment = datetime(1899, 12, 31 if days < 60 else 30) + timedelta(days=int(days))
    hour, left = divmod(clock, 3600)
    minute, second = divmod(left, 60)
    twelve = any(k == "half" for k, _ in kinds)
    out = []
    for i, (kind, text) in enumerate(kinds):
        low = text.lower()
        if kind == "elapsed":
            total = {"h": seconds // 3600, "m": seconds // 60, "s": math.floor(seconds)}[low[0]]
            out.append(f"{int(total):0{len(text)}d}")
        elif kind == "half":
            out.append(("AM" if hour < 12 else "PM") if len(text) > 3 else "A" if hour < 12 else "P")
        elif kind == "second":
            out.append(f"{second - math.floor(second):.{decimals}f}"[1:])
        elif kind != "date":
            out.append(text)
        elif low[0] == "y":
            out.append(f"{moment.year % 100:02d}" if len(low) <= 2 else f"{moment.year:04d}")
        elif low[0] == "d":
            name = DAYS[moment.weekday()]
            out.append([f"{moment.day}", f"{moment.day:02d}", name[:3], name][min(len(low), 4) - 1])
        elif low[0] == "h":
            out.append(f"{int(hour % 12 or 12) if twelve else int(hour):0{min(len(low), 2)}d}")
        elif low[0] == "s":
            out.append(f"{int(second):0{min(len(low), 2)}d}")
        elif _is_minute(kinds, i):
            out.append(f"{int(minute):0{min(len(low), 2)}d}")
        else:
            name = MONTHS[moment.month - 1]
            out.append([f"{moment.month}", f"{moment.month:02d}", name[:3], name, name[0]][min(len(low), 5) - 1])
    return "".join(out)


def _is_minute(tokens: list[tuple[str, str]], at: int) -> bool:
    """An m is a minute right after hours or right before seconds."""
    def near(order: Iterator[tuple[str, str]]) -> str:
        return next((t[0].lower() for k, t in order if k in ("date", "elapsed")), "")

    return len(tokens[at][1]) <= 2 and (near(reversed(tokens[:at])) == "h" or near(iter(tokens[at + 1 :])) == "s")


@F.pandas_udf(T.StringType())
def _shown(value: pd.Series, code: pd.Series) -> pd.Series:
    return pd.Series([shown(v, c) for v, c in zip(value.astype(float), code, strict=True)], dtype=object)


def shown_numbers(value: Column, code: Column) -> Column:
    """Numbers as a workbook shows them under a format code each."""
    return _shown(value.cast("double"), code)


def serial_day(day: Column) -> Column:
    """The number a workbook keeps for a timestamp: days since the end of 1899."""
    return F.unix_micros(day.cast("timestamp")) / F.lit(86_400_000_000.0) + 25569
