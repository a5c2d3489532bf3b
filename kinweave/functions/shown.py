"""Numbers, shares, p-values and dates as they are shown, and small pieces of text that exports use."""

from __future__ import annotations

import json
import math
import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A long integer outside a string, or a string.
_LONG = re.compile(r'"(?:\\.|[^"\\])*"|(?<![\w.+-])-?\d{16,}(?![\d.eE])')


def number(v: float | None, digits: int = 3) -> str:
    """Three significant digits, whole numbers in full with commas, never an exponent."""
    if v is None or math.isnan(v):
        return "–"
    if math.isinf(v):
        return "∞" if v > 0 else "-∞"
    if v == int(v) and abs(v) < 1e7 or abs(v) >= 1000:
        return f"{round(v):,}"
    if abs(v) < 1e-6:
        return "~0"
    places = digits - 1 - math.floor(math.log10(abs(v)))
    return f"{v:.{max(0, places)}f}".rstrip("0").rstrip(".")


def decimals(values: list[float | None]) -> int:
    """Decimals that all values of a column share, by its largest magnitude; none for whole numbers."""
    held = [abs(v) for v in values if v is not None and math.isfinite(v)]
    if not held or all(v == int(v) for v in held):
        return 0
    return next(d for least, d in ((100, 0), (10, 1), (1, 2), (0, 3)) if max(held) >= least)


def aligned(values: list[float | None], digits: int | None = None) -> list[str]:
    """A column with the same decimals on each row; what rounds to zero without being it is ~0."""
    places = decimals(values) if digits is None else digits
    text = lambda v: "–" if v is None or math.isnan(v) else ("∞" if v > 0 else "-∞") if math.isinf(v) else f"{v:,.{places}f}"
    return ["~0" if v and not math.isnan(v) and math.isfinite(v) and float(text(v).replace(",", "")) == 0 else text(v) for v in values]


def percent(v: float | None, digits: int = 0) -> str:
    return "–" if v is None or math.isnan(v) else f"{v * 100:.{digits}f}%"


def p_value(p: float | None) -> str:
    return "–" if p is None or math.isnan(p) else "p < 0.001" if p < 0.001 else f"p = {p:.3f}"


def date(t: datetime | None) -> str:
    return "unknown" if t is None else f"{t.day} {t:%b %Y}"


def quoted_ids(text: str) -> str:
    """JSON whose integers of 16 digits and more are strings, as they are ids that a double would round."""
    return _LONG.sub(lambda m: m[0] if m[0][0] == '"' else f'"{m[0]}"', text)


def parsed(text: str):
    """JSON with long ids as strings; a byte order mark and the assignment in front of a script's data are dropped."""
    text = text.lstrip("﻿")
    head = re.match(r"\s*[\w.$\[\]\"']+\s*=", text)
    return json.loads(quoted_ids(text[head.end() :].strip().rstrip(";") if head else text))


def status(url: Column) -> Column:
    """struct(handle, id) of a post's address; null for others and for addresses without a name."""
    pattern = r"(?i)^https?://(?:www\.|mobile\.)?(?:twitter|x)\.com/([a-z0-9_]{1,15})/status(?:es)?/(\d+)"
    handle = F.regexp_extract(url, pattern, 1)
    return F.when((handle != "") & (F.lower(handle) != "i"), F.struct(handle.alias("handle"), F.regexp_extract(url, pattern, 2).alias("id")))


def clean_id(value: Column) -> Column:
    """An id as text; blank and -1 mean none."""
    text = F.trim(value.cast("string"))
    return F.when((text != "") & (text != "-1"), text)
