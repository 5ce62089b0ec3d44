"""Label and id expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def make_label(*parts: Column | str, sep: str = "_") -> Column:
    """Parts joined by ``sep``; NULL if any part is NULL (``concat_ws`` would skip it)."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    joined = [cols[0]]
    for c in cols[1:]:
        joined += [F.lit(sep), c.cast("string")]
    return F.concat(*joined)


def before_first(c: Column | str, sep: str = "_") -> Column:
    return F.substring_index(c, sep, 1)


def after_first(c: Column | str, sep: str = "_") -> Column:
    """Text after the first separator; '' when there is none (the rest keeps later separators)."""
    parts = F.split(c, rf"\Q{sep}\E", 2)
    return F.coalesce(F.try_element_at(parts, F.lit(2)), F.when(parts.isNotNull(), F.lit("")))


def after_last(c: Column | str, sep: str = "_") -> Column:
    return F.substring_index(c, sep, -1)


def strip_version(c: Column | str) -> Column:
    return F.substring_index(c, ".", 1)


def recode(c: Column | str, cases: Sequence[tuple], default) -> Column:
    """First match wins; NULL stays NULL. ``cases`` are (value, result)."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.when(c.isNull(), F.lit(None))
    for value, result in cases:
        out = out.when(c == F.lit(value), F.lit(result))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def neg_log10(p: Column | str) -> Column:
    """-log10(p) with p = 0 giving +infinity instead of NULL."""
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p == 0, F.lit(float("inf"))).otherwise(-F.log10(p))


def plain_number(c: Column | str) -> Column:
    """Text form of a double, whole numbers without a decimal point."""
    c = F.col(c) if isinstance(c, str) else c
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))
