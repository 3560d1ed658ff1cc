"""Display formats as column functions; a null shows as a dash."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from strandflow.functions.sequence import _c

DASH = "–"


def _shown(x: Column, text: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x.cast("double")), DASH).otherwise(text)


def fmt_int(value: Column | str) -> Column:
    """12345 as 12,345; halves go to the even neighbour."""
    x = _c(value)
    return _shown(x, F.format_number(F.rint(x.cast("double")).cast("long"), 0))


def fmt_float(value: Column | str, places: int = 2) -> Column:
    return _shown(_c(value), F.format_number(_c(value).cast("double"), places))


def fmt_pct(value: Column | str, places: int = 2) -> Column:
    return _shown(_c(value), F.format_string(f"%.{places}f%%", _c(value).cast("double")))


def fmt_bp(value: Column | str) -> Column:
    """Bases scaled to Gb, Mb, kb: two decimals, one from 10 kb on."""
    x = _c(value).cast("double")
    n = F.abs(x)
    scaled = lambda by, places, unit: F.format_string(f"%.{places}f {unit}", n / by)
    text = F.when(n >= 1e9, scaled(1e9, 2, "Gb")).when(n >= 1e6, scaled(1e6, 2, "Mb")).when(n >= 1e4, scaled(1e3, 1, "kb")).when(n >= 1e3, scaled(1e3, 2, "kb")).otherwise(F.concat(F.format_number(F.rint(n).cast("long"), 0), F.lit(" bp")))
    return _shown(x, F.concat(F.when(x < 0, "-").otherwise(""), text))


def fmt_span(value: Column | str) -> Column:
    """The exact count, from 1000 on with its scaled form in brackets."""
    x = _c(value)
    return _shown(x, F.when(F.abs(x) < 1000, fmt_int(x)).otherwise(F.concat(fmt_int(x), F.lit(" ("), fmt_bp(x), F.lit(")"))))


def axis_label(value: Column | str) -> Column:
    """1500000 as 1.5M, 24000 as 24k."""
    x = _c(value).cast("double")
    n = F.abs(x)
    plain = lambda y: F.regexp_replace(F.regexp_replace(F.format_string("%.6f", F.round(y, 5)), r"0+$", ""), r"\.$", "")
    return F.when(n >= 1e9, F.concat(plain(x / 1e9), F.lit("G"))).when(n >= 1e6, F.concat(plain(x / 1e6), F.lit("M"))).when(n >= 1e3, F.concat(plain(x / 1e3), F.lit("k"))).otherwise(plain(x))
