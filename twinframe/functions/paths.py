"""Path and formatting expressions. Paths are split by ``/``; ``\\`` counts as a separator where names are read off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ends a segment of an order key; sorts below every character of a name.
END = "\u0001"
#: Digits of a location's number in an order key: those of the largest int.
SEQ_DIGITS = 10


def extension(path: Column) -> Column:
    """The last dot of the last segment and what follows it; empty without a dot or behind a trailing one."""
    return F.regexp_extract(path, r"(\.[^.\\/]+)$", 1)


def parent_path(path: Column) -> Column:
    """The path without its last segment; a single segment has no parent (null)."""
    up = F.regexp_replace(path, r"[\\/][^\\/]+$", "")
    return F.when(up != path, up)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*)$", 1)


def depth(path: Column) -> Column:
    """Segments of the path."""
    return F.size(F.split(path, "/"))


def ancestors(path: Column, root: Column) -> Column:
    """All folders above ``path`` from ``root`` down, root included."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    some = F.when(F.size(parts) > 1, prefixes).otherwise(F.array().cast("array<string>"))
    return F.filter(some, lambda p: F.length(p) >= F.length(root))


def order_key(location_seq: Column, path: Column, is_file: Column) -> Column:
    """Sorts, as binary text, into the order of a traversal: a folder, its files, its subfolders; each by name."""
    parts = F.split(path, "/")
    folders = F.when(is_file, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    marked = F.transform(folders, lambda s: F.concat(F.lit("1"), s, F.lit(END)))
    last = F.when(is_file, F.concat(F.lit("0"), F.element_at(parts, -1), F.lit(END))).otherwise("")
    return F.concat(F.lpad(location_seq.cast("string"), SEQ_DIGITS, "0"), F.lit(END), F.array_join(marked, ""), last)


#: Unit names, each 1024 of the one before.
UNITS = ("bytes", "KB", "MB", "GB", "TB", "PB")


def size_suffix(value: Column, decimals: int = 1) -> Column:
    """Bytes for people: 0 is ``0.0 bytes``; what would round to 1000 moves up a unit; negatives mirror. Beyond the
    largest unit: null. Exact decimals, halves away from zero."""
    if decimals < 0:
        raise ValueError("decimals must not be negative")
    scale = 10**decimals
    big = F.abs(value.cast("decimal(30,0)"))

    def rounded(unit: int) -> Column:
        """The value in ``unit`` times ``scale``, rounded to a whole number."""
        return F.floor((big * F.lit(2 * scale) + F.lit(unit)) / F.lit(2 * unit)).cast("decimal(30,0)")

    out = F.lit(None).cast("string")
    for n in reversed(range(len(UNITS))):
        unit = 1024**n
        whole = F.floor(rounded(unit) / F.lit(scale)).cast("decimal(30,0)")
        rest = (rounded(unit) - whole * F.lit(scale)).cast("long").cast("string")
        text = F.concat(F.format_number(whole, 0), F.lit("."), F.lpad(rest, decimals, "0")) if decimals else F.format_number(whole, 0)
        fits = rounded(unit) < F.lit(1000 * scale)
        if n == len(UNITS) - 1:
            fits = big < F.lit(1024 ** len(UNITS))
        out = F.when(fits, F.concat(text, F.lit(f" {UNITS[n]}"))).otherwise(out)
    zero = F.lit(("0." + "0" * decimals if decimals else "0") + f" {UNITS[0]}")
    return F.when(value == 0, zero).when(value < 0, F.concat(F.lit("-"), out)).otherwise(out)


def clamp(x: Column) -> Column:
    """Into 0 to 1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def percent(x: Column) -> Column:
    """A fraction, clamped, as whole per cent, cut off."""
    return F.floor(clamp(x) * 100).cast("int")


def negation(flag: Column) -> Column:
    """True for false and the other way round; null stays null."""
    return ~flag


def long_date(ts: Column) -> Column:
    """A time as the long text of its day, in English: Monday, January 5, 2026."""
    return F.date_format(ts, "EEEE, MMMM d, yyyy")
