"""Columns for dates as texts: yyyy-mm-dd with x for unknown digits, and year ranges yyyy-yyyy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.folds import let

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_FULL = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_RANGE = "^[0-9]{4}-[0-9]{4}$"


def year_of(c: Column, pivot: int = 35) -> Column:
    """Four-digit form of a year of two or four characters; below the pivot two digits mean 20xx. Null if it is none."""

    def read(low: Column) -> Column:
        two = low.rlike("^[0-9]{2}$")
        return F.when(two, F.concat(F.when(low.try_cast("int") < pivot, "20").otherwise("19"), low)).when(low.rlike("^(19|20)([0-9]{2}|[0-9]x|xx)$"), low)

    return let(F.lower(F.trim(c)), read)


def month_number(c: Column) -> Column:
    """Two-digit month of an English name or its first letters."""
    numbers = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, f"{i:02d}")])
    return numbers[F.lower(F.substring(c, 1, 3))]


def _part(c: Column, most: int) -> Column:
    tens = "[01]" if most == 12 else "[0-3]"

    def read(low: Column) -> Column:
        number = F.when(low.rlike("^[0-9]{1,2}$"), low).try_cast("int")
        return F.when(low.isin("0", "00", "x", "xx"), "xx").when(number.between(1, most), F.lpad(low, 2, "0")).when(low.rlike(f"^{tens}x$"), low)

    return let(F.lower(F.trim(c)), read)


def partial_date(year: Column, month: Column, day: Column, pivot: int = 35) -> Column:
    """Normal form of three parts, or null: unknown digits may only stand at the right end, and complete dates must exist."""

    def checked(value: Column) -> Column:
        valid = value.rlike("^[0-9]{4}-(xx-xx|[0-9]x-xx|[0-9]{2}-(xx|[0-9]x))$|^[0-9]{3}x-xx-xx$|^[0-9]{2}xx-xx-xx$") | (value.rlike(_FULL) & F.try_to_date(value, "yyyy-MM-dd").isNotNull())
        return F.when(valid, value)

    return let(F.concat_ws("-", year_of(year, pivot), _part(month, 12), _part(day, 31)), checked)


def specificity(c: Column) -> Column:
    """Known parts of a date: 3 for complete ones, 0 for ranges and nulls."""
    parts = F.split(c, "-")
    return F.when(c.rlike(_RANGE) | c.isNull(), 0).otherwise(F.size(F.filter(parts, lambda x: ~x.contains("x")))).cast("long")


def is_complete(c: Column) -> Column:
    return c.rlike(_FULL)


def is_range(c: Column) -> Column:
    return c.rlike(_RANGE)


def year_range(c: Column, pivot: int = 35, most: int = 5) -> Column:
    """yyyy-yyyy of two to four years joined by - or _, each later than the one before; null otherwise. Short forms span `most` years at most."""
    sep = F.when(c.contains("_"), "_").otherwise("-")
    parts = F.split(F.replace(c, sep, F.lit("-")), "-")
    shaped = ~(c.contains("-") & c.contains("_")) & c.rlike("^([0-9]{2}|(19|20)[0-9]{2})([-_]([0-9]{2}|(19|20)[0-9]{2})){1,3}$")
    rates = c.rlike("^(16|24)[-_](44|48|88|96)$")
    first = year_of(F.get(parts, F.lit(0)), pivot).try_cast("int")
    rest = F.slice(parts, 2, 3)
    start = F.struct(first.alias("last"), F.lit(True).alias("ok"))

    def step(state: Column, part: Column) -> Column:
        number = part.try_cast("int")
        near = F.floor(state["last"] / 100).cast("int") * 100 + number
        year = F.when(F.length(part) == 4, number).when(near > state["last"], near).otherwise(near + 100)
        return F.struct(year.alias("last"), (state["ok"] & (year > state["last"])).alias("ok"))

    end = F.aggregate(rest, start, step)
    long = c.rlike("^[0-9]{4}([-_][0-9]{4})+$")
    good = shaped & ~rates & end["ok"] & (long | (end["last"] - first <= most))
    return F.when(shaped, F.when(good, F.concat_ws("-", first.cast("string"), end["last"].cast("string"))))


def compatible(a: Column, b: Column) -> Column:
    """Whether two dates agree in all parts that both know; a range agrees with a date of its years and with itself."""
    inside = lambda r, d: F.substring(d, 1, 4).try_cast("int").between(F.substring(r, 1, 4).try_cast("int"), F.substring(r, 6, 4).try_cast("int"))
    known = lambda c, i: F.when(~F.get(F.split(c, "-"), F.lit(i)).contains("x"), F.get(F.split(c, "-"), F.lit(i)))
    parts = [F.coalesce(known(a, i) == known(b, i), F.lit(True)) for i in range(3)]
    both = parts[0] & parts[1] & parts[2]
    return F.coalesce(F.when(a.isNull() | b.isNull(), F.lit(False)).when(is_range(a) & is_range(b), a == b).when(is_range(a), inside(a, b)).when(is_range(b), inside(b, a)).otherwise(both), F.lit(False))
