"""Column helpers that pin down the application's exact rules (dates, text
matching, number parsing and printing).

Scalar helpers (plain ``datetime.date`` math) compute window bounds from an
explicit ``as_of`` on the driver; operators never read the wall clock.
Column helpers return ``pyspark.sql.Column`` built from built-in functions so
they stay inside whole-stage codegen.
"""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as a JavaScript trim() sees it: Unicode White_Space plus U+FEFF.
_WS = r"(?U)[\s\x{FEFF}]"


# ----------------------------------------------------------------- scalars
def week_start(as_of: dt.date) -> dt.date:
    """Monday of the week holding ``as_of``; a Sunday belongs to the week
    that started six days earlier."""
    return as_of - dt.timedelta(days=as_of.weekday())


def month_start(as_of: dt.date) -> dt.date:
    return as_of.replace(day=1)


def add_months_overflow(d: dt.date, n: int) -> dt.date:
    """Calendar month shift that overflows like a JS Date / SQLite modifier:
    Aug 31 - 6 months is Mar 3 (Feb 31 rolls over), not Feb 28."""
    y, m = divmod(d.month - 1 + n, 12)
    first = dt.date(d.year + y, m + 1, 1)
    return first + dt.timedelta(days=d.day - 1)


def month_labels(as_of: dt.date, n: int) -> list[str]:
    """``n`` 'yyyy-MM' labels ending with the month of ``as_of``, oldest first."""
    out = []
    for i in range(n - 1, -1, -1):
        y, m = divmod(as_of.month - 1 - i, 12)
        out.append(f"{as_of.year + y:04d}-{m + 1:02d}")
    return out


def local_datetime(utc: dt.datetime, tz: str) -> dt.datetime:
    """UTC wall time -> the clinic's wall time. ``tz`` is a region id
    ('Africa/Lagos') or a fixed offset ('+01:00'), as Spark accepts."""
    if tz[:1] in "+-" and ":" in tz:
        sign = 1 if tz[0] == "+" else -1
        h, m = tz[1:].split(":")
        return utc + sign * dt.timedelta(hours=int(h), minutes=int(m))
    from zoneinfo import ZoneInfo
    return utc.replace(tzinfo=dt.timezone.utc).astimezone(ZoneInfo(tz)).replace(tzinfo=None)


def days_in_month(d: dt.date) -> int:
    return calendar.monthrange(d.year, d.month)[1]


# ----------------------------------------------------------------- columns
def col_add_months_overflow(c: Column, n: Column | int) -> Column:
    """Column form of :func:`add_months_overflow`."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.date_add(F.add_months(F.trunc(c, "MM"), n), F.dayofmonth(c) - 1)


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_WS}+|{_WS}+$", "")


def present(c: Column) -> Column:
    """Required-field check: not NULL and holds a non-whitespace character."""
    return F.coalesce(c.rlike(r"(?U)[^\s\x{FEFF}]"), F.lit(False))


def opt_text(c: Column) -> Column:
    """Optional text: empty string becomes NULL (not trimmed)."""
    return F.nullif(c, F.lit(""))


def blank_or_null(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == F.lit(""))


#: Decimal number text. Other things that the application's language reads as numbers (Infinity, 0x10)
#: are no amounts or vitals and count as text here.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number_text(c: Column) -> Column:
    """The trimmed text if it is a decimal number, else NULL (``1d`` and ``NaN`` are text)."""
    s = js_trim(c.cast("string"))
    return F.when(s.rlike(NUMBER), s)


def number_or_zero(c: Column, dtype: str = "decimal(18,2)") -> Column:
    """``Number(x) || 0``: text that is no number counts as 0. A number that does not fit is 0 here
    and reported by :func:`number_too_large`."""
    return F.coalesce(number_text(c).try_cast(dtype), F.lit(0).cast(dtype))


def number_too_large(c: Column, dtype: str) -> Column:
    """A number that ``dtype`` cannot hold."""
    n = number_text(c)
    fits = n.try_cast(dtype).isNotNull() if dtype != "double" else F.abs(n.try_cast("double")) < float("inf")
    return F.coalesce(n.isNotNull() & ~F.coalesce(fits, F.lit(False)), F.lit(False))


def number_or_null(c: Column, dtype: str = "double") -> Column:
    """Blank or NULL stays NULL; anything else is parsed (NULL if it is not a number)."""
    return number_text(c).try_cast(dtype)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only (SQLite LIKE folds ASCII letters, nothing else)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_term_pattern(term: str) -> str:
    """``%term%`` with the term trimmed and ASCII-lowered. The user's ``%``
    and ``_`` stay wildcards; a backslash is literal (SQLite LIKE has no
    escape character, Spark's default escape is the backslash)."""
    t = term.strip().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return "%" + t.replace("\\", "\\\\") + "%"


def like_ascii(c: Column, term: str) -> Column:
    return F.coalesce(ascii_lower(c).like(like_term_pattern(term)), F.lit(False))


def js_number_text(c: Column) -> Column:
    """Number printed the way JavaScript prints it: 38.0 -> '38', 38.5 -> '38.5'."""
    d = c.cast("double")
    return (F.when(d.isNull(), F.lit(None).cast("string"))
            .when((d == F.floor(d)) & (F.abs(d) < F.lit(1e15)), d.cast("long").cast("string"))
            .otherwise(d.cast("string")))


def js_decimal_text(c: Column) -> Column:
    """A DECIMAL printed the way JavaScript prints the same number: trailing
    fractional zeros dropped (15.50 -> '15.5', 20.00 -> '20'), never exponent form."""
    s = c.cast("string")
    return F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, "0+$", ""), "\\.$", "")).otherwise(s)


def money_text(c: Column) -> Column:
    """'$' + amount with two decimals, no thousands separator, minus after '$'."""
    return F.concat(F.lit("$"), F.coalesce(c, F.lit(0)).cast("decimal(18,2)").cast("string"))


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))
