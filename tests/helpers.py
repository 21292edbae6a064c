"""Values and functions that several test modules use."""

import datetime as dt

AS_OF = dt.date(2026, 8, 14)   # a Friday; the week started Monday 2026-08-10


def days(n: int) -> dt.date:
    return AS_OF + dt.timedelta(days=n)


def rows(df, *cols):
    """Collected rows as tuples (of the given columns), sorted for comparison."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))
