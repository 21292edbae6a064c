"""Transfer functions of a stretch of stock requests: balance before -> balance after.

A restock maps x to x + q; a dispense maps x to x - q if x >= q and to x otherwise. What a stretch of
requests does is piecewise: on each piece the same requests are refused, so the piece adds a
constant. Pieces are kept as *runs* (begin, origin, value, period) over the balances from 0
on, each up to the next run's begin and the last without end:

* period 0: f(x) = value + (x - origin);
* period p: f(x) = value + (x - origin) mod p. Equal pieces in a row, as they come from refused requests of
  one size and from balances that have met, are one such run, so a function has few runs
  although it may have as many pieces as there are balances.

All numbers are exact integers (thousandths of a unit).
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from itertools import islice

Run = tuple[int, int, int, int]

MOST_RUNS = 50_000       # a function that would have more is left as two, one after the other


def _at(run: Run, x: int) -> int:
    d = x - run[1]
    return run[2] + (d % run[3] if run[3] else d)


def evaluate(runs: list[Run], x: int) -> int:
    return _at(runs[bisect_right(runs, x, key=lambda r: r[0]) - 1], x)


def constant(value: int) -> list[Run]:
    return [(0, 0, value, 1)]


def joined(a: Run, b: Run, end: int | None) -> Run | None:
    """One run for ``a`` up to the begin of ``b`` and ``b`` up to ``end`` (None: without end), if there is one."""
    n = b[0] - a[0]
    if a[3] == b[3]:
        if a[3]:
            return a if a[2] == b[2] and (a[1] - b[1]) % a[3] == 0 else None
        if _at(a, b[0]) == _at(b, b[0]):
            return a
        if end is not None and end - b[0] == n and _at(a, a[0]) == _at(b, b[0]):
            return a[0], a[0], _at(a, a[0]), n
    elif not a[3]:
        phase = (a[0] - b[1]) % b[3]
        if phase + n <= b[3] and b[2] + phase == _at(a, a[0]):
            return a[0], *b[1:]
    elif not b[3] and end is not None:
        phase = (b[0] - a[1]) % a[3]
        if phase + end - b[0] <= a[3] and a[2] + phase == _at(b, b[0]):
            return a
    return None


def _prepend(runs: deque[Run], a: Run) -> None:
    """Put ``a`` before the runs, joined with what follows where one run says the same."""
    runs.appendleft(a)
    while len(runs) > 1:
        both = joined(runs[0], runs[1], runs[2][0] if len(runs) > 2 else None)
        if both is None:
            return
        runs.popleft()
        runs[0] = both


def transfer(steps: list[int], most: int = MOST_RUNS) -> list[list[Run]]:
    """The functions, one after the other, of ``steps`` (what each adds; negative: a dispense). One, unless it would have
    more than ``most`` runs.

    Built from the last step back: a restock moves the runs towards 0, a dispense of q moves them up by q
    and puts a copy of those below q in front. Begins are kept less a common shift."""
    done: list[list[Run]] = []
    runs, shift = deque([(0, 0, 0, 0)]), 0
    for s in reversed(steps):
        if s > 0:
            shift -= s
            while len(runs) > 1 and runs[1][0] + shift <= 0:
                runs.popleft()
            if runs[0][0] + shift < 0:
                runs[0] = (-shift, *runs[0][1:])
        elif s < 0:
            below = 0
            for r in runs:
                if r[0] + shift >= -s:
                    break
                below += 1
            copies = [(b + s, o + s, v, p) for b, o, v, p in islice(runs, below)]
            shift -= s
            for a in reversed(copies):
                _prepend(runs, a)
            if len(runs) > most:
                done.append([(b + shift, o + shift, v, p) for b, o, v, p in runs])
                runs, shift = deque([(0, 0, 0, 0)]), 0
    done.append([(b + shift, o + shift, v, p) for b, o, v, p in runs])
    return done[::-1]


def _moved(g: list[Run], low: int, high: int | None, by: int) -> list[Run]:
    """The runs of x -> g(x + by) for x + by in [low, high)."""
    k = bisect_right(g, low, key=lambda r: r[0]) - 1
    out = []
    while k < len(g) and (high is None or g[k][0] < high):
        out.append((max(low, g[k][0]) - by, g[k][1] - by, g[k][2], g[k][3]))
        k += 1
    return out


def compose(f: list[Run], g: list[Run], most: int = MOST_RUNS) -> list[Run] | None:
    """x -> g(f(x)); None if that would take more than ``most`` runs on the way."""
    out: list[Run] = []
    for i, (begin, origin, value, period) in enumerate(f):
        end = f[i + 1][0] if i + 1 < len(f) else None
        if not period:
            first = value + begin - origin
            out += _moved(g, first, None if end is None else first + end - begin, value - origin)
        else:
            inner = _moved(g, value, value + period, 0)
            b, o, v, p = inner[0]
            phase = (value - o) % p if p else 0
            if len(inner) == 1 and (not p or phase + period <= p):
                out.append((begin, origin, _at(inner[0], value), period))
            elif len(inner) == 1 and period % p == 0:
                out.append((begin, origin - value + o, v, p))
            elif end is None or (end - begin) // period * len(inner) > most:
                return None
            else:
                x = begin
                while x < end:
                    wrap = origin + ((x - origin) // period) * period      # where this tooth begins
                    stop = min(end, wrap + period)
                    out += _moved(g, value + x - wrap, value + stop - wrap, value - wrap)
                    x = stop
        if len(out) > 4 * most:
            return None
    runs: deque[Run] = deque()
    for r in reversed(out):
        _prepend(runs, r)
    return list(runs) if len(runs) <= most else None
