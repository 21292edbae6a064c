"""A plain Katz model over dictionaries, to hold the operator against."""

import math
import re
from collections import Counter, defaultdict

CUT = 5


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [("end",)]


def discounts(n):
    d, n = [1.0] * (CUT + 2), [0, *n]
    common = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    plain = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
    for r in range(1, CUT + 1):
        good = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
        x = (good - common) / (1 - common) if common != 1 else 0.0
        d[r] = x if 0 < x <= 1 else (r - plain) / r
    return d


class Katz:
    def __init__(self, texts, order):
        self.order = order
        self.c = [None, *(Counter() for _ in range(order))]
        self.h = [None, *(Counter() for _ in range(order))]
        self.after = [None, *(defaultdict(set) for _ in range(order))]
        for t in texts:
            p = [("start",)] * (order - 1) + tokens(t)
            for i in range(order - 1, len(p)):
                for k in range(1, order + 1):
                    g = tuple(p[i - k + 1:i + 1])
                    self.c[k][g] += 1
                    self.h[k][g[:-1]] += 1
                    self.after[k][g[:-1]].add(g[-1])
        self.d = [None, *(discounts([sum(v == r for v in self.c[k].values()) for r in range(1, CUT + 2)]) for k in range(1, order + 1))]
        self.n, self.types = sum(self.c[1].values()), len(self.c[1])
        kept = sum(self.less(1, g) for g in self.c[1])
        self.scale = self.n / (self.n + 0.5) if self.n and self.n <= kept else 1.0
        self.unknown = 1 - kept * self.scale / self.n if self.n else 1.0
        self.memo = {}

    def less(self, k, g):
        c = self.c[k][g]
        return self.d[k][min(c, CUT + 1)] * c

    def backoff(self, k, h):
        if (k, h) not in self.memo:
            c = self.h[k][h]
            if not c:
                return 1.0, 1.0
            seen = sum(self.less(k, (*h, w)) / c for w in self.after[k][h])
            lower = sum(self.p(k - 1, h[1:], w) for w in self.after[k][h])
            s = c / (c + 0.5) if seen > 1 - 1e-9 else 1.0
            self.memo[k, h] = s, (1 - seen * s) / (1 - lower) if 1 - lower > 1e-12 else 0.0
        return self.memo[k, h]

    def p(self, k, h, w):
        if k == 1:
            return self.less(1, (w,)) * self.scale / self.n if self.c[1].get((w,)) else self.unknown
        s, a = self.backoff(k, h)
        if self.c[k].get((*h, w)):
            return self.less(k, (*h, w)) / self.h[k][h] * s
        return a * self.p(k - 1, h[1:], w)

    def score(self, text):
        p = [("start",)] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(self.order, tuple(p[i - self.order + 1:i]), p[i])) for i in range(self.order - 1, len(p)))

    def base(self, text):
        return sum(math.log10((self.c[1].get((w,), 0) + 0.1) / (self.n + 0.1 * (self.types + 1))) for w in tokens(text))
