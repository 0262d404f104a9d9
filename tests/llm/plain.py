"""Plain versions that several tests hold operators against."""

from __future__ import annotations

import hashlib
import math


def target_words(sizes, weights=(1, 2, 3), cap=3):
    """[(source, size, target)] by code point, null last: rounds of sharing until no target is above its cap."""
    rows = [(s, n, weights[i % len(weights)]) for i, (s, n) in enumerate(sorted(sizes, key=lambda x: (x[0] is None, x[0] or "")))]
    fixed, total = {}, sum(n for _, n in sizes)
    while True:
        free = [i for i in range(len(rows)) if i not in fixed]
        left, weight = total - sum(fixed.values()), sum(rows[i][2] for i in free)
        over = [i for i in free if rows[i][2] * left > cap * rows[i][1] * weight]
        if not over:
            break
        fixed |= {i: cap * rows[i][1] for i in over}
    return [(s, n, float(fixed[i]) if i in fixed else w * (left / weight)) for i, (s, n, w) in enumerate(rows)]


def copies(rows, cap=3):
    """[copies] of (doc_id, text, source, size), each source's line in the order of size class and hash."""
    totals = {}
    for _, _, source, n in rows:
        totals[source] = totals.get(source, 0) + n
    out = [0] * len(rows)
    for sid, (source, size, target) in enumerate(target_words(list(totals.items()))):
        rate, shift = target / size if size else 0.0, int(hashlib.md5(f"mix:offset:{sid}".encode()).hexdigest()[:5], 16) / 2**20

        def place(i):
            doc_id, text, _, n = rows[i]
            digits = f"{n:b}".ljust(3, "0")
            inner = hashlib.md5((text or "").encode()).hexdigest()
            return len(f"{n:b}") * 4 + int(digits[1:3]), hashlib.md5(f"mix:{'' if doc_id is None else doc_id}:{inner}".encode()).hexdigest()

        for at, i in enumerate(sorted((i for i, r in enumerate(rows) if r[2] == source), key=place)):
            out[i] = min(cap, math.floor(shift + (at + 1) * rate) - math.floor(shift + at * rate))
    return out
