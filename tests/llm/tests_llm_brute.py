"""Brute-force similarity components."""

import re


def sets_of(pairs, size=3):
    out = []
    for d, text in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        out.append((d, frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])))
    return out


def brute_components(sets, of=90):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and min(len(a), len(b)) * 100 >= of * max(len(a), len(b)) and 100 * (k := len(a & b)) >= of * (len(a) + len(b) - k):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) if s else d for i, (d, s) in enumerate(sets)]
