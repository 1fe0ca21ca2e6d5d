"""Plain versions of the operators' results, for small tables."""

import re
from collections import Counter, defaultdict


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text, n):
    found = words(text)
    if len(found) < n:
        return {tuple(found)} if found else set()
    return {tuple(found[i:i + n]) for i in range(len(found) - n + 1)}


def linked(rows, n, num, den):
    """{id: (set size, smallest id of the component)} of (id, text) rows."""
    sets = {i: shingles(t, n) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    shared = Counter((a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1:])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for (a, b), c in shared.items():
        if den * c >= num * (len(sets[a]) + len(sets[b]) - c):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def personal(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits)
                    or kind == "phone" and 9 <= len(digits) <= 15):
                found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def repeating(rows, run=50):
    """Ids of the rows that share a run of so many words with another row."""
    first, found = {}, set()
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - run + 1):
            g = tuple(w[k:k + run])
            if first.setdefault(g, i) != i:
                found |= {i, first[g]}
    return found
