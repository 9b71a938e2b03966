"""Plain versions of operators, by their definitions."""

import hashlib
import re


def contaminated(text, items, span=10):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]
    own, hit, names = words(text), set(), set()
    for name, item in items:
        w = words(item)
        m = min(span, len(w))
        windows = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(own) - m + 1 if m else 0):
            if tuple(own[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                names.add(str(name))
    return len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def groups(texts, k, num, den):
    sets = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return {i: (len(s), r) for i, (s, r) in enumerate(zip(sets, root, strict=True))}
