"""Plain versions of the operators, straight from their definitions."""

import re
from collections import Counter
from hashlib import sha256

LOWER = {c: c + 32 for c in range(65, 91)}


def sha(x: str) -> str:
    return sha256(x.encode()).hexdigest()


def decontamination(docs, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = []
    for name, text in items:
        w = word((text or "").translate(LOWER))
        n = min(window, len(w))
        windows += [(str(name) if name is not None else "null", tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    by = {}
    for name, w in windows:
        by.setdefault(w, set()).add(name)
    sizes = {len(w) for w in by}
    out = []
    for doc, text in docs:
        w = word((text or "").translate(LOWER))
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (t := tuple(w[i : i + n])) in by:
                    hit |= set(range(i, i + n))
                    names |= by[t]
        out.append((doc, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return out


def quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for k in range(3)}
    base = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), base


def jaccard_components(docs, size=3, num=90, den=100):
    sets = {}
    for doc, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[doc] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    ids = sorted(sets)
    root = {d: d for d in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return [(d, len(sets[d]), top(d)) for d in ids]
