"""Plain versions of the operators' base results, over lists of (doc_id, text)."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def near(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), top(i), top(i) == i) for i, _ in rows)


def windows(rows, size=13):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    out = []
    for i, t in rows:
        w, gone = WORD.findall(t or ""), set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out)


def byte_windows(rows, size=100):
    first, out = {}, []
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, x in texts:
        for p in range(len(x) - size + 1):
            key = x[p : p + size]
            first[key] = min(first.get(key, (i, p)), (i, p))
    for i, x in texts:
        gone = bytearray(len(x))
        for p in range(len(x) - size + 1):
            if first[x[p : p + size]] < (i, p):
                gone[p : p + size] = b"\1" * size
        runs = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(x), sum(gone), runs, sha(bytes(c for c, g in zip(x, gone) if not g))))
    return sorted(out)


def personal(text):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for n, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0,
                "phone": 10 <= len(d) <= 15,
            }[kind]
            if good:
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return sorted(out)


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    lines, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in lines
            lines.add(x)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if count[g] > 1:
            covered.update((k, k + 1, k + 2))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)
