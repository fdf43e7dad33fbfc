"""Plain Python versions of the operators, for small tables. Rows are (doc_id, text)."""

import hashlib
import re
from collections import Counter

import xxhash

SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
TOKEN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def last_null(i):
    return (i is None, i if i is not None else 0)


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(SPACE, "", t or ""), []).append((i, t or ""))
    best = {k: min(v, key=lambda r: (-len(r[1]), last_null(r[0]))) for k, v in groups.items()}
    out = []
    for i, t in rows:
        k = re.sub(SPACE, "", t or "")
        out.append((i, best[k][0], len(groups[k]), (i, len(t or "")) == (best[k][0], len(best[k][1])), sha(k)))
    return out


def fingerprint(text):
    words = re.findall(WORD, lower(text))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def near(rows, distance=3):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= distance:
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        r = find(a)
        least[r] = min(least.get(r, i), i, key=last_null)
    return [(i, f"{fps[a]:016x}", least[find(a)]) for a, (i, _) in enumerate(rows)]


def contaminated(rows, items, size=10):
    windows = {}
    for item, text in items:
        words = re.findall(TOKEN, lower(text))
        n = min(size, len(words))
        for k in range(len(words) - n + 1 if words else 0):
            windows.setdefault(tuple(words[k:k + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for i, text in rows:
        words = re.findall(TOKEN, lower(text))
        hit, found = [False] * len(words), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if (got := windows.get(tuple(words[k:k + n]))):
                    found |= got
                    hit[k:k + n] = [True] * n
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(words), sum(hit), len(names), sha(",".join(names)), any(hit)))
    return out


def substrings(rows, size=20):
    docs = [(i, re.findall(WORD, t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        for k in range(len(w) - size + 1):
            key, at = tuple(w[k:k + size]), (*last_null(i), k)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k:k + size])] < (*last_null(i), k):
                gone[k:k + size] = [True] * size
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def mixing(rows, weights=(1, 2, 3), most=3):
    """rows: (doc_id, text, source). Returns per row size, source size, target, copies."""
    size = [len(re.findall(WORD, t or "")) for _, t, _ in rows]
    total = Counter()
    for n, (_, _, s) in zip(size, rows):
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, capped, left = {}, set(), float(sum(total.values()))
    while True:
        free = [s for s in names if s not in capped]
        per = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if per * weight[s] > most * total[s]]
        if not over:
            target |= {s: per * weight[s] for s in free}
            break
        for s in over:
            target[s] = float(most * total[s])
            left -= target[s]
            capped.add(s)
    place = [int(hashlib.md5(f"{'-' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16) for i, t, _ in rows]
    copies = [0] * len(rows)
    for s in names:
        mine = [k for k, r in enumerate(rows) if r[2] == s]
        whole = int(target[s] // total[s]) if total[s] else 0
        budget, below = target[s] - whole * total[s], 0
        for p in sorted({place[k] for k in mine}):
            tie = [k for k in mine if place[k] == p]
            n = sum(size[k] for k in tie)
            once = n > 0 and below + n <= budget or (budget - below) * 2 > n
            for k in tie:
                copies[k] = min(most, whole + bool(once)) if total[s] else 0
            below += n
    return [(size[k], total[rows[k][2]], target[rows[k][2]], copies[k]) for k in range(len(rows))]
