"""Plain Python versions of the contracts, written apart from the operators."""

import hashlib
import re
import zlib

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def licenses(text):
    w = words(text)
    phrases = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
    found = []
    for label, p in phrases.items():
        p = p.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def contamination(documents, benchmark, window=10):
    """documents, benchmark: lists of (id, text)."""
    wins = {}
    for item, text in benchmark:
        w = words(text)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    sizes = {len(x) for x in wins}
    out = []
    for doc, text in documents:
        w, hit, items = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (t := tuple(w[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    items |= wins[t]
        out.append((doc, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def crc(data):
    return zlib.crc32(data) & 0xFFFFFFFF


def near_duplicates(documents, k=3, per_cent=85):
    """doc -> (n_shingles, component) by an index of shingles and a plain union-find."""
    sets = {}
    for doc, text in documents:
        w = [x.translate(ASCII_LOWER) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    index, root = {}, {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d in sorted(sets):
        shared = {}
        for g in sets[d]:
            for o in index.get(g, ()):
                shared[o] = shared.get(o, 0) + 1
            index.setdefault(g, []).append(d)
        for o, n in shared.items():
            if 100 * n >= per_cent * (len(sets[d]) + len(sets[o]) - n):
                a, b = sorted((find(d), find(o)))
                root[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}
